"""Queries of the importer: exported traces, labels and stimuli made from the events table, as normalised tables.

A user is a recording of 3 ROIs whose frames are its events in time order; errors are the stimuli. ROI 2 has its
exported trace from the other extraction; every 7th event has no valid value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..importers import recordings as rec
from ..sources import integrity
from .base import r6, read, series

_ID = lambda: F.format_string("randi2023:pumpprobe_20200101_%06d", F.col("recording_id"))


def _frames(spark, d):
    return series(spark, d).select(_ID().alias("recording_id"), F.col("recording_id").alias("user"), "frame", "event_index", "event_type", "value")


def _cells(spark, d, value):
    x = _frames(spark, d).withColumn("roi_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    v = F.when(F.col("event_index") % 7 == 0, F.lit(float("nan"))).otherwise(value)
    return x.select("recording_id", "frame", "roi_index", v.alias("value"))


def _parts(spark, d):
    other = F.col("roi_index") == 2
    text = _cells(spark, d, F.col("value") * (F.col("roi_index") + 1) + F.when(other, 0.5).otherwise(0.0))
    green, matchless = _cells(spark, d, F.col("value") * (F.col("roi_index") + 1)), _cells(spark, d, F.col("value") * (F.col("roi_index") + 1) + 0.5)
    times = _frames(spark, d).select("recording_id", "frame", (F.col("frame") * 0.5).alias("time_s"))
    return text, rec.trace_sources(text, green, matchless), times


def trace_sources(spark, d):
    return _parts(spark, d)[1].groupBy("roi_index", "trace_source").agg(F.count("*").alias("n"))


def observations(spark, d):
    text, sources, times = _parts(spark, d)
    red = _cells(spark, d, F.col("value") + F.col("roi_index"))
    x = rec.observations(text, red, _cells(spark, d, -F.col("value")), sources, times)
    clean = lambda c: r6(F.nanvl(c, F.lit(-1.0))).alias(c)
    return x.select("recording_id", "roi_index", "frame", "time_s", clean("gcamp"), clean("red"), "gcamp_valid", "red_valid")


def _rois(spark, d):
    users = _frames(spark, d).select("recording_id", "user").distinct().withColumn("roi_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    k = (F.col("user") + F.col("roi_index")) % 5
    label = F.when(k == 0, "AVAL").when(k == 1, "RIG").when(k == 2, "").when(k == 3, F.when(F.col("user") % 2 == 0, "RIG").otherwise("41")).otherwise("smthng else")
    return rec.neurons(users.select("recording_id", "roi_index", label.alias("label"), F.when(F.col("roi_index") == 2, "matchless").otherwise("matched").alias("trace_source")))


def neurons(spark, d):
    x = _rois(spark, d)
    return x.select("recording_id", "roi_index", "roi_id", F.coalesce("label", F.lit("-")).alias("label"), "label_status", "label_duplicated", F.coalesce("neuron_id", F.lit("-")).alias("neuron_id"), "trace_source")


def _tried(spark, d):
    from pyspark.sql import Window

    x = _frames(spark, d)
    sizes = x.groupBy("recording_id").agg(F.count("*").alias("n_frames"), F.lit(3).alias("n_rois"))
    times = x.select("recording_id", "frame", (F.col("frame") * 0.5).alias("time_s"))
    e = x.filter("event_type = 'error'")
    frame = F.col("frame") - F.when((F.col("frame") > 0) & (F.col("event_index") % 9 == 0), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("event_index")) - 1
    manual = (F.col("event_index") % 5 - 2).cast("int")
    stimuli = e.select("recording_id", place.alias("event"), frame.alias("stim_frame"), (F.col("event_index") % 6 - 3).cast("int").alias("exported"), F.when(F.col("user") % 4 > 0, manual).alias("manual"), F.when(F.col("event_index") % 4 == 0, "ASKL").alias("manual_label"), (F.col("user") % 3 > 0).alias("joined"))
    return rec.trials(stimuli, _rois(spark, d), times, sizes)


def imported_trials(spark, d):
    x = _tried(spark, d)
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return x.select("trial_id", "animal_id", "event_index_in_file", "stim_index_in_recording", "stim_frame", dash("next_stim_frame"), "stimulus_start_s", "target_code", "target_code_exported", dash("target_roi_index"), dash("target_label"), dash("target_neuron_id"), dash("previous_trial_id"), dash("previous_target_label"), F.coalesce("time_since_previous_s", F.lit(-1.0)).alias("time_since_previous_s"), F.array_join("trial_qc_flags", ",").alias("flags"))


def own_responses(spark, d):
    """Per trial with a ROI as target, its own trace: frames, valid ones, and the valid share from the stimulus on."""
    text, sources, times = _parts(spark, d)
    auto = rec.autoresponses(_tried(spark, d), rec.observations(text, text, text, sources, times))
    x = auto.groupBy("trial_id").agg(F.count("*").alias("n"), F.count_if("gcamp_valid").alias("n_valid"), F.min("time_rel_s").alias("first_s"))
    return x.join(rec.valid_fractions(auto), "trial_id", "left").select("trial_id", "n", "n_valid", "first_s", r6(F.coalesce("autoresponse_valid_fraction", F.lit(-1.0))).alias("fraction"))


def task_traces(spark, d):
    text, sources, times = _parts(spark, d)
    seen, tried = rec.observations(text, text, text, sources, times), _tried(spark, d)
    x = rec.task_traces(tried, rec.valid_fractions(rec.autoresponses(tried, seen)), _rois(spark, d), seen)
    return x.select("trial_id", "roi_index", F.coalesce("target", F.lit("-")).alias("target"), "responder")


_S = """s AS (SELECT user_id AS u, 'randi2023:pumpprobe_20200101_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS rid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id AS e, event_type, value AS v FROM events)"""
_N = """n0 AS (SELECT rid, i, CASE (u + i) % 5 WHEN 0 THEN 'AVAL' WHEN 1 THEN 'RIG' WHEN 2 THEN '' WHEN 3 THEN CASE WHEN u % 2 = 0 THEN 'RIG' ELSE '41' END ELSE 'smthng else' END AS l FROM (SELECT DISTINCT u, rid FROM s), range(3) r(i)),
n1 AS (SELECT *, CASE l WHEN '' THEN 'blank' WHEN '41' THEN 'numeric' WHEN 'smthng else' THEN 'other' ELSE 'name' END AS st, l <> '' AND count(*) OVER (PARTITION BY rid, l) > 1 AS dup FROM n0),
n AS (SELECT *, CASE WHEN st = 'name' AND NOT dup THEN l END AS nid FROM n1)"""
_T = """t0 AS (SELECT s.*, row_number() OVER (PARTITION BY rid ORDER BY e) - 1 AS place, frame - CASE WHEN frame > 0 AND e % 9 = 0 THEN 1 ELSE 0 END AS f, CAST(e % 6 - 3 AS INT) AS x, CASE WHEN u % 4 > 0 THEN CAST(e % 5 - 2 AS INT) END AS m, CASE WHEN e % 4 = 0 THEN 'ASKL' END AS ml, count(*) OVER (PARTITION BY rid) AS nf FROM s),
t1 AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY e) - 1 AS place2, coalesce(x = -3 AND ml IS NULL AND m NOT IN (-1, -3), false) AS rec, coalesce(x = -2 AND m >= 0, false) AS sup FROM t0 WHERE event_type = 'error'),
t2 AS (SELECT *, CASE WHEN rec THEN m ELSE x END AS c FROM t1),
t3 AS (SELECT t2.*, rid || ':stim' || lpad(CAST(place2 AS VARCHAR), 3, '0') AS tid, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY t2.rid, f) AS same, nullif(n.l, '') AS rl, n.nid FROM t2 LEFT JOIN n USING (rid) WHERE n.i = greatest(c, 0) WINDOW w AS (PARTITION BY t2.rid ORDER BY f, place2)),
t4 AS (SELECT *, CASE WHEN c >= 0 THEN rl WHEN c = -3 THEN ml END AS tl, CASE c WHEN -1 THEN 'not_located' WHEN -2 THEN 'failed_targeting' WHEN -3 THEN 'identified_untracked' ELSE 'roi' END AS code FROM t3),
t AS (SELECT *, lead(f) OVER w AS nxt, lag(f) OVER w AS prv, lag(tid) OVER w AS ptid, lag(tl) OVER w AS ptl FROM t4 WINDOW w AS (PARTITION BY rid ORDER BY f, place2))"""

def written_manifest(spark, d):
    """Rows, nulls and flags of two tables, as seen by the write that made them."""
    e = read(spark, d, "events").withColumns({"late": F.when(F.col("value") > 1, F.col("value") > 5), "signup": F.when(F.col("event_type") == "signup", F.col("ts"))}).select("event_id", "late", "signup")
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("final"))
    seen = {name: integrity.write_observed(x, tables.new_path(spark)) for name, x in (("events", e), ("orders", o))}
    return integrity.observed_manifest(spark, seen)


QUERIES = {
    "trace_sources": (trace_sources, f"WITH {_S} SELECT i AS roi_index, CASE WHEN i = 2 THEN 'matchless' ELSE 'matched' END AS trace_source, count(DISTINCT u) AS n FROM s, range(3) r(i) GROUP BY ALL"),
    "observations": (observations, f"""WITH {_S} SELECT rid AS recording_id, i AS roi_index, frame, frame * 0.5::DOUBLE AS time_s, CASE WHEN e % 7 = 0 THEN -1 ELSE round(v * (i + 1) + CASE WHEN i = 2 THEN 0.5 ELSE 0 END::DOUBLE, 6) END AS gcamp,
 CASE WHEN e % 7 = 0 THEN -1 WHEN i = 2 THEN round(-v, 6) ELSE round(v + i, 6) END AS red, e % 7 <> 0 AS gcamp_valid, e % 7 <> 0 AS red_valid FROM s, range(3) r(i)"""),
    "neurons": (neurons, f"WITH {_S}, {_N} SELECT rid AS recording_id, i AS roi_index, rid || ':roi' || lpad(CAST(i AS VARCHAR), 3, '0') AS roi_id, CASE WHEN l = '' THEN '-' ELSE l END AS label, st AS label_status, dup AS label_duplicated, coalesce(nid, '-') AS neuron_id, CASE WHEN i = 2 THEN 'matchless' ELSE 'matched' END AS trace_source FROM n"),
    "imported_trials": (imported_trials, f"""WITH {_S}, {_N}, {_T} SELECT tid AS trial_id, replace(rid, ':', ':animal:') AS animal_id, place2 AS event_index_in_file, rank AS stim_index_in_recording, f AS stim_frame, coalesce(CAST(nxt AS VARCHAR), '-') AS next_stim_frame, f * 0.5::DOUBLE AS stimulus_start_s, code AS target_code, x AS target_code_exported,
 CASE WHEN c >= 0 THEN CAST(c AS VARCHAR) ELSE '-' END AS target_roi_index, coalesce(tl, '-') AS target_label, CASE WHEN c >= 0 THEN coalesce(nid, '-') ELSE '-' END AS target_neuron_id, coalesce(ptid, '-') AS previous_trial_id, coalesce(ptl, '-') AS previous_target_label, coalesce((f - prv) * 0.5::DOUBLE, -1.0) AS time_since_previous_s,
 concat_ws(',', CASE WHEN c < 0 THEN 'target_' || code END, CASE WHEN same > 1 THEN 'duplicate_stim_frame' END, CASE WHEN rank <> place2 THEN 'file_order_differs_from_time_order' END, CASE WHEN rec THEN 'target_code_reconciled_from_manual_file' END, CASE WHEN sup THEN 'manual_target_superseded_by_export' END, CASE WHEN u % 3 = 0 THEN 'acquisition_metadata_unjoined' END) AS flags FROM t"""),
    "task_traces": (task_traces, f"""WITH {_S}, {_N}, {_T}, a AS (SELECT tid FROM t JOIN s ON s.rid = t.rid AND s.frame >= f AND s.frame < coalesce(nxt, nf) WHERE c >= 0 GROUP BY tid HAVING avg(CASE WHEN s.e % 7 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE) >= 0.8)
SELECT DISTINCT tid AS trial_id, n.i AS roi_index, coalesce(tl, '-') AS target, n.nid AS responder FROM t JOIN a USING (tid) JOIN n ON n.rid = t.rid AND n.nid IS NOT NULL AND n.i <> c AND n.nid IS DISTINCT FROM tl
JOIN s ON s.rid = t.rid AND s.frame >= f AND s.frame < least(f + 60, coalesce(nxt, nf)) AND s.e % 7 <> 0 WHERE c >= 0"""),
    "own_responses": (own_responses, f"""WITH {_S}, {_N}, {_T}, a AS (SELECT tid, t.f, s.frame, s.e % 7 <> 0 AS ok FROM t JOIN s ON s.rid = t.rid AND s.frame >= coalesce(prv, 0) AND s.frame < coalesce(nxt, nf) WHERE c >= 0)
SELECT tid AS trial_id, count(*) AS n, count(*) FILTER (WHERE ok) AS n_valid, min((frame - f) * 0.5::DOUBLE) AS first_s, round(coalesce(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE) FILTER (WHERE frame >= f), -1), 6) AS fraction FROM a GROUP BY tid"""),
    "written_manifest": (written_manifest, """WITH e AS (SELECT event_id, CASE WHEN value > 1 THEN value > 5 END AS late, CASE WHEN event_type = 'signup' THEN ts END AS signup FROM events), o AS (SELECT o_orderkey, o_orderstatus = 'F' AS final FROM orders)
SELECT 'events' AS "table", 'event_id' AS "column", count(*) AS rows, count(*) FILTER (WHERE event_id IS NULL) AS nulls, CAST(NULL AS BIGINT) AS "true" FROM e
UNION ALL SELECT 'events', 'late', count(*), count(*) FILTER (WHERE late IS NULL), count(*) FILTER (WHERE late) FROM e
UNION ALL SELECT 'events', 'signup', count(*), count(*) FILTER (WHERE signup IS NULL), NULL FROM e
UNION ALL SELECT 'orders', 'o_orderkey', count(*), count(*) FILTER (WHERE o_orderkey IS NULL), NULL FROM o
UNION ALL SELECT 'orders', 'final', count(*), count(*) FILTER (WHERE final IS NULL), count(*) FILTER (WHERE final) FROM o"""),
}
