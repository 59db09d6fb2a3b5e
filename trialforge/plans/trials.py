"""Queries over recordings: schedule, windows, amplitudes, coverage, ordered series and scores."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import audit, tables
from ..operators import scan, scoring, windows
from ..sources import layout
from .base import r6, read, samples, series, trials, with_series

TRACE = ["recording_id", "trial_id", "event_index"]
LEVELS = {"in_50": NormalDist().inv_cdf(0.75), "in_80": NormalDist().inv_cdf(0.9), "in_95": NormalDist().inv_cdf(0.975)}
PHI, A, B = 0.5, 1.0, 0.02


def _aligned(spark, d):
    return windows.align(trials(spark, d), samples(spark, d))


def _dff(spark, d):
    return windows.dff(_aligned(spark, d), TRACE)


def _amp(spark, d):
    return windows.amplitude(_dff(spark, d), TRACE)


def _pairs(spark, d):
    """Amplitudes with target, responder and animal: labels by event and by recording."""
    return _amp(spark, d).select("trial_id", F.col("recording_id").alias("animal"), F.concat(F.lit("T"), F.col("event_index") % 4).alias("target"), F.concat(F.lit("T"), F.col("recording_id") % 5).alias("responder"), "amplitude")


PAIRS = """, pairs AS (SELECT trial_id, recording_id AS animal, 'T' || (event_index % 4) AS target, 'T' || (recording_id % 5) AS responder, amplitude FROM amp)
"""


def trial_schedule(spark, d):
    return trials(spark, d).select("trial_id", "stim_index", "stim_frame", "next_stim_frame", "previous_trial_id", (F.col("stim_frame") - F.col("previous_stim_frame")).alias("since_previous"), "same_frame")


def _extent(rows):
    return rows.groupBy("trial_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def event_windows(spark, d):
    return _extent(_aligned(spark, d))


def laid_out_windows(spark, d):
    """event_windows over tables that are laid out for it first."""
    s = tables.scratch(series(spark, d))
    stimuli = s.filter("event_type = 'error'").select("recording_id", F.col("frame").alias("stim_frame"), "event_index")
    laid = layout.lay_out_windows(windows.schedule(stimuli), s.select("recording_id", "frame", "value", "valid"), tables.new_path(spark))
    return _extent(windows.align_blocks(*laid))


def window_baseline_dff(spark, d):
    b = windows.baseline(_aligned(spark, d), TRACE)
    return b.select("trial_id", "n_base", r6("f0").alias("f0"), r6("pre_sd").alias("pre_sd"))


def dff_samples(spark, d):
    return _dff(spark, d).select("trial_id", "offset", r6("dff").alias("dff"), "dff_valid")


def response_amplitude(spark, d):
    return _amp(spark, d).select("trial_id", r6("amplitude").alias("amplitude"), "n_response")


def artifact_profile(spark, d):
    x = windows.with_baseline(_aligned(spark, d), TRACE).filter("valid and f0 is not null and offset between -3 and 4")
    return x.groupBy((F.col("event_index") % 4 == F.col("recording_id") % 5).alias("is_target"), "offset").agg(F.count("*").alias("n"), r6(F.avg((F.col("value") - F.col("f0")) / F.col("f0"))).alias("mean_dff"))


def pair_coverage(spark, d):
    p = _pairs(spark, d).filter("amplitude is not null and target <> responder")
    one = p.groupBy("target", "responder", "animal").agg(F.avg("amplitude").alias("m"), F.count("*").alias("n"), F.sum("amplitude").alias("s"), F.sum(F.col("amplitude") * F.col("amplitude")).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    out = one.groupBy("target", "responder").agg(n.alias("n_trials"), F.count("*").alias("n_animals"), (s / n).alias("mean"), F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))).alias("sd"), F.stddev_samp("m").alias("between"))
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n_trials"), F.lit(0.0))
    return out.select("target", "responder", "n_trials", "n_animals", r6("mean").alias("mean"), r6("sd").alias("sd"), r6(t).alias("t"), r6("between").alias("between_sd"))


def pair_variance(spark, d):
    """The audit's table of pairs: amplitude, t, and the variance within and between animals."""
    per = _pairs(spark, d).select("amplitude", F.col("animal").alias("animal_id"), F.col("target").alias("target_neuron_id"), F.col("responder").alias("neuron_id"), (F.col("target") == F.col("responder")).alias("is_target"))
    x = audit.pair_coverage(per)
    return x.select("target", "responder", "n_trials", "n_animals", r6("sd_amplitude").alias("sd"), r6("t_statistic").alias("t"), r6("within_animal_variance").alias("within"), r6("between_animal_variance").alias("between"))


def target_eligibility(spark, d):
    p = _pairs(spark, d).filter("amplitude is not null")
    auto = p.filter("target = responder").groupBy("target").agg(F.count_distinct("animal").alias("n_auto"))
    resp = p.filter("target <> responder").groupBy("target", "responder").agg(F.count_distinct("animal").alias("a")).filter("a >= 2").groupBy("target").agg(F.count("*").alias("n_resp"))
    out = p.select("target").distinct().join(auto, "target", "left").join(resp, "target", "left").fillna(0)
    why = F.array_compact(F.array(F.when(F.col("n_auto") < 3, "autoresponse"), F.when(F.col("n_resp") < 2, "responders")))
    return out.select("target", "n_auto", "n_resp", (F.size(why) == 0).alias("eligible"), F.array_join(why, ",").alias("reasons"))


def variance_components(spark, d):
    v = scoring.variance_components(series(spark, d).filter("valid"), "recording_id", "value")
    return v.select("n", "groups", r6("within").alias("within"), r6("between").alias("between"))


def per_group_slope(spark, d):
    x = series(spark, d).filter("valid").groupBy("recording_id").agg(F.count("*").alias("n"), F.regr_slope("value", "frame").alias("slope"), (F.max("frame") - F.min("frame")).alias("span"))
    return x.filter("n >= 5 and span > 0").select("recording_id", "n", r6("slope").alias("slope"))


def pre_slope(spark, d):
    x = _dff(spark, d).filter("offset < 0").groupBy("trial_id").agg(F.count_if("dff_valid").alias("n"), F.regr_slope(F.when(F.col("dff_valid"), F.col("dff")), F.when(F.col("dff_valid"), F.col("offset"))).alias("slope"))
    return x.select("trial_id", "n", r6(F.when(F.col("n") >= 3, F.coalesce("slope", F.lit(0.0))).otherwise(0.0)).alias("slope"))


def previous_valid(spark, d):
    x = windows.previous_valid(series(spark, d), ["recording_id"], ["frame"], "value", "valid")
    return x.select("recording_id", "frame", "prev_value", "gap")


def fill_down(spark, d):
    x = windows.fill_down(series(spark, d), ["recording_id"], ["frame"], F.when(F.col("event_type") == "signup", F.col("event_index")))
    return x.select("recording_id", "frame", "filled", "filled_from_above")


def interp_gaps(spark, d):
    return windows.interpolate(series(spark, d), ["recording_id"], "frame", "value", "valid").select("recording_id", "frame", r6("interp").alias("interp"))


def ar1_nll_gaussian(spark, d):
    x = scoring.ar1_nll(_dff(spark, d).filter("offset >= 0"), ["trial_id"], ["offset"], "dff", "dff_valid", scoring.sigma(A, B, F.lit(0.3)), PHI)
    return x.select("trial_id", "n", r6("nll").alias("nll"))


def ar1_nll_student(spark, d):
    x = scoring.ar1_nll(_dff(spark, d).filter("offset >= 0"), ["trial_id"], ["offset"], "dff", "dff_valid", scoring.sigma(A, B, F.lit(0.3)), PHI, 4.0)
    return x.select("trial_id", "n", r6("nll").alias("nll"))


_GAPS = f""", v AS (SELECT trial_id, dff, pow({PHI}, o - lag(o) OVER w) AS rho, lag(dff) OVER w AS p FROM (SELECT *, o FROM dff WHERE o >= 0 AND ok) WINDOW w AS (PARTITION BY trial_id ORDER BY o)),
pos AS (SELECT trial_id, o, ok, dff, row_number() OVER (PARTITION BY trial_id ORDER BY o) - 1 AS i FROM dff WHERE o >= 0),
e AS (SELECT trial_id, dff - coalesce(pow({PHI}, i - lag(i) OVER w), 0.0) * coalesce(lag(dff) OVER w, 0.0) AS e,
  greatest(1 - coalesce(pow({PHI}, i - lag(i) OVER w), 0.0) * coalesce(pow({PHI}, i - lag(i) OVER w), 0.0), 1e-12) * (sqrt({A * A} * 0.3 * 0.3 + {B * B}) * sqrt({A * A} * 0.3 * 0.3 + {B * B})) AS v
  FROM pos WHERE ok WINDOW w AS (PARTITION BY trial_id ORDER BY i))
"""


def per_animal_nll(spark, d):
    x = scoring.ar1_nll(_dff(spark, d).filter("offset >= 0"), ["recording_id", "trial_id"], ["offset"], "dff", "dff_valid", scoring.sigma(A, B, F.lit(0.3)), PHI)
    return x.groupBy("recording_id").agg(F.count("*").alias("traces"), F.sum("n").alias("samples"), r6(F.sum("nll")).alias("nll"))


def whiten(spark, d):
    return scoring.whiten(series(spark, d), ["recording_id"], ["frame"], "value", PHI).select("recording_id", "frame", r6("z").alias("z"))


def whitened_kl(spark, d):
    x = scoring.whiten(series(spark, d), ["recording_id"], ["frame"], "value", PHI)
    return x.groupBy("recording_id").agg(F.round(0.5 * F.sum(F.col("z") * F.col("z")), 2).alias("kl"))


def block_means(spark, d):
    x = series(spark, d).withColumn("block", F.floor(F.col("frame") / 5)).filter("valid")
    return x.groupBy("recording_id", "block").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


def block_variance(spark, d):
    """The variance of each block's mean under AR(1): the sum of phi^|i-j| over its valid pairs, over n squared."""
    x = series(spark, d).withColumn("block", F.floor(F.col("frame") / 5)).filter("valid").select("recording_id", "block", "frame")
    y = x.withColumnRenamed("frame", "other")
    pair = x.join(y, ["recording_id", "block"]).groupBy("recording_id", "block").agg(F.sum(F.pow(F.lit(PHI), F.abs(F.col("frame") - F.col("other")))).alias("q"), F.count("*").alias("nn"))
    return pair.select("recording_id", "block", F.round(F.col("q") / F.col("nn"), 9).alias("var_of_mean"))


def peak_halfdecay(spark, d):
    x = windows.peak_shape(_dff(spark, d).filter("dff_valid"), ["trial_id"], "offset", "dff")
    peak, million = F.col("peak"), F.round(F.col("peak") * 1e6) / 1e6  # as SQL engines round: r6 goes by a double's shortest digits
    return x.select("trial_id", F.when(peak < 0, -F.abs(million)).otherwise(million).alias("peak"), "latency", "half_rise", "half_decay")


KNOTS = (0, 1, 2, 4, 6, 9, 13, 18, 25, 33, 43, 59)


def convolve_basis(spark, d):
    basis = spark.createDataFrame(windows.tents(KNOTS, 60), "lag int, k int, weight double")
    u = series(spark, d).select("recording_id", "frame", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("u"))
    return windows.convolve(u, ["recording_id"], "frame", "u", basis, 60).select("recording_id", "frame", "k", r6("x").alias("x"))


_RUNS = """, marks AS (SELECT *, CASE WHEN valid AND NOT coalesce(lag(valid) OVER w, false) THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
runs AS (SELECT recording_id, frame, value, run FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY frame) AS run FROM marks) WHERE valid)
"""
_TENTS = ", tents(lag, k, weight) AS (VALUES " + ", ".join(f"({a}, {k}, {w!r}::DOUBLE)" for a, k, w in windows.tents(KNOTS, 60)) + ")\n"


def autoresponse_frames(spark, d):
    t = trials(spark, d).filter("previous_stim_frame is not null and next_stim_frame is not null")
    x = windows.between(t, samples(spark, d), "previous_stim_frame", "next_stim_frame")
    return x.groupBy("trial_id").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), r6(F.avg(F.when(F.col("valid"), F.col("value")))).alias("mean"))


def interval_coverage(spark, d):
    w = Window.partitionBy("recording_id")
    x = series(spark, d).withColumns({"m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w)})
    c = scoring.coverage(x.filter("s > 0"), ["recording_id"], (F.col("value") - F.col("m")) / F.col("s"), LEVELS)
    return c.select("recording_id", "n", *[r6(k).alias(k) for k in LEVELS])


def segment_autocorr(spark, d):
    """Of windows of a trial before the stimulus that are valid throughout, by recording."""
    x = _aligned(spark, d).filter("offset between -10 and -2").withColumn("full", F.col("valid") & F.col("value").isNotNull())
    x = x.join(x.groupBy("trial_id").count().filter("count = 9").select("trial_id"), "trial_id")
    return scoring.segment_autocorr(x, ["recording_id"], ["trial_id"], "frame", "value", "full", short=True).select("recording_id", "segments", "pairs", r6("lag1").alias("lag1"))


def run_autocorr(spark, d):
    """Of runs of at least three consecutive valid samples, by recording; runs may be of any length."""
    x = scan.runs(series(spark, d), ["recording_id"], "frame", F.col("valid")).filter("run is not null")
    return scoring.segment_autocorr(x, ["recording_id"], ["run"], "frame", "value", "valid", 3).select("recording_id", "segments", "pairs", r6("lag1").alias("lag1"))


def valid_runs(spark, d):
    x = scan.runs(series(spark, d), ["recording_id"], "frame", F.col("valid")).filter("run is not null")
    return x.groupBy("recording_id", "run").agg(F.min("frame").alias("first"), F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


def leaky_filter(spark, d):
    return scan.leaky(series(spark, d), ["recording_id"], ["frame"], "value", 5.0).select("recording_id", "frame", r6("filtered").alias("filtered"))


def tail_diagnostics(spark, d):
    w = Window.partitionBy("recording_id")
    x = series(spark, d).withColumns({"m": F.avg("value").over(w), "s": F.stddev_pop("value").over(w)}).filter("s > 0").withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    return x.groupBy(F.floor(F.col("frame") / 20).alias("time_bin")).agg(F.count("*").alias("n"), F.count_if(F.abs("z") > 2).alias("big"), r6(F.avg(F.pow("z", F.lit(4.0))) / F.pow(F.avg(F.pow("z", F.lit(2.0))), F.lit(2.0)) - 3).alias("kurtosis"))


def top_share(spark, d):
    """Share of all squared signal in the largest hundredth of the samples."""
    x = tables.ordered(series(spark, d).select("event_type", "value"), ["event_type"], [F.desc("value")], "p", "n")
    tied = x.groupBy("event_type", "value").agg(F.min("p").alias("p"), F.max("n").alias("n"), F.count("*").alias("m"))  # ties share the first rank
    x = tied.withColumns({"r": F.coalesce(F.col("p") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)), "q": F.col("m") * F.col("value") * F.col("value")})
    return x.groupBy("event_type").agg(F.sum(F.when(F.col("r") <= 0.01, F.col("m")).otherwise(0)).alias("n_top"), r6(F.sum(F.when(F.col("r") <= 0.01, F.col("q")).otherwise(0.0)) / F.sum("q")).alias("share"))


def trial_means(spark, d):
    x = windows.with_baseline(_aligned(spark, d), TRACE).filter("f0 is not null")
    return x.groupBy("recording_id").agg(F.count_distinct("trial_id").alias("trials"), F.round(F.avg(F.abs("value")), 9).alias("mean_abs"), r6(F.avg(F.log("f0"))).alias("mean_log_f0"))


def qc_flags(spark, d):
    t = trials(spark, d)
    n = series(spark, d).groupBy("recording_id").agg(F.max("frame").alias("last"))
    flags = F.array_compact(F.array(F.when(F.col("same_frame") > 1, "same_frame"), F.when(F.col("stim_frame") < 10, "short_pre"), F.when(F.col("stim_frame") + 59 > F.col("last"), "short_post"), F.when(F.col("next_stim_frame") - F.col("stim_frame") < 3, "next_soon"), F.when(F.col("previous_trial_id").isNull(), "first")))
    return t.join(n, "recording_id").select("trial_id", F.size(flags).alias("n_flags"), F.array_join(flags, ",").alias("flags"))


def flag_counts(spark, d):
    return qc_flags(spark, d).select(F.explode(F.split("flags", ",")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def sufficient_statistics(spark, d):
    """Sums of outer products of a short design (1, offset, dff one before) per recording, as long rows."""
    w = Window.partitionBy("trial_id").orderBy("offset")
    x = _dff(spark, d).filter("offset >= 2 and dff_valid").withColumn("lagged", F.coalesce(F.lag("dff").over(w), F.lit(0.0)))
    cols = [F.lit(1.0), F.col("offset").cast("double"), F.col("lagged"), F.col("dff")]
    sums = {(i, j): F.sum(cols[i] * cols[j]) for i in range(3) for j in range(i, 4)}  # one pass, a row per recording and task
    one = x.groupBy("recording_id").agg(*[v.alias(f"s{i}{j}") for (i, j), v in sums.items()])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(f"s{i}{j}", 5).alias("value")) for i, j in sums])
    return one.select("recording_id", F.inline(cells))


def indicator_kernel(spark, d):
    """A difference of exponentials, normalised to its peak, and the saturating readout, at all frames."""
    rise, decay, top = 0.5, 3.0, 0.8
    tp = rise * decay / (decay - rise) * math.log(decay / rise)
    peak = math.exp(-tp / decay) - math.exp(-tp / rise)
    t = series(spark, d).select("frame").distinct()
    k = (F.exp(-F.col("frame") / decay) - F.exp(-F.col("frame") / rise)) / peak
    return t.select("frame", F.round(k, 9).alias("kernel"), F.round(k / (1 + F.abs(k) / top), 9).alias("readout"))


def _kernel_sql() -> str:
    rise, decay, top = 0.5, 3.0, 0.8
    tp = rise * decay / (decay - rise) * math.log(decay / rise)
    peak = math.exp(-tp / decay) - math.exp(-tp / rise)
    k = f"((exp(-frame / {decay}) - exp(-frame / {rise})) / {peak!r})"
    return with_series(f"SELECT DISTINCT frame, round({k}, 9) AS kernel, round({k} / (1 + abs({k}) / {top}), 9) AS readout FROM series")


def quantile_summary(spark, d):
    o = read(spark, d, "orders")
    at = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}
    x = tables.quantiles(o, "o_orderpriority", "o_totalprice", at)
    return x.select("o_orderpriority", "n", *[r6(k).alias(k) for k in at])


def strata(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").count()
    c = F.col("count")
    return n.agg(F.count_if(c == 1).alias("one"), F.count_if(c == 2).alias("two"), F.count_if(c.between(3, 4)).alias("three_four"), F.count_if(c.between(5, 9)).alias("five_nine"), F.count_if(c >= 10).alias("ten_up"))


EXTENT = with_series("SELECT trial_id, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid, min(o) AS first_offset, max(o) AS last_offset FROM win GROUP BY trial_id")

QUERIES = {
    "trial_schedule": (trial_schedule, with_series("SELECT trial_id, stim_index, stim_frame, next_stim_frame, previous_trial_id, stim_frame - previous_stim_frame AS since_previous, same_frame FROM trials")),
    "event_windows": (event_windows, EXTENT),
    "laid_out_windows": (laid_out_windows, EXTENT),
    "window_baseline_dff": (window_baseline_dff, with_series("SELECT trial_id, n_base, round(f0, 6) AS f0, round(pre_sd, 6) AS pre_sd FROM base")),
    "dff_samples": (dff_samples, with_series("SELECT trial_id, o AS \"offset\", round(dff, 6) AS dff, ok AS dff_valid FROM dff")),
    "response_amplitude": (response_amplitude, with_series("SELECT trial_id, round(amplitude, 6) AS amplitude, n_response FROM amp")),
    "artifact_profile": (artifact_profile, with_series("SELECT event_index % 4 = recording_id % 5 AS is_target, o AS \"offset\", count(*) AS n, round(avg((value - f0) / f0), 6) AS mean_dff FROM win JOIN base USING (trial_id) WHERE valid AND f0 IS NOT NULL AND o BETWEEN -3 AND 4 GROUP BY ALL")),
    "pair_coverage": (pair_coverage, with_series(PAIRS + """, one AS (SELECT target, responder, animal, avg(amplitude) AS m, count(*) AS n, sum(amplitude) AS s, sum(amplitude * amplitude) AS q FROM pairs WHERE amplitude IS NOT NULL AND target <> responder GROUP BY ALL),
two AS (SELECT target, responder, sum(n) AS n, count(*) AS a, sum(s) / sum(n) AS mean, CASE WHEN sum(n) > 1 THEN sqrt(greatest((sum(q) - sum(s) * sum(s) / sum(n)) / nullif(sum(n) - 1, 0), 0.0)) END AS sd, stddev_samp(m) AS b FROM one GROUP BY ALL)
SELECT target, responder, CAST(n AS BIGINT) AS n_trials, a AS n_animals, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean / nullif(sd / sqrt(n), 0.0), 6) AS t, round(b, 6) AS between_sd FROM two""")),
    "pair_variance": (pair_variance, with_series(PAIRS + """, one AS (SELECT target, responder, animal, count(*) AS n, avg(amplitude) AS m, var_pop(amplitude) AS v FROM pairs WHERE amplitude IS NOT NULL AND target <> responder GROUP BY ALL),
two AS (SELECT target, responder, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS w, greatest(sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n), 0.0) AS b, sum(n * n) AS nn FROM one GROUP BY ALL),
three AS (SELECT *, sqrt((w + b) / nullif(n - 1, 0)) AS sd, CASE WHEN k > 1 THEN w / nullif(n - k, 0) END AS within, (n - nn / n) / nullif(k - 1, 0) AS size FROM two)
SELECT target, responder, n AS n_trials, k AS n_animals, round(sd, 6) AS sd, round(mean / nullif(sd / sqrt(n), 0.0), 6) AS t, round(within, 6) AS within, round(CASE WHEN within IS NOT NULL THEN greatest((b / nullif(k - 1, 0) - within) / size, 0.0) END, 6) AS "between" FROM three""")),
    "target_eligibility": (target_eligibility, with_series(PAIRS + """, p AS (SELECT * FROM pairs WHERE amplitude IS NOT NULL),
x AS (SELECT target, count(DISTINCT animal) FILTER (WHERE target = responder) AS n_auto, (SELECT count(*) FROM (SELECT responder FROM p q WHERE q.target = p.target AND q.target <> q.responder GROUP BY responder HAVING count(DISTINCT animal) >= 2)) AS n_resp FROM p GROUP BY target)
SELECT target, n_auto, n_resp, n_auto >= 3 AND n_resp >= 2 AS eligible, concat_ws(',', CASE WHEN n_auto < 3 THEN 'autoresponse' END, CASE WHEN n_resp < 2 THEN 'responders' END) AS reasons FROM x""")),
    "variance_components": (variance_components, with_series(""", by_r AS (SELECT recording_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM series WHERE valid GROUP BY recording_id),
tot AS (SELECT sum(n) AS nt, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS ssw, sum(n * n) AS nn FROM by_r),
z AS (SELECT any_value(nt) AS nt, any_value(k) AS k, any_value(ssw) AS ssw, any_value(nn) AS nn, sum(n * (m - mean) * (m - mean)) AS ssb FROM by_r CROSS JOIN tot)
SELECT CAST(nt AS BIGINT) AS n, k AS groups, round(ssw / nullif(nt - k, 0), 6) AS within, round(greatest((ssb / nullif(k - 1, 0) - ssw / nullif(nt - k, 0)) / ((nt - nn / nt) / nullif(k - 1, 0)), 0.0), 6) AS between FROM z""")),
    "per_group_slope": (per_group_slope, with_series("SELECT recording_id, count(*) AS n, round(regr_slope(value, frame), 6) AS slope FROM series WHERE valid GROUP BY recording_id HAVING count(*) >= 5 AND max(frame) > min(frame)")),
    "pre_slope": (pre_slope, with_series("SELECT trial_id, count(*) FILTER (WHERE ok) AS n, round(CASE WHEN count(*) FILTER (WHERE ok) >= 3 THEN coalesce(regr_slope(CASE WHEN ok THEN dff END, CASE WHEN ok THEN o END), 0.0) ELSE 0.0 END, 6) AS slope FROM dff WHERE o < 0 GROUP BY trial_id")),
    "previous_valid": (previous_valid, with_series("SELECT recording_id, frame, last_value(CASE WHEN valid THEN value END IGNORE NULLS) OVER w AS prev_value, frame - last_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER w AS gap FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")),
    "fill_down": (fill_down, with_series("SELECT recording_id, frame, last_value(CASE WHEN event_type = 'signup' THEN event_index END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY frame) AS filled, event_type <> 'signup' AS filled_from_above FROM series")),
    "interp_gaps": (interp_gaps, with_series(""", x AS (SELECT recording_id, frame, last_value(v IGNORE NULLS) OVER b AS v0, last_value(p IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(p IGNORE NULLS) OVER a AS p1
 FROM (SELECT *, CASE WHEN valid THEN value END AS v, CASE WHEN valid THEN frame END AS p FROM series)
 WINDOW b AS (PARTITION BY recording_id ORDER BY frame), a AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT recording_id, frame, round(coalesce(v0 + (v1 - v0) * (frame - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS interp FROM x""")),
    "ar1_nll_gaussian": (ar1_nll_gaussian, with_series(_GAPS + f"SELECT trial_id, count(*) AS n, round(sum(0.5 * ({math.log(2 * math.pi)!r} + ln(v) + e * e / v)), 6) AS nll FROM e GROUP BY trial_id")),
    "ar1_nll_student": (ar1_nll_student, with_series(_GAPS + f"SELECT trial_id, count(*) AS n, round(sum({math.lgamma(2) - math.lgamma(2.5) + 0.5 * math.log(4 * math.pi)!r} + 0.5 * ln(v) + 2.5 * ln(1 + e * e / (4.0 * v))), 6) AS nll FROM e GROUP BY trial_id")),
    "per_animal_nll": (per_animal_nll, with_series(_GAPS + f"SELECT CAST(split_part(trial_id, ':', 1) AS BIGINT) AS recording_id, count(DISTINCT trial_id) AS traces, count(*) AS samples, round(sum(0.5 * ({math.log(2 * math.pi)!r} + ln(v) + e * e / v)), 6) AS nll FROM e GROUP BY 1")),
    "whiten": (whiten, with_series(f"SELECT recording_id, frame, round(CASE WHEN lag(value) OVER w IS NULL THEN value ELSE (value - {PHI} * lag(value) OVER w) / {math.sqrt(1 - PHI * PHI)!r} END, 6) AS z FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY frame)")),
    "whitened_kl": (whitened_kl, with_series(f", z AS (SELECT recording_id, CASE WHEN lag(value) OVER w IS NULL THEN value ELSE (value - {PHI} * lag(value) OVER w) / {math.sqrt(1 - PHI * PHI)!r} END AS z FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY frame)) SELECT recording_id, round(0.5 * sum(z * z), 2) AS kl FROM z GROUP BY recording_id")),
    "block_means": (block_means, with_series("SELECT recording_id, CAST(floor(frame / 5) AS BIGINT) AS block, count(*) AS n, round(avg(value), 6) AS mean FROM series WHERE valid GROUP BY ALL")),
    "block_variance": (block_variance, with_series(f"SELECT a.recording_id, a.frame // 5 AS block, round(sum(pow({PHI}, abs(a.frame - b.frame))) / count(*), 9) AS var_of_mean FROM series a JOIN series b ON a.recording_id = b.recording_id AND a.frame // 5 = b.frame // 5 WHERE a.valid AND b.valid GROUP BY ALL")),
    "peak_halfdecay": (peak_halfdecay, with_series(""", top AS (SELECT trial_id, max(dff) AS peak FROM dff WHERE ok AND o BETWEEN 0 AND 19 GROUP BY trial_id),
lat AS (SELECT t.trial_id, t.peak, min(x.o) AS latency FROM top t JOIN dff x ON x.trial_id = t.trial_id AND x.ok AND x.o BETWEEN 0 AND 19 AND x.dff = t.peak GROUP BY ALL)
SELECT l.trial_id, round(peak, 6) AS peak, latency, min(o) FILTER (WHERE o <= latency AND dff >= 0.5 * peak) AS half_rise, min(o) FILTER (WHERE o > latency AND dff <= 0.5 * peak) - latency AS half_decay FROM lat l JOIN dff x ON x.trial_id = l.trial_id AND x.ok AND x.o >= 0 GROUP BY l.trial_id, peak, latency""")),
    "convolve_basis": (convolve_basis, with_series(_TENTS + ", c AS (SELECT u.recording_id, u.frame + t.lag AS frame, t.k, sum(t.weight) AS x FROM series u CROSS JOIN tents t WHERE u.event_type = 'error' GROUP BY ALL) SELECT s.recording_id, s.frame, CAST(k.k AS BIGINT) AS k, round(coalesce(c.x, 0.0), 6) AS x FROM series s CROSS JOIN (SELECT DISTINCT k FROM tents) k LEFT JOIN c ON c.recording_id = s.recording_id AND c.frame = s.frame AND c.k = k.k")),
    "autoresponse_frames": (autoresponse_frames, with_series("SELECT t.trial_id, count(*) AS n, min(frame) AS first, max(frame) AS last, round(avg(value) FILTER (WHERE valid), 6) AS mean FROM trials t JOIN series s ON s.recording_id = t.recording_id AND frame >= previous_stim_frame AND frame < next_stim_frame GROUP BY t.trial_id")),
    "interval_coverage": (interval_coverage, with_series(", m AS (SELECT recording_id, avg(value) AS m, stddev_samp(value) AS s FROM series GROUP BY recording_id) SELECT recording_id, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN abs((value - m) / s) <= {q!r} THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS {k}" for k, q in LEVELS.items()) + " FROM series JOIN m USING (recording_id) WHERE s > 0 GROUP BY recording_id")),
    "segment_autocorr": (segment_autocorr, with_series(", seg AS (SELECT recording_id, trial_id, avg(value) AS m FROM win WHERE o BETWEEN -10 AND -2 GROUP BY ALL HAVING count(*) = 9 AND count(*) FILTER (WHERE valid) = 9), c AS (SELECT recording_id, trial_id, o, value - m AS c FROM win JOIN seg USING (recording_id, trial_id) WHERE o BETWEEN -10 AND -2), p AS (SELECT *, lag(c) OVER (PARTITION BY trial_id ORDER BY o) AS p FROM c) SELECT recording_id, count(*) FILTER (WHERE p IS NULL) AS segments, count(p) AS pairs, round(sum(c * p) / nullif(sum(c * c), 0.0), 6) AS lag1 FROM p GROUP BY recording_id")),
    "run_autocorr": (run_autocorr, with_series(_RUNS + ", m AS (SELECT recording_id, run, avg(value) AS m FROM runs GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT recording_id, run, frame, value - m AS c FROM runs JOIN m USING (recording_id, run)), p AS (SELECT *, lag(c) OVER (PARTITION BY recording_id, run ORDER BY frame) AS p FROM c) SELECT recording_id, count(*) FILTER (WHERE p IS NULL) AS segments, count(p) AS pairs, round(sum(c * p) / nullif(sum(c * c), 0.0), 6) AS lag1 FROM p GROUP BY recording_id")),
    "valid_runs": (valid_runs, with_series(_RUNS + "SELECT recording_id, CAST(run AS BIGINT) AS run, min(frame) AS first, count(*) AS n, round(avg(value), 6) AS mean FROM runs GROUP BY ALL")),
    "leaky_filter": (leaky_filter, with_series(", lags AS (SELECT recording_id, frame + k AS frame, value * exp(-k / 5.0) * CASE WHEN frame = 0 THEN 1.0 ELSE 1 - exp(-0.2) END AS x FROM series CROSS JOIN generate_series(0, 200) g(k)) SELECT s.recording_id, s.frame, round(sum(x), 6) AS filtered FROM series s JOIN lags USING (recording_id, frame) GROUP BY ALL")),
    "tail_diagnostics": (tail_diagnostics, with_series(", m AS (SELECT recording_id, avg(value) AS m, stddev_pop(value) AS s FROM series GROUP BY recording_id), z AS (SELECT frame, (value - m) / s AS z FROM series JOIN m USING (recording_id) WHERE s > 0) SELECT frame // 20 AS time_bin, count(*) AS n, count(*) FILTER (WHERE abs(z) > 2) AS big, round(avg(pow(z, 4.0)) / pow(avg(pow(z, 2.0)), 2.0) - 3, 6) AS kurtosis FROM z GROUP BY 1")),
    "top_share": (top_share, with_series(", r AS (SELECT event_type, value * value AS q, percent_rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS r FROM series) SELECT event_type, count(*) FILTER (WHERE r <= 0.01) AS n_top, round(sum(CASE WHEN r <= 0.01 THEN q ELSE 0.0 END) / sum(q), 6) AS share FROM r GROUP BY event_type")),
    "trial_means": (trial_means, with_series("SELECT recording_id, count(DISTINCT trial_id) AS trials, round(avg(abs(value)), 9) AS mean_abs, round(avg(ln(f0)), 6) AS mean_log_f0 FROM win JOIN base USING (trial_id) WHERE f0 IS NOT NULL GROUP BY recording_id")),
    "qc_flags": (qc_flags, _QC := with_series(""", f AS (SELECT trial_id, concat_ws(',', CASE WHEN same_frame > 1 THEN 'same_frame' END, CASE WHEN stim_frame < 10 THEN 'short_pre' END, CASE WHEN stim_frame + 59 > last THEN 'short_post' END, CASE WHEN next_stim_frame - stim_frame < 3 THEN 'next_soon' END, CASE WHEN previous_trial_id IS NULL THEN 'first' END) AS flags
 FROM trials JOIN (SELECT recording_id, max(frame) AS last FROM series GROUP BY recording_id) USING (recording_id))
SELECT trial_id, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS n_flags, flags FROM f""")),
    "flag_counts": (flag_counts, f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM ({_QC})) WHERE flag <> '' GROUP BY flag"),
    "sufficient_statistics": (sufficient_statistics, with_series(""", x AS (SELECT recording_id, dff AS y, [1.0::DOUBLE, o::DOUBLE, coalesce(lag(dff) OVER (PARTITION BY trial_id ORDER BY o), 0.0), dff] AS x FROM dff WHERE o >= 2 AND ok)
SELECT recording_id, i, j, round(sum(x[i + 1] * x[j + 1]), 5) AS value FROM x, range(3) a(i), range(4) b(j) WHERE i <= j GROUP BY ALL""")),
    "indicator_kernel": (indicator_kernel, _kernel_sql()),
    "quantile_summary": (quantile_summary, "SELECT o_orderpriority, count(*) AS n, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 6) AS \"{k}\"" for q, k in ((0, "min"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (1, "max"))) + " FROM orders GROUP BY o_orderpriority"),
    "strata": (strata, "WITH n AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey) SELECT count(*) FILTER (WHERE c = 1) AS one, count(*) FILTER (WHERE c = 2) AS two, count(*) FILTER (WHERE c BETWEEN 3 AND 4) AS three_four, count(*) FILTER (WHERE c BETWEEN 5 AND 9) AS five_nine, count(*) FILTER (WHERE c >= 10) AS ten_up FROM n"),
}
