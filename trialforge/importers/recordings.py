"""Exported recordings as normalised tables: observations, neurons, trials, animals and autoresponses.

The exports are read into long frames (recording, frame, ROI); everything after is joins, windows and aggregations on
these keys, so a recording of any length is never in one task. What can't be told from the inputs stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import label_status
from ..schemas import conform
from ..session import ship
from ..sources import readers

#: The data set's name in ids, how recordings are called, codes of targets that are no ROI, members.
DATASET = "randi2023"
NAME = r"^pumpprobe_(\d{8})_(\d{6})$"
CODES = {-1: "not_located", -2: "failed_targeting", -3: "identified_untracked"}
REQUIRED = ("green.txt", "red.txt", "recording.pickle", "fconn.pickle", "targets_manually_located.txt")
OPTIONAL = ("targets_manually_located_comments.txt", "green_matchless.txt", "red_matchless.txt")


def recording_id(name: Column) -> Column:
    return F.concat(F.lit(f"{DATASET}:"), name)


def numbered(recording: Column, what: str, i: Column) -> Column:
    """The id of a recording's ROI or stimulus."""
    return F.format_string(f"%s:{what}%03d", recording, i.cast("int"))


def refuse(bad: Column, message: Column | str, value: Column) -> Column:
    """value, or an error where bad."""
    return F.when(bad, F.raise_error(F.lit(message) if isinstance(message, str) else message)).otherwise(value)


def trace_sources(text: DataFrame, green: DataFrame, matchless: DataFrame) -> DataFrame:
    """recording_id, roi_index, trace_source: the extraction that a ROI's exported trace equals in every frame.

    Inputs are (recording_id, frame, roi_index, value); NaN equals NaN. matched if the main extraction, else matchless;
    a trace that equals neither is an error, and so is one with other frames than the main extraction.
    """
    keys = ["recording_id", "frame", "roi_index"]
    x = text.join(green.withColumnRenamed("value", "g"), keys, "full").join(matchless.withColumnRenamed("value", "m"), keys, "left")
    same = lambda c: F.bool_and(F.coalesce(F.col("value") == F.col(c), F.lit(False)))
    by = x.groupBy("recording_id", "roi_index").agg(same("g").alias("matched"), same("m").alias("matchless"), F.bool_or(F.col("value").isNull() | F.col("g").isNull()).alias("uneven"))
    found = F.when(F.col("matched"), "matched").when(F.col("matchless"), "matchless").otherwise(F.raise_error(F.concat("recording_id", F.lit(": ROI "), F.col("roi_index").cast("string"), F.lit(" equals neither extraction"))))
    return by.select("recording_id", "roi_index", refuse(F.col("uneven"), F.concat("recording_id", F.lit(": extractions of different shape")), found).alias("trace_source"))


def observations(text: DataFrame, red: DataFrame, red_matchless: DataFrame, sources: DataFrame, times: DataFrame) -> DataFrame:
    """One row per ROI and frame: both channels, the red one from the same extraction as the trace, and their validity."""
    keys = ["recording_id", "frame", "roi_index"]
    x = text.withColumnRenamed("value", "gcamp").join(sources, ["recording_id", "roi_index"]).join(times, ["recording_id", "frame"])
    x = x.join(red.withColumnRenamed("value", "r"), keys, "left").join(red_matchless.withColumnRenamed("value", "rm"), keys, "left")
    x = x.withColumn("red", F.when(F.col("trace_source") == "matched", F.col("r")).otherwise(F.col("rm")))
    return x.select("recording_id", "roi_index", "frame", "time_s", "gcamp", "red", (~F.isnan("gcamp")).alias("gcamp_valid"), (~F.isnan("red")).alias("red_valid"))


def neurons(labels: DataFrame) -> DataFrame:
    """Identities of ROIs from (recording_id, roi_index, label, trace_source): a name counts where it is the recording's
    only one."""
    n = F.count("*").over(Window.partitionBy("recording_id", "label"))
    x = labels.withColumn("label", F.coalesce("label", F.lit("")))
    x = x.withColumns({"label_status": label_status(F.col("label")), "label_duplicated": (F.col("label") != "") & (n > 1)})
    known = F.when((F.col("label_status") == "name") & ~F.col("label_duplicated"), F.col("label"))
    return x.select("recording_id", "roi_index", numbered(F.col("recording_id"), "roi", F.col("roi_index")).alias("roi_id"), F.nullif("label", F.lit("")).alias("label"), "label_status", "label_duplicated", known.alias("neuron_id"), "trace_source")


def trials(stimuli: DataFrame, rois: DataFrame, times: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stimuli in time order with their targets and quality flags.

    stimuli: recording_id, event (place in the file), stim_frame, exported (target code), manual (code of the manual
    file, null if that has another number of lines), manual_label, joined (whether acquisition metadata fit). An
    exported -3 without a label gives way to a manual code other than -1 and -3; an exported -2 never does, and is
    flagged where the manual file has a ROI. rois: see neurons(); times: recording_id, frame, time_s; sizes: recording_id, n_frames, n_rois.
    """
    x = stimuli.join(sizes, "recording_id")
    manual, label = F.col("manual"), F.col("manual_label")
    reconciled = (F.col("exported") == -3) & label.isNull() & manual.isNotNull() & ~manual.isin(-1, -3) & (manual < F.col("n_rois"))
    x = x.withColumns({"reconciled": reconciled, "superseded": F.coalesce((F.col("exported") == -2) & (manual >= 0), F.lit(False))})
    x = x.withColumn("code", F.when(F.col("reconciled"), manual).otherwise(F.col("exported")))
    near = rois.select("recording_id", F.col("roi_index").cast("int").alias("code"), F.col("label").alias("roi_label"), "neuron_id")
    x = x.join(near, ["recording_id", "code"], "left").join(times.withColumnRenamed("frame", "stim_frame"), ["recording_id", "stim_frame"])
    start = times.groupBy("recording_id").agg(F.min_by("time_s", "frame").alias("first_s"))
    w = Window.partitionBy("recording_id").orderBy("stim_frame", "event")
    x = x.join(start, "recording_id").withColumns({
        "trial_id": numbered(F.col("recording_id"), "stim", F.col("event")), "rank": F.row_number().over(w) - 1, "same_frame": F.count("*").over(Window.partitionBy("recording_id", "stim_frame")),
        "target_label": F.when(F.col("code") >= 0, F.col("roi_label")).when(F.col("code") == -3, label),
    })
    x = x.withColumns({"next_stim_frame": F.lead("stim_frame").over(w), "previous_stim_frame": F.lag("stim_frame").over(w), "previous_trial_id": F.lag("trial_id").over(w), "previous_target_label": F.lag("target_label").over(w), "previous_s": F.lag("time_s").over(w)})
    code = F.when(F.col("code") >= 0, "roi")
    for k, v in CODES.items():
        code = code.when(F.col("code") == k, v)
    flag = lambda on, name: F.when(on, F.lit(name))
    flags = F.array_compact(F.array(
        F.when(F.col("code") < 0, F.concat(F.lit("target_"), code)), flag(F.col("same_frame") > 1, "duplicate_stim_frame"), flag(F.col("rank") != F.col("event"), "file_order_differs_from_time_order"),
        flag(F.col("reconciled"), "target_code_reconciled_from_manual_file"), flag(F.col("superseded"), "manual_target_superseded_by_export"), flag(~F.col("joined"), "acquisition_metadata_unjoined"),
    ))
    return x.select(
        "trial_id", F.regexp_replace("recording_id", ":", ":animal:").alias("animal_id"), F.col("recording_id").alias("session_id"), "recording_id", F.col("event").alias("event_index_in_file"), F.col("rank").alias("stim_index_in_recording"),
        "stim_frame", "next_stim_frame", "previous_stim_frame", F.col("time_s").alias("stimulus_start_s"), (F.col("time_s") - F.col("first_s")).alias("time_since_recording_start_s"), code.alias("target_code"), F.col("exported").alias("target_code_exported"),
        F.when(F.col("code") >= 0, F.col("code")).alias("target_roi_index"), "target_label", F.when(F.col("code") >= 0, F.col("neuron_id")).alias("target_neuron_id"), "previous_trial_id", "previous_target_label",
        (F.col("time_s") - F.col("previous_s")).alias("time_since_previous_s"), F.concat("trial_id", F.lit(":optogenetic")).alias("stimulus_id"), "n_frames", flags.alias("trial_qc_flags"),
    )


def autoresponses(tried: DataFrame, observed: DataFrame) -> DataFrame:
    """The stimulated ROI's own trace, from the stimulus before to the one after, for trials whose target is a ROI."""
    x = tried.filter("target_roi_index is not null").select("trial_id", "recording_id", F.col("target_roi_index").alias("roi_index"), "stimulus_start_s", "stim_frame", F.coalesce("previous_stim_frame", F.lit(0)).alias("first"), F.coalesce("next_stim_frame", "n_frames").alias("past"))
    frames = x.filter("past > first").withColumn("frame", F.explode(F.sequence(F.col("first"), F.col("past") - 1)))
    met = frames.join(observed, ["recording_id", "roi_index", "frame"])
    return met.select("trial_id", "frame", (F.col("time_s") - F.col("stimulus_start_s")).alias("time_rel_s"), "gcamp", "red", "gcamp_valid", "red_valid", (F.col("frame") >= F.col("stim_frame")).alias("after"))


def valid_fractions(auto: DataFrame) -> DataFrame:
    """trial_id and the share of valid frames of its own trace from the stimulus on."""
    return auto.filter("after").groupBy("trial_id").agg(F.avg(F.col("gcamp_valid").cast("double")).alias("autoresponse_valid_fraction"))


#: Volumes after a stimulus that a response may use, and the valid share its target's own trace needs.
POST, LEAST_OWN = 60, 0.8


def task_traces(tried: DataFrame, fractions: DataFrame, rois: DataFrame, observed: DataFrame) -> DataFrame:
    """trial_id, roi_index, target, responder: the traces that a task of responses is about.

    The target is a ROI whose own trace is valid often enough; the responder is a ROI with an identity, other than the
    target and of another label, with a valid frame after the stimulus and before the next.
    """
    t = tried.join(fractions.filter(F.col("autoresponse_valid_fraction") >= LEAST_OWN), "trial_id").filter("target_roi_index is not null")
    past = F.least(F.col("stim_frame") + POST, F.coalesce("next_stim_frame", "n_frames"))
    t = t.select("trial_id", "recording_id", "target_roi_index", F.col("target_label").alias("target"), "stim_frame", past.alias("past")).filter("past > stim_frame")
    x = t.join(rois.filter("neuron_id is not null").select("recording_id", "roi_index", F.col("neuron_id").alias("responder")), "recording_id")
    x = x.filter((F.col("roi_index") != F.col("target_roi_index")) & ~F.col("responder").eqNullSafe(F.col("target")))
    frames = x.withColumn("frame", F.explode(F.sequence(F.col("stim_frame"), F.col("past") - 1)))
    seen = frames.join(observed.filter("gcamp_valid").select("recording_id", "roi_index", "frame"), ["recording_id", "roi_index", "frame"])
    return seen.select("trial_id", "roi_index", "target", "responder").distinct()


def animals(sizes: DataFrame) -> DataFrame:
    """One row per recording, from recording_id, n_frames, n_rois, n_stimulations, volume_interval_s."""
    name = F.expr("substring(recording_id, instr(recording_id, ':') + 1)")
    day = F.regexp_extract(name, NAME, 1)
    date = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return sizes.select(F.regexp_replace("recording_id", ":", ":animal:").alias("animal_id"), F.col("recording_id").alias("session_id"), "recording_id", F.lit("wild-type").alias("genotype"), date.alias("acquisition_date"), "n_frames", "n_rois", "n_stimulations", "volume_interval_s", F.array(F.lit("animal_id_assumed_one_recording_per_animal")).alias("quality_flags"))


def acquisition(members: DataFrame) -> DataFrame:
    """recording_id, what ('recording' or 'fconn'), n (volumes or neurons), dt, events, indices and codes, of the pickled
    members (recording_id, member, content): attributes alone, no code of theirs is run."""
    ship(members.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, member, content in zip(*(b.column(c).to_pylist() for c in ("recording_id", "member", "content"))):
                x = readers.load_attributes(content)
                listed = lambda k: [int(v) for v in np.asarray(x.get(k, [])).ravel()]  # noqa: B023, E731
                if member == "recording.pickle":
                    rows.append((name, "recording", int(x["nVolume"]), float(x["Dt"]), int(x.get("optogeneticsN", -1)), [], []))
                else:
                    rows.append((name, "fconn", int(x["n_neurons"]), None, None, listed("stim_indices"), listed("stim_neurons")))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["recording_id", "what", "n", "dt", "events", "indices", "codes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    picked = members.filter(F.col("member").endswith(".pickle")).select("recording_id", "member", "content")
    return picked.mapInArrow(scan, "recording_id string, what string, n long, dt double, events long, indices array<long>, codes array<long>")


def import_recordings(spark: SparkSession, text_dir: str, archive: str) -> dict[str, DataFrame]:
    """The normalised tables of all recordings in text_dir, with what the archive adds; and checks, one row per recording.

    Recordings of the archive that have no text export are left out. Errors: a recording without one of its files or
    members, other shapes, a trace that equals no extraction, a stimulus outside the recording, times that don't rise,
    labels beyond the ROIs that aren't blank.
    """
    readers.recordings(spark, text_dir).select(F.size("files")).collect()  # raises if a file is missing
    files = spark.read.text(f"{text_dir}/*.txt", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(\d+)_(\w+)\.txt$", 1).alias("i"), F.regexp_extract("_metadata.file_name", r"^(\d+)_(\w+)\.txt$", 2).alias("suffix"), "value").filter("i <> ''")
    name = F.element_at(F.split(F.rtrim(F.trim("value"), F.lit("/")), "/"), -1)
    named = files.filter("suffix = 'ds_name'").withColumn("value", F.regexp_replace("value", r"\s+$", "")).select("i", refuse(~name.rlike(NAME), F.concat(F.lit("unexpected recording name "), name), recording_id(name)).alias("recording_id"))
    files = files.join(F.broadcast(named), "i").drop("i")  # one row per recording
    of = lambda suffix: files.filter(F.col("suffix") == suffix)
    lines = lambda suffix: of(suffix).select("recording_id", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), "\r?\n")).alias("at", "t"))
    numbers = lambda suffix, kind: lines(suffix).filter(F.trim("t") != "").select("recording_id", "at", F.trim("t").cast("double").cast(kind).alias("v"))
    members = readers.read_archives(spark, archive, "|".join(f"/{m}$" for m in (*REQUIRED, *OPTIONAL)).replace(".", r"\."))
    members = members.select(recording_id(F.element_at(F.split("folder", "/"), -1)).alias("recording_id"), "member", "content").join(F.broadcast(named.select("recording_id")), "recording_id", "left_semi")
    has = named.join(members.groupBy("recording_id").agg(F.collect_set("member").alias("m")), "recording_id", "left")
    lost = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("m", F.array().cast("array<string>")))
    has.select(refuse(F.size(lost) > 0, F.concat("recording_id", F.lit(" lacks "), F.array_join(lost, ", ")), F.size("m"))).collect()  # one number per recording

    def cells(rows: DataFrame) -> DataFrame:
        found = readers.matrix_cells(rows.select(F.col("recording_id").alias("path"), "value"))
        return found.select(F.col("path").alias("recording_id"), F.col("row").alias("frame"), F.col("col").alias("roi_index"), "value")

    member = lambda m: members.filter(F.col("member") == m).select("recording_id", F.col("content").cast("string").alias("value"))
    text, green, red, green_ml, red_ml = (cells(x) for x in (of("gcamp"), member("green.txt"), member("red.txt"), member("green_matchless.txt"), member("red_matchless.txt")))
    times = numbers("t", "double").select("recording_id", F.col("at").alias("frame"), F.col("v").alias("time_s"))
    rising = F.col("time_s") > F.lag("time_s").over(Window.partitionBy("recording_id").orderBy("frame"))
    times = times.withColumn("time_s", refuse(~F.coalesce(rising, F.lit(True)), "volume times are not strictly increasing", F.col("time_s")))
    meta = acquisition(members)
    sizes = text.groupBy("recording_id").agg((F.max("frame") + 1).cast("long").alias("n_frames"), (F.max("roi_index") + 1).cast("long").alias("n_rois"))
    stamps = numbers("stim_volume_i", "int").select("recording_id", F.col("at").alias("event"), F.col("v").alias("stim_frame"))
    codes = numbers("stim_neurons", "int").select("recording_id", F.col("at").alias("event"), F.col("v").alias("exported"))
    events = stamps.join(codes, ["recording_id", "event"], "full")
    counts = events.groupBy("recording_id").agg(F.count("*").alias("n_stimulations"))
    sizes = sizes.join(counts, "recording_id", "left").fillna(0, ["n_stimulations"])
    sizes = sizes.join(meta.filter("what = 'recording'").select("recording_id", F.col("dt").alias("volume_interval_s"), F.col("events").alias("acquired"), F.col("n").alias("volumes")), "recording_id", "left")
    outside = F.col("stim_frame").isNull() | F.col("exported").isNull() | (F.col("stim_frame") < 0) | (F.col("stim_frame") >= F.col("n_frames")) | (F.col("exported") < -3) | (F.col("exported") >= F.col("n_rois"))
    events = events.join(sizes, "recording_id").withColumn("stim_frame", refuse(outside, "a stimulus is outside the recording, or has no target code", F.col("stim_frame")))
    numbered_lines = lambda m: member(m).select("recording_id", F.filter(F.split(F.regexp_replace("value", r"\n$", ""), "\n"), lambda s: ~s.startswith("#") if "comments" not in m else F.lit(True)).alias("l"))
    manual = numbered_lines("targets_manually_located.txt").join(counts, "recording_id").filter("size(l) = n_stimulations").select("recording_id", F.posexplode("l").alias("event", "t")).select("recording_id", "event", F.trim(F.split("t", ":")[0]).cast("int").alias("manual"))
    said = numbered_lines("targets_manually_located_comments.txt").select("recording_id", F.posexplode("l").alias("event", "t"))
    said = said.filter((F.trim(F.split("t", ":")[0]) == "-3") & (F.trim(F.expr("substring(t, instr(t, ':') + 1)")) != "") & F.col("t").contains(":"))
    said = said.select("recording_id", "event", F.trim(F.expr("substring(t, instr(t, ':') + 1)")).alias("manual_label"))
    events = events.join(manual, ["recording_id", "event"], "left").join(said, ["recording_id", "event"], "left")
    stimuli = events.select("recording_id", "event", "stim_frame", "exported", "manual", "manual_label", (F.coalesce("acquired", F.lit(-1)) == F.col("n_stimulations")).alias("joined"))
    written = lines("labels").select("recording_id", F.col("at").alias("roi_index"), F.trim("t").alias("label")).join(sizes.select("recording_id", "n_rois"), "recording_id")
    written = written.withColumn("label", refuse((F.col("roi_index") >= F.col("n_rois")) & (F.col("label") != ""), "labels beyond the ROIs are not blank", F.col("label"))).filter((F.col("roi_index") < F.col("n_rois")) | (F.col("label") != "")).drop("n_rois")
    sources = trace_sources(text, green, green_ml)
    rois = neurons(sources.join(written, ["recording_id", "roi_index"], "left"))
    observed = observations(text, red, red_ml, sources, times)
    tried = trials(stimuli, rois, times, sizes.select("recording_id", "n_frames", "n_rois"))
    auto = autoresponses(tried, observed)
    checks = sizes.join(meta.filter("what = 'fconn'").select("recording_id", F.col("n").alias("fconn_n"), "indices", "codes"), "recording_id", "left")
    listed = events.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event", "stim_frame", "exported"))), lambda e: F.struct(e["stim_frame"].cast("long").alias("f"), e["exported"].cast("long").alias("c"))).alias("e"))
    checks = checks.join(listed, "recording_id", "left").select(
        "recording_id", (F.col("fconn_n") == F.col("n_rois")).alias("fconn_n_neurons_equals_rois"), (F.col("indices") == F.col("e.f")).alias("fconn_stim_indices_equal_text"), (F.col("codes") == F.col("e.c")).alias("fconn_stim_neurons_equal_text"),
        (F.col("volumes") == F.col("n_frames")).alias("recording_n_volumes_equal_frames"), (F.col("acquired") == F.col("n_stimulations")).alias("acquisition_count_matches_events"),
    )
    full = tried.join(valid_fractions(auto), "trial_id", "left")
    out = {"observations": observed, "neurons": rois, "animals": animals(sizes), "autoresponses": auto}
    return {**{k: conform(v, k) for k, v in out.items()}, "trials": full, "checks": checks}
