"""Tables laid out for a join: bucketed by its keys and sorted within, so that the join needs no exchange.

A recording may hold most of all frames, so samples and windows are dealt by (recording, block of frames): a block has
a bounded number of frames, whatever the recording's length. The layout is written once and serves every later join.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..schemas import conform

#: What the layout of samples and that of windows have in common.
KEYS = ["recording_id", "block"]


def lay_out(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """Write df below path, in so many buckets by keys, each one file in order, and return it as attach() does.

    Rows with null keys are kept, in the bucket of null. path must be new and in a store that all executors reach. The
    description, which attach() reads, is written last, so a table without one was never finished.
    """
    spark = df.sparkSession
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, *keys)  # Spark hashes buckets alike, so a task writes one
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", f"{path}/data").saveAsTable(name)
    note = spark.range(1).select(F.lit(buckets).alias("buckets"), F.array(*map(F.lit, keys)).alias("keys"), F.array(*map(F.lit, order)).alias("order"), F.lit(df.schema.json()).alias("schema"))
    note.coalesce(1).write.json(f"{path}/layout")
    return spark.table(name)


def attach(spark: SparkSession, path: str) -> DataFrame:
    """The table that lay_out() wrote below path, in this session or an earlier one, with its buckets known to Spark."""
    from pyspark.sql.types import StructType

    note = spark.read.schema("buckets int, keys array<string>, order array<string>, schema string").json(f"{path}/layout").first()
    name, quoted = _name(path), lambda cs: ", ".join(f"`{c}`" for c in cs)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(note["schema"])))
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the table is external: its files stay
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(note['keys'])}) SORTED BY ({quoted(note['keys'] + note['order'])}) INTO {note['buckets']} BUCKETS LOCATION '{path}/data'")
    return spark.table(name)


def _name(path: str) -> str:
    return f"laid_out_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def lay_out_windows(trials: DataFrame, samples: DataFrame, path: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The windows of trials (a row per block that one touches) and samples, below path/windows and path/samples.

    buckets: by default the session's number of shuffle partitions; set it so that a bucket of samples fits in a task.
    """
    n = buckets or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = lay_out(windows.window_blocks(trials), f"{path}/windows", KEYS, ["stim_frame"], n)
    return w, lay_out(windows.in_blocks(samples), f"{path}/samples", KEYS, ["frame"], n)


def analysis_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """trials, neurons and animals of an import, with their declared columns. Recordings of several volume intervals
    can't share offsets in frames, so they are an error, and so is an import without recordings."""
    out = {name: conform(spark.read.parquet(f"{folder}/{name}"), name) for name in ("trials", "neurons", "animals")}
    found = [r[0] for r in out["animals"].select("volume_interval_s").distinct().limit(3).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError(f"one volume interval is needed, not {sorted(found, key=str)}")
    return out


def prepare(spark: SparkSession, folder: str, out: str, buckets: int | None = None) -> None:
    """Lay out an import's windows and observations below out."""
    trials = analysis_tables(spark, folder)["trials"]
    lay_out_windows(trials, conform(spark.read.parquet(f"{folder}/observations"), "observations"), out, buckets)


def traces(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """trial_id, recording_id, roi_index, neuron_id, target_neuron_id, is_target, offset, dff, dff_valid, f0, pre_sd,
    raw: each region's dF/F around each stimulus, from the tables that prepare() laid out.

    A trace has up to 70 rows; invalid and masked samples are 0 and not valid. raw is dF/F before masking, null where invalid. A region without a row in neurons has no
    neuron_id.
    """
    kept = ["trial_id", "recording_id", "stim_frame", "next_stim_frame", "target_roi_index", "target_neuron_id", "block"]
    w = attach(spark, f"{out}/windows").select(*kept)
    s = attach(spark, f"{out}/samples").select("recording_id", "block", "roi_index", "frame", "gcamp", "gcamp_valid")
    rows = windows.dff(windows.align_blocks(w, s), ["trial_id", "recording_id", "roi_index"], "gcamp", "gcamp_valid")
    who = analysis_tables(spark, folder)["neurons"].select("recording_id", "roi_index", "neuron_id")
    target = F.coalesce(F.col("roi_index") == F.col("target_roi_index"), F.lit(False)).alias("is_target")
    raw = F.when(F.col("gcamp_valid"), F.try_divide(F.col("gcamp") - F.col("f0"), F.col("f0"))).alias("raw")
    return rows.join(who, ["recording_id", "roi_index"], "left").select("trial_id", "recording_id", "roi_index", "neuron_id", "target_neuron_id", target, "offset", "dff", "dff_valid", "f0", "pre_sd", raw)
