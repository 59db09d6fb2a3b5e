"""Tables laid out for the window join: no exchange, the same rows, a long recording over many buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import windows
from trialforge.schemas import schema
from trialforge.sources import layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def save(spark, folder, **tables):
    """Tables as an import writes them; columns that aren't given are null."""
    for name, df in tables.items():
        fields = schema(name)
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        df.write.parquet(f"{folder}/{name}")


def sample_rows(spark, n=2000):
    """A recording that holds nearly all frames, with three regions, and a short one; rows without frame or recording."""
    long = spark.range(n * 3).select(F.lit("a").alias("recording_id"), (F.col("id") % 3).cast("short").alias("roi_index"), F.floor(F.col("id") / 3).cast("int").alias("frame"))
    short = spark.range(40).select(F.lit("b").alias("recording_id"), F.lit(0).cast("short").alias("roi_index"), F.col("id").cast("int").alias("frame"))
    odd = spark.createDataFrame([("a", 0, None), (None, 0, 5), (None, None, None)], "recording_id string, roi_index short, frame int")
    rows = long.union(short).union(odd)
    return rows.withColumns({"gcamp": 50 + 5 * F.sin(F.col("frame") * 0.7 + F.col("roi_index")), "gcamp_valid": F.coalesce(F.col("frame") % 11 != 3, F.lit(False))})


def trial_rows(spark):
    rng = np.random.default_rng(1)
    frames = {"a": sorted({*rng.integers(0, 2000, 40).tolist(), 0, 255, 256, 1999}), "b": [5, 30], "c": [10]}
    rows = [(k, f, i) for k, fs in frames.items() for i, f in enumerate(fs)] + [("a", 700, 90), ("a", 700, 91)]
    return windows.schedule(spark.createDataFrame(rows, "recording_id string, stim_frame int, event_index long"))


def content(df):
    cols = ["trial_id", "roi_index", "frame", "offset", "gcamp"]
    return sorted(map(tuple, df.select(*cols).collect()))


def test_no_exchange_and_the_same_rows(spark, tmp_path):
    trials, samples = trial_rows(spark), sample_rows(spark)
    w, s = layout.lay_out_windows(trials, samples, str(tmp_path / "x"), 7)
    met = windows.align_blocks(w, s)
    assert "Exchange" not in plan(met) and "SortMergeJoin" in plan(met)
    below = plan(met.groupBy("trial_id").count()).split("partial_count", 1)[1]
    assert "Exchange" not in below
    assert content(met) == content(windows.align(trials, samples)) != []


def test_a_long_recording_is_spread_and_rows_are_kept(spark, tmp_path):
    samples = sample_rows(spark, 20_000)
    laid = layout.lay_out(windows.in_blocks(samples), str(tmp_path / "x"), layout.KEYS, ["frame"], 8)
    sizes = [r["count"] for r in laid.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == samples.count() and max(sizes) < 0.3 * sum(sizes)


def test_attached_again(spark, tmp_path):
    path = str(tmp_path / "x")
    w, s = layout.lay_out_windows(trial_rows(spark), sample_rows(spark), path, 5)
    want = content(windows.align_blocks(w, s))
    for name in ("windows", "samples"):  # as in a new session, which knows no such table
        spark.sql(f"DROP TABLE {layout._name(f'{path}/{name}')}")
    met = windows.align_blocks(*(layout.attach(spark, f"{path}/{x}") for x in ("windows", "samples")))
    assert "Exchange" not in plan(met) and content(met) == want
    with pytest.raises(Exception, match="non-empty"):
        layout.lay_out_windows(trial_rows(spark), sample_rows(spark), path, 5)


def test_traces_of_an_import(spark, tmp_path):
    """Every region's dF/F by a plain loop over dense recordings."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    samples = sample_rows(spark, 300).filter("recording_id is not null and frame is not null")
    tried = trial_rows(spark).filter("stim_frame < 300").withColumns({"target_roi_index": F.lit(1), "target_neuron_id": F.lit("X")})
    save(spark, src, trials=tried, observations=samples, neurons=samples.select("recording_id", "roi_index").distinct().filter("roi_index < 2").withColumn("neuron_id", F.concat(F.lit("N"), "roi_index")), animals=spark.createDataFrame([("a", 0.5), ("b", 0.5)], "recording_id string, volume_interval_s double"))
    layout.prepare(spark, src, out, 4)
    got = {(r["trial_id"], r["roi_index"], r["offset"]): r for r in layout.traces(spark, src, out).collect()}
    value = {(r["recording_id"], r["roi_index"], r["frame"]): (r["gcamp"], r["gcamp_valid"]) for r in samples.collect()}
    want = 0
    for t in tried.collect():
        for roi in range(3):
            at = {o: value[t["recording_id"], roi, t["stim_frame"] + o] for o in range(-10, 60) if (t["recording_id"], roi, t["stim_frame"] + o) in value and (o < 0 or t["next_stim_frame"] is None or t["stim_frame"] + o < t["next_stim_frame"])}
            base = [x for o, (x, ok) in at.items() if o < -1 and ok]
            for o, (x, ok) in at.items():
                r, good = got[t["trial_id"], roi, o], ok and o not in (-1, 0, 1) and len(base) >= 4
                assert r["dff_valid"] == good and r["is_target"] == (roi == 1) and r["neuron_id"] == (f"N{roi}" if roi < 2 else None)
                assert r["dff"] == pytest.approx((x / np.mean(base) - 1) if good else 0.0)
                want += 1
    assert want == len(got) > 1000
    save(spark, src + "2", trials=tried, neurons=samples.select("recording_id", "roi_index"), animals=spark.createDataFrame([("a", 0.5), ("b", 0.25)], "recording_id string, volume_interval_s double"))
    with pytest.raises(ValueError, match="one volume interval"):
        layout.analysis_tables(spark, src + "2")


def test_empty_tables(spark, tmp_path):
    w, s = layout.lay_out_windows(trial_rows(spark).limit(0), sample_rows(spark).limit(0), str(tmp_path / "x"), 3)
    assert windows.align_blocks(w, s).count() == 0
