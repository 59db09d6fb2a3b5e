"""Streams against the same computed at once."""

import math

from pyspark.sql import functions as F

from trialforge.streaming import online


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def events(spark, sf, tmp_path, parts=3):
    e = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(parts):
        e.filter(F.floor(F.col("event_id") * parts / 1000) == k).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))


def test_windows(spark, sf, tmp_path):
    e, stream = events(spark, sf, tmp_path)
    got = drain(spark, online.windowed_counts(stream, "1000 days", "1 hour"), "w1", "complete").collect()
    want = e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()
    assert {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in got} == {(r.w.start, r.event_type): (r.n, round(r.t, 6)) for r in want}


def test_state_survives_batches(spark, sf, tmp_path):
    e, stream = events(spark, sf, tmp_path)
    got = {r.event_id: (r.filtered, r.delayed) for r in drain(spark, online.leaky_history(stream), "w2").collect()}
    by = {}
    for r in e.orderBy("event_id").collect():
        by.setdefault(r.user_id, []).append(r)
    keep, want = math.exp(-1 / 5.0), {}
    for rows in by.values():
        now, past = rows[0].value, []
        for r in rows:
            now = r.value + (now - r.value) * keep
            past.append(now)
            want[r.event_id] = (now, past[-4] if len(past) > 3 else rows[0].value)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
