"""Written tables that cut lineage, and positions in an order that no single task has to hold."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode alone:
    on a cluster nothing else is known to be shared, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trialforge-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted at the end of the process, or by drop_scratch."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def scratch(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back. It survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many scratch tables there are, for drop_scratch."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(n: int = 0) -> None:
    """Delete the scratch tables written since there were n. Frames that read them must be finished."""
    while len(_written) > n:
        _delete(*_written.pop())


def settle(df: DataFrame, n: int) -> DataFrame:
    """df as a scratch table, and all others written since there were n deleted: for a step that is done once df is written."""
    out = scratch(df)
    old, _written[n:] = _written[n:-1], _written[-1:]
    for spark, path in old:
        _delete(spark, path)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done and that nothing refers to: it does so when the driver's
    garbage is collected, which may else come late. Between two large steps of one job."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _at_end() -> None:
    try:
        drop_scratch()
    except Exception:  # the JVM may be gone by now, with nothing left to ask
        _written.clear()


def ordered(rows: DataFrame, keys: list[str], order: list[Column | str], position: str | None = "position", total: str | None = None, least: dict[str, str] | None = None) -> DataFrame:
    """rows with, within each key and in order: position (from 0), total (rows of the key), and for each name in least the
    minimum of that column over all earlier rows (null for the first).

    Rows are range-partitioned by key and order once, so a key of any size is spread over tasks; one row per part and
    key is then added up. The order is fixed in a written table, so that a recomputed part can't shift it. Ties are
    broken by where the rows lie; give a total order for the same result each time.
    """
    least = least or {}
    placed = scratch(rows.orderBy(*keys, *order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    spot = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"__k{i}") for i, k in enumerate(keys)]
    placed = placed.select("*", *spot)
    own = ["__part", *[f"__k{i}" for i in range(len(keys))]]
    parts = placed.groupBy(*own).agg(F.count("*").alias("__n"), *[F.min(c).alias(f"__m_{k}") for k, c in least.items()])
    by = Window.partitionBy(*own[1:])
    before = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__0"), F.sum("__n").over(by).alias("__all"), *[F.min(f"__m_{k}").over(before).alias(f"__b_{k}") for k in least])
    inside = Window.partitionBy(*own).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, own)
    if position:
        out = out.withColumn(position, F.col("__0") + F.coalesce(F.count("*").over(inside), F.lit(0)))
    if total:
        out = out.withColumn(total, F.col("__all"))
    for k, c in least.items():
        out = out.withColumn(k, F.least(F.col(f"__b_{k}"), F.min(c).over(inside)))
    return out.select(*rows.columns, *[c for c in (position, total) if c], *least)


def quantiles(rows: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """key, n and, for each name in at, the quantile of value, linear between the two nearest rows; nulls don't count."""
    x = ordered(rows.filter(F.col(value).isNotNull()).select(key, value), [key], [value], "__p", "__t")
    spot = lambda q: (F.col("__t") - 1) * F.lit(float(q))
    parts = []
    for name, q in at.items():
        lo, up = F.floor(spot(q)), F.ceil(spot(q))
        parts += [F.max(F.when(F.col("__p") == lo, F.col(value))).alias(f"__l_{name}"), F.max(F.when(F.col("__p") == up, F.col(value))).alias(f"__u_{name}")]
    out = x.groupBy(key).agg(F.max("__t").alias("__t"), *parts)
    line = lambda n, q: F.col(f"__l_{n}") + (F.col(f"__u_{n}") - F.col(f"__l_{n}")) * (spot(q) - F.floor(spot(q)))
    return out.select(key, F.col("__t").alias("n"), *[line(n, q).alias(n) for n, q in at.items()])
