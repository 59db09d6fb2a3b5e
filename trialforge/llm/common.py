"""Helpers shared by the corpus operators: table access, word pattern, scratch tables and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import drop_scratch, mark, scratch, settle  # noqa: F401

#: Fixed by the contracts: a word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark's reader touches the path, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def of(value: str, field: str | None = None) -> Callable[[Column], Column]:
    """Predicate for F.filter over an array: the element, or its field, equals value."""
    return lambda x: (x[field] if field else x) == value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: in a lambda, an outer expression is computed at every call."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column, chunk: int = 256) -> Column:
    """For each element of an array of longs, step folded over all earlier ones.

    An array can't be appended to in place, so the folds are over chunks of an array, then over the chunks' totals:
    a million elements take some millions of copies, not the square.
    """
    none = F.array().cast("array<bigint>")

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, F.struct(zero.alias("at"), none.alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / chunk).cast("int") - 1, F.lit(0)))
        parts = F.transform(starts, lambda i: fold(F.slice(xs, i * chunk + 1, chunk)))
        return let(parts, lambda p: F.flatten(F.zip_with(p, fold(F.transform(p, lambda c: c["at"]))["out"], lambda c, o: F.transform(c["out"], lambda v: step(o, v)))))

    return let(values, whole)


def pieces(text: Column, size: int = 4096) -> Column:
    """The text in pieces of size code points, the last shorter: places in it are then found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column, size: int = 4096) -> Column:
    """Code points start (from 0) up to end of a text that pieces() cut."""
    i, j = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    at = lambda k: F.coalesce(F.get(cut, k), F.lit(""))
    a, b = (start % size).cast("int"), (end % size).cast("int")
    inside = F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(i == j, F.substring(at(i), a + 1, b - a)).otherwise(F.concat(F.substring(at(i), a + 1, F.lit(size)), inside, F.substring(at(j), F.lit(1), b)))


#: Tables of ids (16 bytes a row) of at most so many rows are broadcast, after a count; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, broadcast if they count at most so many; rows must be a scratch table, cheap to count."""
    return F.broadcast(rows) if rows.count() <= most else rows


def global_prefix(df: DataFrame, order: Sequence[Column], rank: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Add rank (from 0) in the total order, and for each name in sums the sum of that column over all earlier rows.

    Rows are range-partitioned and sorted once; only one row per partition meets in one task. The positions are
    fixed in a scratch table, so a recomputed partition can't shift them.
    """
    sums = sums or {}
    n = F.monotonically_increasing_id()
    placed = scratch(df.orderBy(*order).withColumn("__at", n)).withColumn("__part", F.shiftright("__at", 33))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ["__n", *[f"__s_{k}" for k in sums]]])
    out = placed.join(F.broadcast(offsets), "__part")  # one row per shuffle partition
    out = out.withColumn(rank, F.col("__n_0") + F.coalesce(F.count("*").over(inside), F.lit(0)))
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"__s_{k}_0") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.select(*df.columns, rank, *sums)
