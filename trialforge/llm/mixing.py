"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_prefix, scratch, table, word_count

#: Bits of the fixed-point fraction of expected copies; positions stay exact integers up to 2**33 documents a source.
BITS = 28
#: Rows whose doc_id agree beyond this many low bits are ranked together; no group of ids outgrows 2**BLOCK_BITS.
BLOCK_BITS = 12
NO_BLOCK = -(1 << 63)
OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Targets per source, from (source, source_size), one row each.

    Sources in code point order, null last, weigh weights in turn. share of all sizes is dealt by weight; a source
    stops at cap times its size and the excess is dealt again among the rest. That ends at min(cap * size, level *
    weight) with one common level, which prefix sums in the order of cap * size / weight find without iteration.
    Empty sources get 0.
    """
    ranked = global_prefix(sizes, [F.col("source").asc_nulls_last()], "rank")
    cases = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", cases.cast("long").alias("w"), (F.col("source_size") * cap).alias("most"))
    filled = global_prefix(ranked, [F.col("most") / F.col("w"), F.col("source").asc_nulls_last()], "at", {"most_0": "most", "w_0": "w"})
    totals = filled.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (F.col("all_size") * F.lit(float(share)) - F.col("most_0")) / (F.col("all_w") - F.col("w_0"))
    steps = filled.crossJoin(F.broadcast(totals)).withColumn("level", level)  # totals: one row
    free = steps.filter(F.col("level") * F.col("w") <= F.col("most")).agg(F.min_by("level", "at").alias("level"))
    target = F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("w")), F.col("most").cast("double"))
    return filled.crossJoin(F.broadcast(free)).select("source", "source_size", target.alias("target"))


def systematic_mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 20240607) -> DataFrame:
    """Decide how many copies of each document the mix takes.

    Within a source, documents are ordered by size, then doc_id; each adds target / source_size expected copies to a
    running sum that starts at one random offset, and is taken once for each integer the sum crosses. The order by
    size makes the sample even over short and long texts, so the words taken come within about one document of the
    target. Positions are integers of 2**-28 copies, so reruns agree and no document exceeds cap copies.

    Returns docs' columns and size, source_size, target, copies, taken; columns of docs by these names are replaced.
    Null text: size 0. Null source: one source, last. Null doc_id: ranked first. Equal rows are ranked one by one.
    doc_id must be a whole number. Empty table: empty result. A hot source is split by size and blocks of doc_id: no task gets it whole.
    """
    keys = ["__source", "__none", "__size", "__block"]  # without nulls, so that windows and joins share one dealing
    source, block = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BLOCK_BITS), F.lit(NO_BLOCK))
    rows = docs.drop(*OUTPUTS).withColumns({"__source": source, "__none": F.col("source").isNull(), "__size": word_count(F.col("text")), "__block": block, "__tie": F.xxhash64("text")})
    counts = scratch(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    sizes = counts.groupBy("__source", "__none").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size"))
    targets = source_targets(sizes.select(F.when(~F.col("__none"), F.col("__source")).alias("source"), "source_size"), weights, share, cap)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"), "source_size", "target")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_size = counts.groupBy(*keys[:3]).agg(F.sum("__n").alias("__n"))
    by_size = by_size.select(*keys[:3], F.coalesce(F.sum("__n").over(before(*keys[:3])), F.lit(0)).alias("__0"))
    offsets = counts.withColumn("__1", F.coalesce(F.sum("__n").over(before(*keys)), F.lit(0)))
    offsets = offsets.join(by_size, keys[:3]).join(targets, keys[:2]).select(*keys, (F.col("__0") + F.col("__1")).alias("__first"), "source_size", "target")
    inside = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_first(), "__tie")
    out = rows.withColumn("__in", F.row_number().over(inside).cast("long")).join(offsets, keys)
    one = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << BITS))).otherwise(0).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__source"))), 1, BITS // 4), 16, 10).cast("long")
    at = lambda rank: F.shiftright(rank * F.col("__one") + F.col("__start"), BITS)
    rank = F.col("__first") + F.col("__in")
    out = out.withColumns({"__one": one, "__start": start}).withColumn("copies", (at(rank) - at(rank - 1)).cast("long"))
    return out.select(*docs.drop(*OUTPUTS).columns, F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of docs as often as systematic_mix() takes it, with the columns of docs."""
    taken = systematic_mix(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "source"), **options)
    return taken.filter("copies > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")


def op5_systematic_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return systematic_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s
), p AS (
  SELECT *, 2 * source_size AS most, row_number() OVER o AS pos,
    coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_0,
    coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_0,
    sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w
  FROM w WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST)
), v AS (
  SELECT *, (CAST(all_size AS DOUBLE) * 1.5 - CAST(most_0 AS DOUBLE)) / CAST(all_w - w_0 AS DOUBLE) AS level FROM p
), f AS (
  SELECT arg_min(level, pos) AS level FROM v WHERE level * w <= most
), t AS (
  SELECT v.source, v.source_size, coalesce(least(CAST(v.most AS DOUBLE), f.level * v.w), CAST(v.most AS DOUBLE)) AS target FROM v CROSS JOIN f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 268435456) AS BIGINT) ELSE 0 END AS one,
    CAST('0x' || substr(md5('20240607:' || coalesce(d.source, '')), 1, 7) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (((rank * one + start) >> 28) - (((rank - 1) * one + start) >> 28)) * size AS taken,
  ((rank * one + start) >> 28) - (((rank - 1) * one + start) >> 28) AS copies
FROM r
"""
