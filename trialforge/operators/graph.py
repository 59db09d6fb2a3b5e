"""Typed multigraphs as frames of edges: edits, aggregation, normalisation and one synchronous tick of neighbourhood sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_edges(edges: DataFrame, pairs: DataFrame, a: str, b: str, undirected: bool = False) -> DataFrame:
    """edges without all parallel edges between the pairs (a, b), in either order if undirected."""
    if undirected:
        pairs = pairs.select(a, b).union(pairs.select(F.col(b).alias(a), F.col(a).alias(b)))
    return edges.join(pairs.select(a, b).distinct(), [a, b], "left_anti")


def symmetrise(gap: DataFrame, a: str, b: str) -> DataFrame:
    """gap with the missing reverse of each edge added, and added saying which those are."""
    back = gap.select(*[F.col({a: b, b: a}.get(c, c)).alias(c) for c in gap.columns])
    new = back.join(gap.select(a, b), [a, b], "left_anti")
    return gap.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def aggregate_edges(edges: DataFrame, keys: list[str], weight: str, tags: list[str]) -> DataFrame:
    """Per key: summed weight, raw rows, and the sorted set of each tag."""
    return edges.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.count("*").alias("n_rows"), *[F.array_sort(F.collect_set(t)).alias(t) for t in tags])


def normalise(edges: DataFrame, post: str, weight: str) -> DataFrame:
    """edges with norm: the weight over the largest incoming sum of any node."""
    top = edges.groupBy(post).agg(F.sum(weight).alias("__in")).agg(F.max("__in").alias("__max"))
    return edges.crossJoin(F.broadcast(top)).withColumn("norm", F.col(weight) / F.col("__max")).drop("__max")  # top: one row


def sum_in(edges: DataFrame, states: DataFrame, tick: int, select: str = "all") -> DataFrame:
    """post, value: the weighted sum over incoming chemical edges (pre, post, weight, sign, delay) of the source's value
    at tick - delay, read from states (node, tick, value); before tick 0 it is the value at 0."""
    at = edges.withColumn("tick", F.greatest(F.lit(tick) - F.col("delay"), F.lit(0)))
    met = at.join(states.withColumnRenamed("node", "pre"), ["pre", "tick"])
    term = F.col("weight") * F.col("value")
    parts = {"exc": F.when(F.col("sign") > 0, term), "inh": F.when(F.col("sign") < 0, term), "all": F.when(F.col("sign") > 0, term).when(F.col("sign") < 0, -term)}
    return met.groupBy("post").agg(F.coalesce(F.sum(parts[select]), F.lit(0.0)).alias("value"))


def count_in(edges: DataFrame, states: DataFrame, tick: int, k: Column) -> DataFrame:
    """post, value: how many incoming edges' sources had exactly the value k at tick - delay."""
    at = edges.withColumn("tick", F.greatest(F.lit(tick) - F.col("delay"), F.lit(0)))
    return at.join(states.withColumnRenamed("node", "pre"), ["pre", "tick"]).groupBy("post").agg(F.count_if(F.col("value") == k).alias("value"))


def gap_step(nodes: DataFrame, gap: DataFrame, dt: float, scale: float = 1.0) -> DataFrame:
    """node, next: (w + dt S) / (1 + dt G) from nodes (node, old, w) and undirected junctions (a, b, g)."""
    rows = gap.select(F.col("a").alias("node"), F.col("b").alias("other"), "g").union(gap.select("b", "a", "g"))
    met = rows.join(nodes.select(F.col("node").alias("other"), "old"), "other")
    sums = met.groupBy("node").agg(F.sum(F.col("g") * scale).alias("G"), F.sum(F.col("g") * scale * F.col("old")).alias("S"))
    out = nodes.join(sums, "node", "left").fillna({"G": 0.0, "S": 0.0})
    return out.select("node", ((F.col("w") + dt * F.col("S")) / (1 + dt * F.col("G"))).alias("next"))


def check_graph(nodes: DataFrame, edges: DataFrame, gap: DataFrame) -> DataFrame:
    """problem, n: how many rows break each rule of a graph; no row where none does."""
    known = nodes.select("id")
    rules = [
        nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate id").alias("problem")),
        nodes.filter(~F.col("id").rlike("^[A-Za-z0-9_.:-]{1,64}$")).select(F.lit("bad id").alias("problem")),
        edges.filter("weight is null or isnan(weight) or weight < 0 or weight = double('Infinity')").select(F.lit("bad weight").alias("problem")),
        edges.filter("sign is null or sign not in (1, -1)").select(F.lit("bad sign").alias("problem")),
        edges.filter("delay is null or delay < 0 or delay > 100000").select(F.lit("bad delay").alias("problem")),
        edges.select(F.explode(F.array("pre", "post")).alias("id")).join(known, "id", "left_anti").select(F.lit("unknown endpoint").alias("problem")),
        gap.filter("a = b").select(F.lit("gap self-loop").alias("problem")),
        gap.filter("g is null or isnan(g) or g < 0 or g = double('Infinity')").select(F.lit("bad conductance").alias("problem")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.groupBy("problem").agg(F.count("*").alias("n"))


def connectome(edges: DataFrame, signs: DataFrame, gap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chemical edges summed per (pre, post), signed by signs (missing: excitatory, and said so), normalised by the largest
    incoming sum; junctions as the largest conductance per unordered pair, normalised likewise."""
    chem = edges.groupBy("pre", "post").agg(F.sum("weight").alias("weight"))
    chem = chem.join(signs.select("pre", "post", "sign"), ["pre", "post"], "left").withColumns({"assumed": F.col("sign").isNull(), "sign": F.coalesce("sign", F.lit(1))})
    pairs = gap.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("g").alias("g"))
    both = pairs.select("a", "g").union(pairs.select("b", "g")).groupBy("a").agg(F.sum("g").alias("s")).agg(F.max("s").alias("top"))
    pairs = pairs.crossJoin(F.broadcast(both)).select("a", "b", (F.col("g") / F.col("top")).alias("g"))
    return normalise(chem, "post", "weight"), pairs
