"""Hash-ordered cross-validation folds over groups, nested, with leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import ordered


def order_key(seed: int, scope: str | Column, group: str) -> Column:
    """Hex sha256 of seed:scope:group."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), scope, F.col(group)), 256)


def kfold(rows: DataFrame, group: str, k: int, seed: int, scope: str) -> DataFrame:
    """group, fold: distinct groups in hash order, every k-th one in a fold."""
    placed = ordered(rows.select(group).distinct(), [], [order_key(seed, scope, group), F.col(group)], "fold")
    return placed.withColumn("fold", (F.col("fold") % k).cast("int"))


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """group, fold: a fold for each group, in order of name."""
    return ordered(rows.select(group).distinct(), [], [F.col(group)], "fold").withColumn("fold", F.col("fold").cast("int"))


def nested(rows: DataFrame, group: str, k: int, inner: int, seed: int, outer: DataFrame | None = None) -> DataFrame:
    """outer, role (train or test), inner fold (null for test), group. outer: group and fold, where they aren't k by hash."""
    outer = kfold(rows, group, k, seed, "outer") if outer is None else outer
    folds = outer.select(F.col("fold").alias("outer")).distinct()
    train = folds.join(outer, F.col("outer") != F.col("fold")).drop("fold")
    scope = F.concat(F.lit("inner"), F.col("outer").cast("string"))
    train = ordered(train.select("outer", group), ["outer"], [order_key(seed, scope, group), F.col(group)], "inner")
    train = train.select("outer", F.lit("train").alias("role"), (F.col("inner") % inner).cast("int").alias("inner"), group)
    test = outer.select(F.col("fold").alias("outer"), F.lit("test").alias("role"), F.lit(None).cast("int").alias("inner"), group)
    return train.unionByName(test)


def best_scheme(rows: DataFrame, group: str) -> DataFrame:
    """group, scheme: the scheme that covers most targets, then the one of fewest folds, then the first by name, from
    (group, scheme, covered, folds)."""
    return rows.groupBy(group).agg(F.min_by("scheme", F.struct((-F.col("covered")).alias("c"), "folds", "scheme")).alias("scheme"))


def leaks(folds: DataFrame, group: str, sessions: DataFrame | None = None) -> dict[str, int]:
    """How many groups are both in train and test of an outer fold, or in two inner folds, and how many sessions span folds."""
    one = folds.groupBy("outer", group).agg(F.count_distinct("role").alias("roles"), F.count_distinct("inner").alias("inners"))
    out = {"train meets test": one.filter("roles > 1").count(), "two inner folds": one.filter("inners > 1").count()}
    if sessions is not None:
        tests = folds.filter("role = 'test'").select(group, "outer")
        out["session spans folds"] = sessions.join(tests, group).groupBy("session").agg(F.count_distinct("outer").alias("n")).filter("n > 1").count()
    return out


def check(folds: DataFrame, group: str, sessions: DataFrame | None = None) -> None:
    """Raise where a split leaks."""
    bad = {k: n for k, n in leaks(folds, group, sessions).items() if n}
    if bad:
        raise ValueError(f"the split leaks: {bad}")
