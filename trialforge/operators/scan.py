"""Segmented scans: what a row takes from all rows before or behind it in its series, however long the series is.

A series is cut into blocks of its order. A block is summed up in one row, the blocks of a series are scanned (one row a
block), and what reaches a block from outside travels to it as a row of its own that sorts before, or behind, all others.
So the rows are dealt by series and block, once, and a hot series is spread over tasks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import ordered

#: Values of the order in one block.
BLOCK = 4096
WHOLE = ("tinyint", "smallint", "int", "bigint")


def numbered(rows: DataFrame, keys: list[str], order: list[str], size: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(rows with __block, the order within it). Blocks are ranges of the first column of order where that is a whole
    number, else of the row's place in its series."""
    if dict(rows.dtypes)[order[0]] not in WHOLE:
        rows, order = ordered(rows, keys, order, "__place"), ["__place"]
    return rows.withColumn("__block", F.floor(F.col(order[0]) / size)), order


def scan(rows: DataFrame, keys: list[str], order: list[str], past: dict[str, Column] | None = None, future: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, size: int = BLOCK) -> DataFrame:
    """rows and, for each name in past, the latest value of its column that isn't null in the rows before (null: none);
    in future, the nearest such value in the rows behind; in sums, the sum of its column over the rows before (0 at first).

    Rows of a series (keys; nulls are one value) are in order, nulls first; give a total order for the same result each
    time. Repeated rows are rows. Columns keep their names; those named must be new. Empty table: empty result.
    """
    past, future, sums = past or {}, future or {}, sums or {}
    if taken := {*past, *future, *sums} & set(rows.columns):
        raise ValueError(f"columns must be renamed first: {', '.join(sorted(taken))}")
    kept = rows.columns
    placed, order = numbered(rows, keys, order, size)
    placed = placed.select("*", F.lit(1).alias("__side"), *[c.alias(f"__p_{k}") for k, c in past.items()], *[c.alias(f"__f_{k}") for k, c in future.items()], *[c.alias(f"__s_{k}") for k, c in sums.items()])
    place = F.struct(*order)
    at = lambda c: F.when(F.col(c).isNotNull(), place)
    totals = [
        *[F.max_by(f"__p_{k}", at(f"__p_{k}")).alias(f"__p_{k}") for k in past],
        *[F.min_by(f"__f_{k}", at(f"__f_{k}")).alias(f"__f_{k}") for k in future],
        *[F.sum(f"__s_{k}").alias(f"__s_{k}") for k in sums],
    ]
    blocks = placed.groupBy(*keys, "__block").agg(*totals)
    up = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    both = placed
    if past or sums:
        before = blocks.select(*keys, "__block", F.lit(0).alias("__side"), *[F.last(f"__p_{k}", True).over(up).alias(f"__p_{k}") for k in past], *[F.sum(f"__s_{k}").over(up).alias(f"__s_{k}") for k in sums])
        both = both.unionByName(before, allowMissingColumns=True)
    if future:
        behind = blocks.select(*keys, "__block", F.lit(2).alias("__side"), *[F.last(f"__f_{k}", True).over(down).alias(f"__f_{k}") for k in future])
        both = both.unionByName(behind, allowMissingColumns=True)
    own = Window.partitionBy(*keys, "__block")
    ahead = own.orderBy("__side", *order).rowsBetween(Window.unboundedPreceding, -1)
    back = own.orderBy(F.desc("__side"), *[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = {
        **{k: F.last(f"__p_{k}", True).over(ahead) for k in past},
        **{k: F.last(f"__f_{k}", True).over(back) for k in future},
        **{k: F.coalesce(F.sum(f"__s_{k}").over(ahead), F.lit(0)) for k in sums},
    }
    return both.withColumns(found).filter("__side = 1").select(*kept, *found)


def runs(rows: DataFrame, keys: list[str], order: str, valid: Column, name: str = "run") -> DataFrame:
    """rows and name: the number of the run of valid samples with consecutive orders that a row is in, from 1 in its series;
    null for rows that aren't valid. Numbers rise along the series."""
    good = F.coalesce(valid, F.lit(False))
    seen = scan(rows, keys, [order], past={"__last": F.struct(F.col(order).alias("at"), good.alias("good"))})
    begins = good & ~F.coalesce(F.col("__last.good") & (F.col("__last.at") == F.col(order) - 1), F.lit(False))
    out = scan(seen.withColumn("__new", begins.cast("long")), keys, [order], sums={name: F.col("__new")})
    return out.withColumn(name, F.when(good, F.col(name) + F.col("__new"))).drop("__last", "__new")


def leaky(rows: DataFrame, keys: list[str], order: list[str], value: str, tau: float, name: str = "filtered") -> DataFrame:
    """rows and name: y = x + (y of the row before - x) exp(-1 / tau), the first row's y its x.

    Within a block the recursion is a sum of powers; a block as a whole maps the value that reaches it to a * y + b, and
    these maps are applied one after the other, a few numbers a block. Values must not be null.
    """
    keep = math.exp(-1 / tau)
    size = max(1, min(BLOCK, int(200 * tau)))  # keep ** -size stays a double
    kept = rows.columns
    placed, order = numbered(rows, keys, order, BLOCK if size == BLOCK else size)
    own = Window.partitionBy(*keys, "__block").orderBy(*order)
    placed = placed.withColumn("__i", F.row_number().over(own) - 1)
    share = F.floor(F.col("__i") / size)  # ties or a dense order can put more rows into a block than its powers allow
    placed = placed.withColumn("__sub", share).withColumn("__i", F.col("__i") - share * size)
    inner = Window.partitionBy(*keys, "__block", "__sub").orderBy(*order)
    power = lambda n: F.pow(F.lit(keep), n)
    scaled = F.sum(F.col(value) * (1 - keep) * power(-F.col("__i"))).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("__z", power(F.col("__i")) * scaled)
    blocks = placed.groupBy(*keys, "__block", "__sub").agg(F.max_by("__z", "__i").alias("b"), F.count("*").alias("n"), F.min_by(value, "__i").cast("double").alias("x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)

    def carry(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["__block", "__sub"])
        now, out = float(p["x"].iloc[0]), []
        for b, n in zip(p["b"], p["n"]):
            out.append(now)
            now = now * keep ** int(n) + b
        return p[[*keys, "__block", "__sub"]].assign(carry=out)

    carried = blocks.groupBy(*keys).applyInPandas(carry, f"{kinds}, __block bigint, __sub bigint, carry double")
    carried = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__kb"), F.col("__sub").alias("__ks"), "carry")
    same = (F.col("__block") == F.col("__kb")) & (F.col("__sub") == F.col("__ks"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = placed.join(carried, same)
    return out.select(*kept, (F.col("__z") + power(F.col("__i") + 1) * F.col("carry")).alias(name))
