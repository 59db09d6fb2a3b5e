"""All registered queries and their SQL, by module."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from pyspark.sql import functions as F

from ..session import ship

MODULES = ("trials", "graphs", "evaluation", "entities", "annotations", "imports", "numeric")


def _wide(run):
    """run with its integers as longs, as SQL engines count."""

    @wraps(run)
    def out(spark, sf_dir):
        ship(spark)
        df = run(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])

    return out


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        for key, (run, text) in import_module(f"{__package__}.{name}").QUERIES.items():
            if key in queries:
                raise ValueError(f"two queries named {key}")
            queries[key] = _wide(run)
            if text:
                sql[key] = text
    return queries, sql
