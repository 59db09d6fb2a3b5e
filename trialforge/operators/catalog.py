"""Catalogs of files: verification, pinning, merging with an upstream listing, and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(registry: DataFrame, files: DataFrame) -> DataFrame:
    """path, status from registry (path, bytes, sha256, md5) and files likewise: missing, mismatch by the first check
    that fails (size, sha256, md5), unpinned, ok, or untracked for files that the registry doesn't know."""
    f = files.select("path", F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"), F.col("md5").alias("f_md5"), F.lit(True).alias("there"))
    x = registry.withColumn("known", F.lit(True)).join(f, "path", "full_outer")
    status = (
        F.when(F.col("known").isNull(), "untracked").when(F.col("there").isNull(), "missing").when(F.col("bytes") != F.col("f_bytes"), "mismatch: size")
        .when(F.col("sha256") != F.col("f_sha"), "mismatch: sha256").when(F.col("md5") != F.col("f_md5"), "mismatch: md5").when(F.col("sha256").isNull(), "unpinned").otherwise("ok")
    )
    return x.select("path", status.alias("status"))


def pin(registry: DataFrame, files: DataFrame) -> DataFrame:
    """registry with missing sha256 filled from files where size and md5 don't speak against it; refused says where they do."""
    f = files.select("path", F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha"), F.col("md5").alias("f_md5"))
    x = registry.join(f, "path", "left")
    against = F.coalesce((F.col("bytes") != F.col("f_bytes")) | (F.col("md5") != F.col("f_md5")), F.lit(False))
    return x.select("path", "bytes", "md5", F.when(against, F.col("sha256")).otherwise(F.coalesce("sha256", "f_sha")).alias("sha256"), against.alias("refused"))


def merge(old: DataFrame, new: DataFrame, key: str, value: str, accept: bool = False) -> DataFrame:
    """key, change, value: the catalog after a refresh. Additions apply; changes and removals only where accepted."""
    x = old.select(key, F.col(value).alias("v0"), F.lit(1).alias("in_old")).join(new.select(key, F.col(value).alias("v1"), F.lit(1).alias("in_new")), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("v0").eqNullSafe(F.col("v1")), "same").otherwise("changed")
    value_ = F.when(F.col("in_old").isNull() | F.lit(accept), F.col("v1")).otherwise(F.col("v0"))
    return x.select(key, change.alias("change"), value_.alias("value"))


def select(registry: DataFrame, ids: list[str] | None = None, milestone: str | None = None, everything: bool = False) -> DataFrame:
    """The sources asked for: by id, by milestone (a list column), or all."""
    if everything:
        return registry
    if ids:
        return registry.filter(F.col("id").isin(*ids))
    return registry.filter(F.array_contains("milestones", milestone)) if milestone else registry.filter("required")


def problems(rows: DataFrame, key: str, parent: str, required: list[str], patterns: dict[str, str]) -> DataFrame:
    """problem, n: repeated keys, missing required fields, fields that don't match, and parents that don't exist."""
    checks = [rows.groupBy(key).count().filter("count > 1").select(F.lit(f"{key} repeated").alias("problem"))]
    checks += [rows.filter(F.col(c).isNull() | (F.col(c).cast("string") == "")).select(F.lit(f"{c} missing")) for c in required]
    checks += [rows.filter(~F.col(c).rlike(p)).select(F.lit(f"{c} malformed")) for c, p in patterns.items()]
    checks.append(rows.filter(F.col(parent).isNotNull()).select(F.col(parent).alias(key)).join(rows.select(key), key, "left_anti").select(F.lit(f"{parent} unknown")))
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out.groupBy("problem").agg(F.count("*").alias("n"))


def same_columns(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], group: str) -> DataFrame:
    """group, and per column whether all its values are equal in a and b, null and NaN being equal to themselves."""
    y = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    x = a.join(y, keys)
    return x.groupBy(group).agg(*[F.bool_and(F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns])


def roundtrip(stored: DataFrame, again: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """The rows of a sample of stored, chosen by hash of the keys, that another reading doesn't give exactly."""
    pick = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000)
    rest = [c for c in stored.columns if c not in keys]
    x = stored.filter(pick).join(again.select(*keys, F.lit(True).alias("__in"), *[F.col(c).alias(f"__{c}") for c in rest]), keys, "left")
    same = F.coalesce(F.col("__in"), F.lit(False))
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return x.filter(~same).select(*keys)
