"""Write-once outputs, manifests, frozen folders, resumable logs, and fetching with checks."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, **options) -> None:
    """Parquet in zstd; a path that holds anything is refused."""
    df.write.mode("errorifexists").option("compression", "zstd").options(**options).parquet(path)


def write_observed(df: DataFrame, path: str, **options) -> list[dict]:
    """write_once, and what was seen while writing: for each column its table's rows, the nulls, and how often a flag is
    true (null for other columns). The metrics come with the one write, which counts a row once however often its task is
    run, and nothing is read again."""
    seen, columns = Observation(), df.columns
    flags = [c for c, kind in df.dtypes if kind == "boolean"]
    of = lambda c: F.col("`" + c.replace("`", "``") + "`")
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count_if(of(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)], *[F.count_if(of(c)).alias(f"f{i}") for i, c in enumerate(flags)]]
    write_once(df.observe(seen, *metrics), path, **options)
    got = seen.get
    return [{"column": c, "rows": got["rows"], "nulls": got[f"n{i}"], "true": got[f"f{flags.index(c)}"] if c in flags else None} for i, c in enumerate(columns)]


OBSERVED = "table string, column string, rows long, nulls long, true long"


def observed_manifest(spark: SparkSession, tables: dict[str, list[dict]]) -> DataFrame:
    """OBSERVED: what write_observed saw, of each table by name, a row per column."""
    return spark.createDataFrame([(name, r["column"], r["rows"], r["nulls"], r["true"]) for name, rows in tables.items() for r in rows], OBSERVED)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of all files below folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changes(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (changed, gone, new) between two manifests."""
    x = frozen.select("path", F.col("sha256").alias("a")).join(now.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return x.select("path", kind.alias("change")).filter("change is not null")


def verify_frozen(frozen: DataFrame, now: DataFrame) -> None:
    bad = changes(frozen, now).limit(20).collect()
    if bad:
        raise ValueError("not as frozen: " + ", ".join(f"{r.path} {r.change}" for r in bad))


def content_id(data: object) -> str:
    """sha256 of the data as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def run_manifest(folder: str | Path, inputs: dict) -> str:
    """Start or resume a run: its id follows from the inputs, and a folder begun with others is refused."""
    run, path = content_id(inputs), Path(folder) / "run.json"
    if path.exists():
        if json.loads(path.read_text())["run_id"] != run:
            raise ValueError(f"{folder} belongs to a run with other inputs")
        return run
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x") as f:
        json.dump({"run_id": run, "inputs": inputs}, f, sort_keys=True, indent=1)
    return run


def write_locked(path: str | Path, data: dict) -> str:
    """Write data with its own hash, once; an existing file is never overwritten. Returns the hash."""
    body = data | {"sha256": content_id(data)}
    with Path(path).open("x") as f:
        json.dump(body, f, sort_keys=True, indent=1)
    return body["sha256"]


def read_locked(path: str | Path) -> dict:
    data = json.loads(Path(path).read_text())
    if data.pop("sha256") != content_id(data):
        raise ValueError(f"{path} was changed")
    return data


def todo(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks that the log has no row for."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def append_log(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows to a JSON-lines log, but for those whose keys it has; how many were new."""
    spark = rows.sparkSession
    try:
        rows = todo(rows, spark.read.schema(rows.schema).json(path), keys)
    except Exception as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = rows.count()
    if n:
        rows.write.mode("append").json(path)
    return n


@dataclass
class Asset:
    """One file of a source; sha256 or md5 may be unknown."""

    path: str
    url: str
    bytes: int | None = None
    sha256: str | None = None
    md5: str | None = None


@dataclass
class Source:
    id: str
    assets: list[Asset]
    license: dict = field(default_factory=dict)
    milestones: list[str] = field(default_factory=list)


def _digests(path: Path) -> tuple[int, str, str]:
    n, a, b = 0, hashlib.sha256(), hashlib.md5(usedforsecurity=False)
    with path.open("rb") as f:
        while part := f.read(1 << 20):
            n += len(part)
            a.update(part)
            b.update(part)
    return n, a.hexdigest(), b.hexdigest()


def check_file(asset: Asset, path: Path, quick: bool = False) -> str:
    """missing, mismatch, unpinned or ok; quick looks at the size only."""
    if not path.exists():
        return "missing"
    if asset.bytes is not None and path.stat().st_size != asset.bytes:
        return "mismatch"
    if quick:
        return "ok"
    _, sha, md5 = _digests(path)
    if asset.sha256 and sha != asset.sha256 or asset.md5 and md5 != asset.md5:
        return "mismatch"
    return "ok" if asset.sha256 else "unpinned"


def copy_local(url: str, to: Path) -> None:
    """The provider for file URLs."""
    u = urlparse(url)
    if u.scheme not in ("", "file"):
        raise ValueError(f"no provider for {u.scheme} here")
    shutil.copyfile(unquote(u.path), to)


def fetch(sources: list[Source], folder: str | Path, jobs: int = 4, retries: int = 3, get: Callable[[str, Path], None] = copy_local, wait: float = 0.1) -> dict[str, str]:
    """Bring all assets to folder/source/path: had, fetched, or why not.

    A file is checked beside its place and moved there whole; one that is there but differs is never overwritten.
    """

    def one(source: Source, a: Asset) -> str:
        to = Path(folder) / source.id / a.path
        state = check_file(a, to)
        if state != "missing":
            return "had" if state in ("ok", "unpinned") else "differs, left as it is"
        part = to.with_name(to.name + f".part{os.getpid()}")
        to.parent.mkdir(parents=True, exist_ok=True)
        why = ""
        for k in range(retries):
            try:
                get(a.url, part)
                if check_file(a, part) == "mismatch":
                    raise ValueError("what came doesn't match its checksum")
                os.link(part, to)
                return "fetched"
            except (OSError, ValueError) as e:
                why = str(e)
                time.sleep(wait * 2**k)
            finally:
                part.unlink(missing_ok=True)
        return f"failed: {why}"

    work = [(s, a) for s in sources for a in s.assets]
    with ThreadPoolExecutor(jobs) as pool:
        return {f"{s.id}/{a.path}": r for (s, a), r in zip(work, pool.map(lambda x: one(*x), work))}


def files_frame(spark: SparkSession, folder: str | Path) -> DataFrame:
    """path, bytes, sha256, md5 of the files below a folder, paths relative to it."""
    base = Path(folder).resolve().as_uri().replace("file:///", "file:/")
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder))
    return x.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
