"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else in the corpus.

The corpus is cut into contexts that can be sorted apart. Every string of width bytes is filed under its anchor, the place
of the least hash of the grams within it; equal strings have equal anchors. Neighbouring strings of one anchor form a
context of at most 2 * width - gram bytes. Contexts of anchors seen once hold no repeated string. All others are dealt by
anchor and sorted by suffix in two stages within tasks; adjacent common prefixes show which strings repeat.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..tables import new_path, release
from .common import scratch, table
from .suffixes import common_prefix_reaches, suffix_array

#: Of an anchor's hash, so many low bits give way to its place, which settles ties.
PLACE_BITS = 20
#: Strings of one text that are looked at in one go; the text beyond needs no more memory than itself.
STRIDE = 1 << 18
#: Bytes that are sorted in one go, and contexts of one anchor beyond which they are told apart by longer grams.
CHUNK, MOST = 500_000, 2_000
_BASE = 0x9E3779B97F4A7C15


def gram_of(width: int) -> int:
    """Length of the grams whose hashes choose the anchors: a quarter of width."""
    return max(1, width // 4)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, and a random number for each byte."""

    def up(base: int) -> np.ndarray:
        x = np.full(STRIDE + (1 << 16), base, dtype=np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return up(_BASE), up(pow(_BASE, -1, 1 << 64)), np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def anchored(data: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, anchor, key) of the contexts: the strings from first to last have their anchor, whose gram hashes to key, at anchor."""
    up, down, chance = _powers()
    span = width - gram + 1
    for start in range(0, len(data) - width + 1, STRIDE):
        part = data[start : start + STRIDE + width - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(chance[part] * up[: len(part)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << PLACE_BITS) - 1)
        ranked = np.full(-(-len(h) // span) * span, ~np.uint64(0), dtype=np.uint64)
        ranked[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        blocks = ranked.reshape(-1, span)  # the least of any span is that of the end of one block and the start of the next
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - span + 1
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], n) - 1
        at = (least[first] & low).astype(np.int64)
        yield first + start, last + start, at + start, h[at].view(np.int64)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit("")).cast("binary")


def key_of(text: Column) -> Column:
    """16 bytes that stand for a text; null and empty are one."""
    return F.unhex(F.md5(text))


def distinct_texts(docs: DataFrame, width: int) -> DataFrame:
    """key, text (binary) and copies of the different texts of width bytes or more, as a table in buckets by key in the
    shared folder: joins by key leave the texts where they are."""
    spark, text = docs.sparkSession, _text(docs)
    rows = docs.select(text.alias("text")).filter(F.octet_length("text") >= width).groupBy(key_of(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name, n = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(n, "key").option("path", new_path(spark)).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and out reads them
    return out


def occurrences(texts: DataFrame, width: int) -> DataFrame:
    """key, first, last, at, copies, g (the anchor's hash) and c (the context's) of every context of every text."""
    gram = gram_of(width)
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("at", pa.int64()), ("copies", pa.int64()), ("g", pa.int64()), ("c", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for key, text, copies in zip(b.column("key"), b.column("text"), b.column("copies").to_pylist(), strict=True):
                raw = memoryview(text.as_buffer())
                for first, last, at, g in anchored(np.frombuffer(raw, dtype=np.uint8), width, gram):
                    c = np.array([xxhash.xxh3_64_intdigest(raw[i : j + width]) for i, j in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                    held.append((key.as_py(), first, last, at, copies, g, c))
                    n += len(first)
                if n >= 200_000:
                    yield _flat(held, schema)
                    held, n = [], 0
            if held:
                yield _flat(held, schema)

    return texts.select("key", "text", "copies").mapInArrow(work, "key binary, first long, last long, at long, copies long, g long, c long")


def _flat(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    sizes = np.array([len(x[1]) for x in held])
    owner = pa.array(np.repeat(np.arange(len(held)), sizes))
    keys = pa.array([x[0] for x in held], pa.binary()).take(owner)
    cols = [keys, *[pa.array(np.concatenate([x[i] for x in held])) for i in (1, 2, 3)], pa.array(np.repeat([x[4] for x in held], sizes)), *[pa.array(np.concatenate([x[i] for x in held])) for i in (5, 6)]]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


CONTEXT = "g long, c long, n long, at long, bytes binary"


def _contents(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """CONTEXT of each row of wanted (g, c, n, key, first, last, at), read from its text."""
    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("g", "c", "n", "first", "last", "at")).alias("wanted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, rows in zip(b.column("text"), b.column("wanted"), strict=True):
                raw, rows = memoryview(text.as_buffer()), rows.values
                first, last, at = (rows.field(x).to_numpy(zero_copy_only=False) for x in ("first", "last", "at"))
                for i in range(0, len(first), 5_000):
                    part = slice(i, i + 5_000)
                    cut = pa.array([bytes(raw[a : e + width]) for a, e in zip(first[part].tolist(), last[part].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.field("g")[part], rows.field("c")[part], rows.field("n")[part], pa.array(at[part] - first[part]), cut], names=["g", "c", "n", "at", "bytes"])

    return listed.join(texts.select("key", "text"), "key").select("text", "wanted").mapInArrow(work, CONTEXT)


def _told_apart(contexts: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(contexts, parts): contexts of anchors with over most different ones are halved until none has so many.

    A string's offset is the way from its start to its anchor. Strings of the lower half of an anchor's offsets share a
    longer gram around it, and so do those of the upper half: their contexts are filed under these grams. A gram that
    one string alone has is dropped. After log2(width - gram + 1) rounds a gram is a whole string, and an anchor has one
    context. parts: og, oc, base, g, c says which part of a context (og, oc) begins at base and became (g, c).
    """
    gram = gram_of(width)
    whole, parts, low, high = None, None, F.lit(0), F.lit(width - gram)
    hot = contexts.withColumns({"og": F.col("g"), "oc": F.col("c"), "base": F.lit(0).cast("long"), "low": low, "high": high})
    for level in range(math.ceil(math.log2(width - gram + 1)) + 1):
        last = level == math.ceil(math.log2(width - gram + 1))
        counts = hot.groupBy("g").agg(F.approx_count_distinct("c").alias("m"), F.sum("n").alias("all"))
        dense = scratch(counts.filter((F.col("m") > most) & F.lit(not last)).select("g"))
        if level == 0:
            if dense.isEmpty():
                return contexts, None
            whole = contexts.join(dense, "g", "left_anti")
        elif not last and dense.isEmpty():
            last = True
        if level:
            done = hot.join(dense, "g", "left_anti")
            parts = done if parts is None else parts.unionByName(done)
            if last:
                break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        rows = hot.join(dense, "g").filter("low < high").withColumn("half", F.explode(halves))
        i = F.greatest(F.lit(0), F.col("at") - F.col("half.high"))
        j = F.least(F.octet_length("bytes") - width, F.col("at") - F.col("half.low"))
        rows = rows.withColumns({"i": i, "j": j}).filter("i <= j")
        core = F.substring("bytes", F.col("at").cast("int") - F.col("half.low") + 1, F.lit(width) + F.col("half.low") - F.col("half.high"))
        cut = F.substring("bytes", F.col("i").cast("int") + 1, (F.col("j") - F.col("i")).cast("int") + width)
        rows = rows.select(F.xxhash64("g", "half", core).alias("g"), F.xxhash64(F.lit(1), cut).alias("c"), "n", (F.col("at") - F.col("i")).alias("at"), cut.alias("bytes"), "og", "oc", (F.col("base") + F.col("i")).alias("base"), F.col("half.low").alias("low"), F.col("half.high").alias("high"))
        rows = scratch(rows)
        again = scratch(rows.groupBy("g").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("g"))
        hot = scratch(rows.join(again, "g"))
    parts = scratch(parts)
    once = parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    return whole.unionByName(once), parts.select("og", "oc", "base", "g", "c")


def _sorted(contexts: DataFrame, width: int, tasks: int) -> DataFrame:
    """g, c, starts, ends: in context (g, c), the strings from each start up to the end before the next are repeated.

    An anchor's contexts lie in one task, which sorts the suffixes of some MB of them at a time. A string is repeated if
    the stretch of suffixes that share its width bytes with their neighbours counts more than one; a context that the
    corpus has n times counts n times.
    """
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def found(g: list[int], c: list[int], n: list[int], held: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        sizes = np.array([len(x) for x in held])
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(held)), sizes)
        whole = np.arange(len(data)) - base[owner] <= sizes[owner] - width  # a string that begins here ends in its context
        order = suffix_array(data, width)
        order = order[whole[order]]
        shared = np.zeros(len(order), dtype=bool)
        shared[1:] = common_prefix_reaches(data, order[:-1], order[1:], width)
        group = np.cumsum(~shared) - 1
        count = np.bincount(group, weights=np.array(n)[owner[order]])
        again = np.zeros(len(data) + 1, dtype=np.int8)
        again[order] = count[group] > 1
        edge = np.diff(again, prepend=0)  # a run ends within its context: the last width - 1 places of each are false
        starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        at = owner[starts]
        offsets = np.searchsorted(at, np.arange(len(held) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x - base[at])) for x in (starts, ends)]
        out = pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), *lists], schema=schema)
        return out.filter(pa.array(np.diff(offsets) > 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, n, held, size = [], [], [], [], 0
        for b in batches:
            for key, ctx, times, raw in zip(*(b.column(x).to_pylist() for x in ("g", "c", "n", "bytes")), strict=True):
                if size >= CHUNK and key != g[-1]:
                    yield found(g, c, n, held)
                    g, c, n, held, size = [], [], [], [], 0
                g.append(key)
                c.append(ctx)
                n.append(times)
                held.append(raw)
                size += len(raw)
        if held:
            yield found(g, c, n, held)

    dealt = contexts.repartition(tasks, "g").sortWithinPartitions("g", "c")
    return dealt.select("g", "c", "n", "bytes").mapInArrow(work, "g long, c long, starts array<bigint>, ends array<bigint>")


def repeated_passages(docs: DataFrame, width: int = 400, most: int = MOST) -> DataFrame:
    """key, n_bytes, spans (array of start, end: bytes of the UTF-8 text, maximal, in order) and kept (binary) of each
    different text that has bytes covered by a string of width bytes that also starts elsewhere; see key_of.

    Null texts are empty; equal texts are each other's elsewhere; rows need a column text alone. Texts shorter than
    width have no such string. Repeated rows are copies. Empty table: empty result. No row or bucket is capped: anchors
    with over most contexts are told apart by longer grams. Equal contexts are known by 128 bits of two hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = distinct_texts(docs, width)
    found = scratch(occurrences(texts, width))
    release(spark)
    again = scratch(found.groupBy("g").agg(F.sum("copies").alias("all")).filter(F.col("all") > 1).select("g"))  # written: a join can split its hot keys then
    shared = scratch(found.join(again, "g"))
    wanted = shared.groupBy("g", "c").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("one")).select("g", "c", "n", "one.*")
    contexts = scratch(_contents(wanted, texts, width))
    release(spark)
    size = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    contexts, parts = _told_apart(contexts, width, most)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 8e6))
    strings = scratch(_sorted(contexts, width, tasks))
    if parts is not None:
        split = strings.join(parts, ["g", "c"]).select(F.col("og").alias("g"), F.col("oc").alias("c"), F.transform("starts", lambda x: x + F.col("base")).alias("starts"), F.transform("ends", lambda x: x + F.col("base")).alias("ends"))
        strings = strings.join(parts.select("g", "c").distinct(), ["g", "c"], "left_anti").unionByName(split)
    hits = shared.join(strings, ["g", "c"]).select("key", "first", "starts", "ends")
    return _covered(hits, texts, width)


def _covered(hits: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """key, n_bytes, spans and kept of the texts that hits names."""
    listed = hits.groupBy("key").agg(F.collect_list(F.struct("first", "starts", "ends")).alias("hits"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, rows in zip(b.column("key"), b.column("text"), b.column("hits"), strict=True):
                data, rows = np.frombuffer(text.as_buffer(), dtype=np.uint8), rows.values
                first, starts, ends = (rows.field(x) for x in ("first", "starts", "ends"))
                base = np.repeat(first.to_numpy(zero_copy_only=False), starts.value_lengths().to_numpy(zero_copy_only=False))
                cover = np.bincount(base + starts.flatten().to_numpy(), minlength=len(data) + 1).astype(np.int64)
                cover -= np.bincount(base + ends.flatten().to_numpy() - 1 + width, minlength=len(data) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([len(data)], pa.int64()), pa.array([spans], span), pa.array([data[~gone].tobytes()], pa.binary())], names=["key", "n_bytes", "spans", "kept"])

    return listed.join(texts.select("key", "text"), "key").select("key", "text", "hits").mapInArrow(work, "key binary, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_passages(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("key", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    text = _text(docs)
    rows = docs.select("doc_id", key_of(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    none = F.lit(0).cast("long")
    return rows.join(found, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


#: Every string of 400 bytes by its hash: its starts, the bytes they cover, and what lies between.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
steps AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM steps),
spans AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM runs GROUP BY r, run),
edges AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS before FROM spans),
kept AS (SELECT r, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS gone, max(e) AS last, string_agg(hex(b[before:s - 1]), '' ORDER BY s) AS x FROM edges JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
  CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(x || hex(b[last:octet_length(b)]))) END AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
