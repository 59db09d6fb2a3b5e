"""LM scoring: a weighted backoff automaton over smoothed n-grams, traversed once from left to right."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..tables import mark, new_path, release, scratch, settle
from .common import table

END = b"\n"  # the end token: no word can be this


@dataclass(frozen=True)
class Settings:
    """The model, and which part of it the tasks hold themselves, so that its size has a bound.

    least: pairs counted at least so often are arcs. discount: taken off each pair's count for what follows a state
    unseen. held, held_arcs: so many tokens and arcs between them at most, the most frequent, are in the tasks' memory
    (24 and 16 bytes each). All others meet their documents in a join, so what is held changes no score.
    """

    least: int = 2
    discount: float = 0.5
    held: int = 300_000
    held_arcs: int = 1_000_000


#: Words of at most so many bytes are hashed many at once, eight bytes a step.
SHORT = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A turn of a 64-bit hash; no two values become one."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 0)):
        h = h ^ (h >> np.uint64(shift))
        h = h * np.uint64(factor) if factor else h
    return h


def _short_keys(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keys of the words of size bytes, 1 up to SHORT, that begin at first. At least 7 bytes follow the last one."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h, at, step = _mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.arange(len(first)), 0
    while len(at):
        left = np.minimum(size[at] - step, 8)
        block = eight[first[at] + step] & (~np.uint64(0) >> (64 - 8 * left).astype(np.uint64))
        h[at] = _mixed(h[at] ^ block)
        step += 8
        at = at[size[at] > step]
    return h.view(np.int64)


def key_of(word: bytes) -> int:
    """64-bit signed hash of a token."""
    if len(word) <= SHORT:
        return int(_short_keys(np.frombuffer(word + bytes(8), np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of token keys: a turned by one bit, and b."""
    return (a << 1 | (a >> 63 & 1)) ^ b


BITS = 1 << 27  # of a bit map: 16 MB


def bit_map(rows: DataFrame) -> np.ndarray:
    """Bits of the keys k of rows, of one size however many there are: it may show a key that is not there, but none is missed."""
    bit = F.expr("shiftleft(1L, cast(k & 63 as int))")
    found = rows.select(F.expr(f"shiftright(k & {BITS - 1}L, 6)").alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (BITS - 1)
    return (bits[at >> 6] >> (at & 63) & 1).astype(bool)


class Words(dict):
    """Long word to key; as many words as fit are remembered."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = key_of(word)
        return found


def batches(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(first, past) of runs of texts of so many bytes in all, or of one longer text."""
    size, first = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
        if size and size + n > most:
            yield first, i
            size, first = 0, i
        size += n + 1
    if first < len(column):
        yield first, len(column)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.ones(256, bool)
_LETTER[[32, *range(9, 14)]] = False


def read(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts, of the token before each (the end, before a text's first), and each text's number of tokens.

    Tokens are the words, A-Z in lower case, between space and U+0009 to U+000D, then the end."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    data = _LOWER[np.frombuffer(END.join(raw) + END + bytes(8), np.uint8)]
    past = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)
    letter = _LETTER[data]
    letter[len(data) - 8 :] = False
    edge = np.flatnonzero(np.diff(letter, prepend=False))
    first, size = edge[::2], edge[1::2] - edge[::2]
    text = np.searchsorted(past, first, "right")
    sizes = np.bincount(text, minlength=len(raw)) + 1
    own = np.empty(len(first), np.int64)
    short = size <= SHORT
    own[short] = _short_keys(data, first[short], size[short])
    for i in np.flatnonzero(~short).tolist():
        own[i] = words[data[first[i] : first[i] + size[i]].tobytes()]
    end = key_of(END)
    keys = np.full(int(sizes.sum()), end, np.int64)
    keys[np.arange(len(own)) + text] = own
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return keys, before, sizes


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8 bytes a value and one length as one value for a shuffle: the first, which ascends, by its steps, each
    byte of a number beside the same one of the others, so that high bytes take no room."""
    first, *rest = columns
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(first, prepend=first.dtype.type(0)), *rest)]
    return len(first).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns, of these kinds, that pack() took."""
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n * len(kinds), "zstd", asbytes=True), np.uint8).reshape(len(kinds), 8, n)
    out = [np.ascontiguousarray(p.T).view(k).ravel() for p, k in zip(planes, kinds)]
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def _dealt(at: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) of all buckets that have rows: at, a hash or a place, modulo parts. The rows keep their order."""
    bucket = at % parts
    order = np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=parts))
    for p, rows in enumerate(np.split(order, ends[:-1])):
        if len(rows):
            yield p, rows


def find(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in held, which is sorted, or -1."""
    if not len(held) or not len(keys):
        return np.full(len(keys), -1)
    distinct, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(held, distinct), len(held) - 1)
    return np.where(held[at] == distinct, at, -1)[back]


@dataclass(frozen=True)
class Model:
    """keys, singles, backs: of the held tokens, sorted by key, their log10 probabilities and, as states, failure weights;
    arc_keys, arc_weights: of the held arcs, sorted. pair_bits: a bit map of the other arcs, None if there are none.
    entries: (k, c, w) of all tokens (count, failure weight) and of the arcs that are not held (no count; what the arc
    adds to a backoff)."""

    keys: np.ndarray
    singles: np.ndarray
    backs: np.ndarray
    arc_keys: np.ndarray
    arc_weights: np.ndarray
    pair_bits: np.ndarray | None
    entries: DataFrame | None
    n: int
    v: int
    s: Settings

    def automaton(self) -> "Automaton":
        return Automaton(self.keys, self.singles, self.backs, self.arc_keys, self.arc_weights, self.pair_bits)


class Automaton:
    """States are the root and each token, as the context after it. An arc reads a token and adds its log10 probability;
    where a state has no arc for it, the failure arc adds the state's weight and goes to the root, whose arcs read any
    token. Each state's arcs, held or not, and its failure arc share out a probability of 1.

    Whatever arcs are taken, the state after a token is the token's own. So the states of a traversal from left to
    right are the tokens themselves, moved by one, and the arcs of many texts are looked up in one go.
    """

    def __init__(self, keys, singles, backs, arc_keys, arc_weights, pair_bits):
        self.keys, self.arc_keys, self.pair_bits = keys, arc_keys, pair_bits
        self.singles, self.backs, self.arc_weights = np.append(singles, 0.0), np.append(backs, 0.0), np.append(arc_weights, 0.0)

    def run(self, keys: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """(score, base, tokens read) of each text for what is held, and (text, key, number) of the other tokens and of
        pairs that may be arcs which are not held: what the model's entries say of these is still to be added."""
        first, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        state, at = find(self.keys, before), find(self.keys, keys)
        pairs = pair_key(before, keys)
        arc = np.full(len(keys), -1)
        both = (state >= 0) & (at >= 0)
        arc[both] = find(self.arc_keys, pairs[both])
        failed = arc < 0
        step = np.where(failed, self.backs[state] + self.singles[at], self.arc_weights[arc])
        add = lambda x: np.add.reduceat(x, first)
        rest = [_counted(text[at < 0], keys[at < 0])]
        if self.pair_bits is not None:
            may = failed.copy()
            may[failed] = may_hold(self.pair_bits, pairs[failed])
            rest.append(_counted(text[may], pairs[may]))
        return add(step), add(self.singles[at]), add((at >= 0).astype(np.int64)), rest


def _counted(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, key) and how often each comes."""
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[new], keys[new], np.diff(np.append(new, len(text)))


def _freed() -> None:
    """Hand back what a task has allocated: its worker waits for the next task beside the executor's other memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _sums(texts: DataFrame, count, least: int = 1) -> DataFrame:
    """k, a and n: sums over all texts of what count() yields for runs of texts, of those that come to least or more.

    Each task adds up first and deals what it has by key into buckets, packed; four buckets for each shuffle partition,
    so their size does not grow with the input.
    """
    spark = texts.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = count(), Words()
        for b in batches_:
            for first, past in batches(b.column(0)):
                for found in total.add(*read(b.column(0).slice(first, past - first), words)):
                    yield from dealt(*found)
        for found in total.rest():
            yield from dealt(*found)
        total = found = None
        _freed()

    def dealt(k: np.ndarray, a: np.ndarray, n: np.ndarray, by: int, kind: int) -> Iterator[pa.RecordBatch]:
        for p, rows in _dealt(k >> by, parts):
            for i in range(0, len(rows), PACKED):
                own = rows[i : i + PACKED]
                yield pa.RecordBatch.from_pydict({"bucket": [kind * parts + p], "packed": [pack(k[own], a[own], n[own])]}, pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))

    def added(bucket: pa.Table) -> pa.Table:
        k, a, n = (np.concatenate(x) for x in zip(*(unpack(x, np.int64, np.int64, np.int64) for x in bucket.column("packed").to_pylist())))
        order = np.argsort(k, kind="stable")
        k, a, n = k[order], a[order], n[order]
        new = np.flatnonzero(np.diff(k, prepend=~k[:1]))
        n = np.add.reduceat(n, new)
        enough = n >= least
        return pa.table({"k": k[new][enough], "a": a[new][enough], "n": n[enough]})

    ship(spark)
    return texts.select("text").mapInArrow(work, "bucket int, packed binary").groupBy("bucket").applyInArrow(added, "k long, a long, n long")


FLUSH = 3_000_000  # tokens or pairs that a task counts at once, 24 MB a column
PACKED = 100_000  # that are packed as one value at most


class Singles:
    """Counts of tokens; handed on when there are many."""

    def __init__(self):
        self.found, self.held = [], 0

    def add(self, keys: np.ndarray, before: np.ndarray, sizes: np.ndarray):
        self.found.append(keys)
        self.held += len(keys)
        return self.rest() if self.held >= FLUSH else ()

    def rest(self):
        out = []
        if self.found:
            k = np.concatenate(self.found)
            self.found.clear()
            k, n = np.unique(k, return_counts=True)
            out.append((k, np.zeros_like(k), n, 0, 0))
        self.found, self.held = [], 0
        return out


class Pairs:
    """Counts (k, a, n) of pairs of neighbours; the end stands before the first token. Of two held tokens, k is the code of
    their places and a is 0; else a is the first one's key and k the pair's. Pairs with a token that is in too few places
    are left out."""

    def __init__(self, held: np.ndarray, bits: np.ndarray):
        self.held, self.bits, self.near, self.far, self.count = held, bits, [], [], 0

    def add(self, keys: np.ndarray, before: np.ndarray, sizes: np.ndarray):
        a, b = find(self.held, before), find(self.held, keys)
        near = (a >= 0) & (b >= 0)
        self.near.append(a[near] << 21 | b[near])
        x, y = before[~near], keys[~near]
        good = may_hold(self.bits, x) & may_hold(self.bits, y)
        self.far.append((pair_key(x[good], y[good]), x[good]))
        self.count += len(self.near[-1]) + 2 * len(self.far[-1][0])
        return self.rest() if self.count >= FLUSH else ()

    def rest(self):
        out = []
        if self.near:
            values = np.concatenate(self.near)
            self.near.clear()
            values, n = np.unique(values, return_counts=True)
            out.append((values, np.zeros_like(values), n, 21, 0))  # dealt by the first token, so that the steps are small
            k, a = (np.concatenate(x) for x in zip(*self.far))
            self.far.clear()
            values, at, n = np.unique(k, return_index=True, return_counts=True)
            out.append((values, a[at], n, 0, 1))
        self.near, self.far, self.count = [], [], 0
        return out


def _near(pairs: DataFrame, shared) -> DataFrame:
    """(a, b, n, ca, cb): the tokens' keys and counts, of pairs of held tokens."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value[:2]
        for batch in parts:
            k, n = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(2))
            a, b = k >> 21, k & ((1 << 21) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[a], keys[b], n, counts[a], counts[b])], names=["a", "b", "n", "ca", "cb"])

    return pairs.select("k", "n").mapInArrow(work, "a long, b long, n long, ca long, cb long")


def _with_back(pairs: DataFrame, shared) -> DataFrame:
    """a, b, n, ca, cb and back of pairs whose first token is held: shared has the held keys and their failure weights."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, back = shared.value
        for batch in parts:
            yield batch.append_column("back", pa.array(back[np.searchsorted(keys, batch.column("a").to_numpy())]))

    return pairs.select("a", "b", "n", "ca", "cb").mapInArrow(work, "a long, b long, n long, ca long, cb long, back double")


def _floor(rows: DataFrame, most: int, n: str = "n") -> int:
    """The least count such that at most so many rows have it or more."""
    by = rows.groupBy(n).agg(F.count("*").alias("m")).orderBy(F.desc(n)).toArrow()
    fit = np.cumsum(by["m"].to_numpy()) <= most
    values = by[n].to_numpy()
    return int(values[fit].min()) if fit.any() else int(values.max(initial=0)) + 1


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Count all tokens of docs and all pairs of neighbours, in two passes over the whole texts.

    Tokens and arcs stay tables. Only those held come to the driver, at most s.held tokens and s.held_arcs arcs, and
    bit maps of one size. Null texts: empty. No documents: every token is unknown.
    """
    spark, before = docs.sparkSession, mark()
    counts = scratch(_sums(docs, Singles).select("k", "n"))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unit = float(n + 0.5 * (v + 1))
    held = _floor(counts, min(s.held, (1 << 21) - 1))
    rows = counts.filter(F.col("n") >= held).toArrow()
    order = np.argsort(rows["k"].to_numpy())
    keys, state_counts = rows["k"].to_numpy()[order], rows["n"].to_numpy()[order]
    some = counts.filter(F.col("n") >= s.least)  # no pair is more frequent than its tokens
    shared = spark.sparkContext.broadcast((keys, state_counts, bit_map(some)))
    counted = mark()
    pairs = scratch(_sums(docs, lambda: Pairs(shared.value[0], shared.value[2]), s.least))
    turned = F.expr("shiftleft(a, 1) | shiftrightunsigned(a, 63)")
    far = pairs.filter("a <> 0").select("a", turned.bitwiseXOR(F.col("k")).alias("b"), "n")
    far = far.join(some.select(F.col("k").alias("b"), F.col("n").alias("cb")), "b").join(some.select(F.col("k").alias("a"), F.col("n").alias("ca")), "a")
    pairs = settle(_near(pairs.filter("a = 0"), shared).union(far.select("a", "b", "n", "ca", "cb")), counted)
    used = (F.sum("n") - F.count("*") * s.discount) / F.first("ca")
    cover = (F.sum("cb") + F.count("*") * 0.5) / F.lit(unit)
    left = F.log10(F.greatest(1 - used, F.lit(1e-9)) / F.greatest(1 - cover, F.lit(1e-9)))
    backs = scratch(pairs.groupBy("a").agg(left.alias("back"), F.first("ca").alias("ca")))
    both = (F.col("ca") >= held) & (F.col("cb") >= held)
    near = both & (F.col("n") >= _floor(pairs.filter(both), s.held_arcs))
    k = turned.bitwiseXOR(F.col("b")).alias("k")
    p = F.log10((F.col("n") - s.discount) / F.col("ca"))
    arcs = pairs.filter(near).select(k, p.alias("w")).toArrow()
    by_key = np.argsort(arcs["k"].to_numpy())
    weights = backs.filter(F.col("ca") >= held).select("a", "back").toArrow()
    back = np.zeros(len(keys))
    if len(keys):
        back[np.searchsorted(keys, weights["a"].to_numpy())] = weights["back"].to_numpy()
    delta = p - F.col("back") - F.log10((F.col("cb") + 0.5) / F.lit(unit))
    rest, from_held = pairs.filter(~near), F.col("ca") >= held
    known = _with_back(rest.filter(from_held), spark.sparkContext.broadcast((keys, back)))  # no join for these
    rare = rest.filter(~from_held).join(backs.filter(~from_held).select("a", "back"), "a").select(*known.columns)
    far = known.union(rare).select(k, F.lit(None).cast("long").alias("c"), delta.alias("w"))
    own = counts.join(backs.select(F.col("a").alias("k"), "back"), "k", "left").select("k", F.col("n").alias("c"), F.coalesce("back", F.lit(0.0)).alias("w"))
    entries = settle(own.union(far), before)  # the counts have done their work
    far = entries.filter("c is null")
    bits = bit_map(far) if far.head(1) else None
    return Model(keys, np.log10((state_counts + 0.5) / unit), back, arcs["k"].to_numpy()[by_key], arcs["w"].to_numpy()[by_key], bits, entries, n, v, s)


TEXTS = 100_000  # in a chunk at most


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10), one row per row of docs, in one traversal per text.

    The automaton is broadcast (see train for its bound). A task works texts in chunks: it writes what is held, and what
    other tokens and arcs add is asked of the model's entries by (key, place of the text in its chunk), dealt by key into
    buckets; each bucket answers a chunk with a sum for each text. Null text: only the end. Null doc_id stays null.
    Repeated rows each get theirs. Empty table: empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model.automaton())
    unit = model.n + 0.5 * (model.v + 1)
    kind = dict(docs.dtypes)["doc_id"]
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # few, so that a text's sums are few

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words, part, chunk = shared.value, Words(), TaskContext.get().partitionId(), 0
        held, place, size, ids = [], 0, 0, None
        for b in rows:
            ids = b.schema.field("doc_id").type
            for first, past in batches(b.column("text")):
                own = b.slice(first, past - first)
                keys, before, sizes = read(own.column("text"), words)
                total, base, known, rest = machine.run(keys, before, sizes)
                places = np.arange(place, place + len(own))
                yield _rows(len(own), chunk=np.full(len(own), part << 32 | chunk), doc_id=own.column("doc_id"), place=places, n=sizes, known=known, base=base, score=total)
                held += [(text + place, key, 2 * n + j) for j, (text, key, n) in enumerate(rest)]
                place, size = place + len(own), size + sum(len(x[0]) for x in rest)
                if size >= FLUSH // 4 or place >= TEXTS:
                    yield from asked(held, part << 32 | chunk, ids)
                    held, place, size, chunk = [], 0, 0, chunk + 1
        if held:
            yield from asked(held, part << 32 | chunk, ids)
        del held
        _freed()

    def _rows(m: int, **columns) -> pa.RecordBatch:
        ids = columns["doc_id"].type
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", ids), ("place", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("bucket", pa.int32()), ("packed", pa.binary())])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns and f.name != "doc_id" else columns.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)

    def asked(held: list[tuple[np.ndarray, ...]], chunk: int, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        text, key, what = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        text, key, what = text[order], key[order], what[order]
        for p, own in _dealt(key, parts):
            for i in range(0, len(own), PACKED):
                x = own[i : i + PACKED]
                yield _rows(1, chunk=[chunk], doc_id=pa.nulls(1, ids), bucket=[p], packed=[pack(key[x], text[x], what[x])])

    def answered(asks: pa.Table, entries: pa.Table) -> pa.Table:
        k, c, w = (entries.column(x).combine_chunks() for x in ("k", "c", "w"))
        order = np.argsort(k.to_numpy())
        k = k.to_numpy()[order]
        c, w = np.append(c.fill_null(0).to_numpy()[order], 0), np.append(w.to_numpy()[order], 0.0)
        single = np.log10((c + 0.5) / unit)
        out = []
        for raw in asks.column("packed").to_pylist():
            key, text, what = unpack(raw, np.int64, np.int64, np.int64)
            at, n, token = find(k, key), what >> 1, what & 1 == 0
            more = np.where(token, n * single[at], 0.0)
            texts, back = np.unique(text, return_inverse=True)
            sums = [np.bincount(back, x, len(texts)) for x in (more + n * w[at], more)]
            known = np.bincount(back, np.where(token & (c[at] > 0), n, 0), len(texts)).astype(np.int64)
            some = (sums[0] != 0) | (sums[1] != 0) | (known > 0)
            out.append(pack(texts[some], *[x[some] for x in sums], known[some]))
        _freed()
        return pa.table({"chunk": asks.column("chunk"), "packed": pa.array(out, pa.binary())})

    def added(texts: pa.Table, answers: pa.Table) -> pa.Table:
        place = texts.column("place").to_numpy()
        score, base, known = (texts.column(x).to_numpy().copy() for x in ("score", "base", "known"))
        at = np.empty(int(place.max(initial=-1)) + 1, np.int64)
        at[place] = np.arange(len(place))
        for raw in answers.column("packed").to_pylist():
            text, *more = unpack(raw, np.int64, np.float64, np.float64, np.int64)
            for x, y in zip((score, base, known), more):
                x[at[text]] += y  # a text is there once
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": texts.column("n"), "n_known": known, "base_score": base, "score": score})

    rows = docs.select("doc_id", "text").mapInArrow(work, f"chunk long, doc_id {kind}, place long, n long, known long, base double, score double, bucket int, packed binary")
    rows.write.option("compression", "none").parquet(path := new_path(spark))  # a text keeps its place; the rest is packed
    rows = spark.read.schema(rows.schema).parquet(path)
    entries = model.entries.select(F.expr(f"cast(pmod(k, {parts}) as int)").alias("bucket"), "k", "c", "w")
    asks = rows.filter("packed is not null").select("bucket", "chunk", "packed")
    answers = asks.groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(answered, "chunk long, packed binary")
    texts = rows.filter("packed is null").select("chunk", "doc_id", "place", "n", "known", "base", "score")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(added, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Fixed by the contract: rows whose crc32 of the id as text leaves 1 modulo 5 are not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op7_lm_backoff(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    release(spark)
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
