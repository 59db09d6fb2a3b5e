"""Quality classifier: Naive Bayes support vectors over hashed character n-grams, fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import table

#: Decision of the contract: a score of at least this predicts label 1.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that the fit sees; all of them are used up to that, else those of least hash.
    max_grams bounds their distinct n-grams, summed over rows (4 bytes each in the one task that fits): from the row on
    that would exceed it, in order of hash, rows are left out.

    orders: lengths of the n-grams, in UTF-8 bytes; bits: log2 of the hash space; c: the hinge loss's weight; smooth:
    added to each class count; hold: share of the sample kept for calibration.
    """

    max_rows: int = 12_000
    max_grams: int = 100_000_000
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 18
    c: float = 4.0
    smooth: float = 1.0
    epochs: int = 30
    hold: float = 0.25
    seed: int = 11


def ngrams(text: str | None, s: Settings = Settings()) -> np.ndarray:
    """Distinct hashed n-grams of the whole text, of its bytes and of its words' shapes, sorted. Null, empty: none."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    found, code = [], np.zeros(len(b), np.uint64)
    mix = lambda c: (c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - s.bits)).astype(np.uint32)
    for n in range(1, max(s.orders) + 1):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        if n in s.orders:
            found.append(mix(code + np.uint64(n << 40)))
    found += [mix(code + np.uint64((8 + n) << 40)) for n, code in enumerate(shapes(b)) if len(code)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


#: Classes of bytes for word shapes: lower case and beyond ASCII, upper case, digits, sentence marks, other marks.
CLASSES = np.full(256, 1, np.uint64)
CLASSES[[*range(65, 91)]] = 2
CLASSES[[*range(48, 58)]] = 4
CLASSES[[ord(c) for c in ".,;:?!'"]] = 8
CLASSES[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:?!'"]] = 16
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shapes(b: np.ndarray) -> list[np.ndarray]:
    """Codes of word shapes, alone and in pairs and triples: the classes of a word's bytes, the class of its first and
    last byte, and whether it equals the word one, two or three before it."""
    space = SPACE[b.astype(np.intp)]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return []
    kind = CLASSES[b.astype(np.intp)]
    shape = np.bitwise_or.reduceat(np.where(space, np.uint64(0), kind), start)
    sums = np.cumsum(b)
    total = sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
    word = total * np.uint64(1 << 20) + (end - start).astype(np.uint64) * np.uint64(256) + b[start]
    same = np.zeros(len(start), np.uint64)
    for k in (1, 2, 3):
        if len(word) > k:
            same[k:] |= (word[k:] == word[:-k]).astype(np.uint64) << np.uint64(k - 1)
    one = shape | kind[start] << np.uint64(5) | kind[end - 1] << np.uint64(10) | same << np.uint64(15)
    return [one, (one[:-1] << np.uint64(18)) | one[1:], (same[:-2] << np.uint64(42)) | (shape[:-2] << np.uint64(36)) | (one[1:-1] << np.uint64(18)) | one[2:]]


def log_ratios(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> np.ndarray:
    """The log of the ratio of each n-gram's share of class 1 to its share of class 0."""
    p, q = np.full(1 << s.bits, s.smooth), np.full(1 << s.bits, s.smooth)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Minimise |w|^2 / 2 + sum of c * hinge by single dual variables in random order; returns weights and bias.

    Stops when no variable's projected gradient exceeds 0.01.
    """
    w, bias, a = np.zeros(1 << s.bits), 0.0, np.zeros(len(rows))
    most = np.full(len(y), s.c)
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            worst = max(worst, -g if a[i] < most[i] else 0.0, g if a[i] > 0 else 0.0)
            new = min(max(a[i] - g / square[i], 0.0), most[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                a[i] = new
        if worst < 0.01:
            break
    return w, bias


def _scaled(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[x]
    n = np.sqrt(v @ v)
    return v / n if n > 0 else v


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to the share of label 1, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, v = p - t, p * (1 - p) + 1e-9
        h = np.array([[v @ margin**2 + 1e-6, v @ margin], [v @ margin, v.sum() + 1e-6]])
        step = np.linalg.solve(h, [d @ margin, d.sum()])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return max(a, 0.0), b


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the indicators' scaled values, ratios multiplied in
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float
    settings: Settings

    def score(self, text: str | None) -> float:
        x = ngrams(text, self.settings)
        r = self.ratios[x].astype(np.float64)
        margin = (self.weights[x] @ r) / max(np.sqrt(r @ r), 1e-12) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def fit(rows: list[np.ndarray], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit on rows in the order given. Without both labels: a constant score, the smoothed share of label 1."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    order = np.random.default_rng(s.seed).permutation(len(y))
    held, used = order[: int(len(y) * s.hold)], order[int(len(y) * s.hold) :]
    if len({*y[used]}) < 2 or len({*y[held]}) < 2:
        used, held = order, order
    if len({*y}) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        zero = np.zeros(1 << s.bits, np.float32)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))), s)
    r = log_ratios([rows[i] for i in used], y[used], s)
    w, bias = dual_descent([rows[i] for i in used], [_scaled(rows[i], r).astype(np.float32) for i in used], y[used], s)
    margin = np.array([w[rows[i]] @ _scaled(rows[i], r) + bias for i in held])
    slope, offset = calibrate(margin, y[held])
    return Model(w.astype(np.float32), r.astype(np.float32), bias, slope, offset, s)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> Model:
    """Fit on labelled documents: at most s.max_rows, those whose doc_id hashes lowest.

    The chosen ids (bounded) are broadcast, so of the texts of docs only those are moved; their n-grams meet in one
    task, as many as s.max_rows and s.max_grams allow. Null labels and labels without a document are left out; a
    repeated label row counts again; of texts that share a doc_id the one of least hash counts. No labels at all: a
    model that scores 0.5.
    """
    ship(docs.sparkSession)
    order = [F.xxhash64("__id"), "__id", "__y"]
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y")).dropna().orderBy(*order).limit(s.max_rows)
    wanted = docs.select("doc_id", "text").join(F.broadcast(chosen.select("__id").distinct()), F.col("doc_id") == F.col("__id"), "left_semi")
    wanted = wanted.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = wanted.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([ngrams(t.as_py(), s).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__y"), x], names=["doc_id", "y", "x"])

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, total = [], 0
        for p in parts:  # in order of hash
            for i, y, x in zip(p["doc_id"], p["y"], p["x"]):
                total += len(x) // 4
                if total <= s.max_grams:
                    data.append((i, y, x))
        data.sort()
        if not data:
            return
        m = fit([np.frombuffer(x, np.uint32) for _, _, x in data], np.array([y for _, y, _ in data]), s)
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "ratios": [m.ratios.tobytes()], "bias": [m.bias], "slope": [m.slope], "offset": [m.offset]})

    encoded = rows.select("doc_id", "text", "__y").mapInArrow(encode, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, x binary")
    one = encoded.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y")
    found = one.mapInPandas(learn, "weights binary, ratios binary, bias double, slope double, offset double").collect()  # one row
    if not found:
        return fit([], np.zeros(0), s)
    m = found[0]
    return Model(np.frombuffer(m.weights, np.float32), np.frombuffer(m.ratios, np.float32), m.bias, m.slope, m.offset, s)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry and score, 0 to 1, from the whole text alone. No shuffle; the model (2 MB) is broadcast.

    Null and empty texts get the score of no n-gram at all. Equal texts get equal scores. Empty table: empty result.
    Columns in carry must not be called score.
    """
    ship(docs.sparkSession)
    if taken := {"score", "__text"} & set(carry):
        raise ValueError(f"carried columns must be renamed first: {', '.join(sorted(taken))}")
    names, shared = list(carry), docs.sparkSession.sparkContext.broadcast(model)
    source = "text" if "text" in names else "__text"  # a text that is carried crosses to Python once

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                p = pa.array([shared.value.score(t.as_py()) for t in part.column(source)], pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], p], names=[*names, "score"])

    rows = docs.select(*names) if source == "text" else docs.select(*names, F.col("text").alias(source))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(work, f"{kept}, score double")


def held_out(doc_id: Column) -> Column:
    """Fixed by the contract: rows whose crc32 of the id as text leaves 2 modulo 4 are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that score under threshold; columns as they were."""
    plain = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}  # no name may clash with score
    rows = score(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in plain.items()]), model, tuple(plain.values()))
    return rows.filter(F.col("score") >= threshold).select(*[F.col(n).alias(c) for c, n in plain.items()])


def op1_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
