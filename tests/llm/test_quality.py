import functools
import math
import re
import zlib

import numpy as np
import pytest

from trialforge.llm import quality as q

from .helpers import odd_docs


def test_held_out(spark, sf):
    rows = q.op1_quality_nbsvm(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.95


def plain_grams(text, s):
    """N-grams of bytes and of word shapes by definition, hashed like the operator's."""
    b = (text or "").encode()
    mix = lambda c: (c * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - s.bits
    out = {mix(int.from_bytes(b[i : i + n], "big") + (n << 40)) for n in (1, 2, 3) for i in range(len(b) - n + 1)}
    kind = lambda c: 2 if 65 <= c < 91 else 4 if 48 <= c < 58 else 8 if c in b".,;:?!'" else 16 if 33 <= c < 127 and not chr(c).isalnum() else 1
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    one, shape, same = [], [], []
    for i, w in enumerate(words):
        shape.append(functools.reduce(lambda x, c: x | kind(c), w, 0))
        alike = lambda v: (sum(v) % 256, len(v), v[0])
        same.append(sum(1 << k - 1 for k in (1, 2, 3) if i >= k and alike(words[i - k]) == alike(w)))
        one.append(shape[-1] | kind(w[0]) << 5 | kind(w[-1]) << 10 | same[-1] << 15)
    out |= {mix(x + (8 << 40)) for x in one} | {mix((x << 18 | y) + (9 << 40)) for x, y in zip(one, one[1:])}
    return out | {mix((same[i] << 42 | shape[i] << 36 | one[i + 1] << 18 | one[i + 2]) + (10 << 40)) for i in range(len(one) - 2)}


def test_scores_by_definition(spark):
    """Scores from indicators, ratios, weights and the curve, one n-gram at a time."""
    texts = ["", "a", "Good words, and MORE good words 12 times!", "buy buy buy now $$$ http://x.y", "näïve café naive", " \t\n ", "one two three four one two"]
    s = q.Settings(hold=0.0)
    m = q.fit([q.ngrams(t, s) for t in texts], np.array([0, 1, 1, 0, 1, 0, 1]), s)
    for t in [*texts, "never seen Words 99", None]:
        grams = plain_grams(t, s)
        assert grams == set(q.ngrams(t, s).tolist())
        r = {g: float(m.ratios[g]) for g in grams}
        size = math.sqrt(sum(x * x for x in r.values()))
        margin = sum(float(m.weights[g]) * x for g, x in r.items()) / max(size, 1e-12) + m.bias
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-(m.slope * margin + m.offset))), rel=1e-6)


def test_log_ratios():
    s = q.Settings(bits=4)
    r = q.log_ratios([np.array([0, 1]), np.array([1]), np.array([2])], np.array([1, 1, -1]), s)
    p, n = np.ones(16), np.ones(16)
    p[0], p[1], n[2] = 2, 3, 2
    assert np.allclose(r, np.log(p / p.sum() / (n / n.sum())))


def test_descent_reaches_the_optimum():
    """The duality gap closes: primal value near the dual's, on a small problem that isn't separable."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(16, 5, replace=False)).astype(np.uint32) for _ in range(60)]
    values = [rng.normal(size=5) for _ in rows]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    s = q.Settings(bits=4, c=0.5, epochs=2000)
    w, b = q.dual_descent(rows, values, y, s)
    x = np.zeros((60, 17))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, 16] = v, 1
    full = np.append(w, b)
    primal = lambda z: z @ z / 2 + s.c * np.maximum(0, 1 - y * (x @ z)).sum()
    best = primal(full)
    for _ in range(300):
        assert primal(full + rng.normal(size=17) * 0.05) >= best - 1e-3


def test_odd_rows(spark):
    docs = odd_docs(spark, "score y")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (99, 1, 0), (8, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    m = q.train(docs, labels)
    out = q.score(docs, m).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    kept = q.keep_good(docs, m, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    none = q.train(docs, labels.limit(0))
    assert {r.score for r in q.score(docs, none).collect()} == {0.5}
    assert q.score(docs.limit(0), none).count() == 0
    one = q.train(docs, labels.filter("quality = 1"))
    assert min(r.score for r in q.score(docs, one).collect()) > 0.5
