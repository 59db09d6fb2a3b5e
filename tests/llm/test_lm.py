import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialforge.llm import lm

from .helpers import DOCS, crc, odd_docs


def toks(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b"\n"]


def plain(docs, train, s=lm.Settings()):
    """Base by the contract; the score by the backoff formula with no automaton: doc to (n, known, base, score)."""
    c, pairs = Counter(), Counter()
    for d in train:
        c.update(toks(d))
    n, v = sum(c.values()), len(c)
    unit = n + 0.5 * (v + 1)
    for d in train:
        x = [b"\n", *toks(d)]
        pairs.update(zip(x, x[1:]))
    pairs = {p: k for p, k in pairs.items() if k >= s.least}
    after = {}
    for (a, b), k in pairs.items():
        after.setdefault(a, {})[b] = (k - s.discount) / c[a]
    uni = lambda w: (c[w] + 0.5) / unit

    def p(a, b):
        f = after.get(a, {})
        if b in f:
            return f[b]
        return (1 - sum(f.values())) / (1 - sum(map(uni, f))) * uni(b)

    out = {}
    for d, t in docs.items():
        x = toks(t)
        out[d] = (len(x), sum(c[w] > 0 for w in x), sum(math.log10(uni(w)) for w in x), sum(math.log10(p(a, b)) for a, b in zip([b"\n", *x], x)))
    return out, n, (after, uni, c)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lm.op7_lm_backoff(spark, sf).collect()
    want, n, _ = plain(docs, [t for d, t in docs.items() if crc(d, 5) != 1])
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.train_tokens, r.n_tokens, r.n_known) == (crc(r.doc_id, 5) == 1, n, *w[:2])
        assert r.base_score == pytest.approx(w[2], rel=1e-9) and r.score == pytest.approx(w[3], rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_and_probabilities(spark):
    texts = ["a b c a b d", "a b c", "b c d e f", "the a b the a c", "z"] * 2
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    s = lm.Settings(held=6)
    m = lm.train(docs, s)
    test = {100: "a b c unseen a b z", 101: "", 102: None, 103: "f e d"}
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([(d, t) for d, t in test.items()], "doc_id long, text string"), m).collect()}
    want, n, (after, uni, c) = plain(test, texts, s)
    assert m.n == n and 0 < len(m.keys) < m.v and len(m.arc_keys)
    for d, w in want.items():
        assert (got[d].n_tokens, got[d].n_known) == w[:2] and got[d].base_score == pytest.approx(w[2]) and got[d].score == pytest.approx(w[3])
    whole = lm.train(docs)
    a, vocabulary = whole.automaton(), [*c, b"unseen"]
    key = lambda w: np.array([lm.key_of(w)])
    assert len(a.keys) == len(c) and whole.pair_bits is None
    for w in c:  # from every state, all known tokens and one unknown share out a probability of 1
        total = 0.0
        for x in vocabulary:
            score, base, read, rest = a.run(key(x), key(w), np.array([1]))
            total += 10 ** (score[0] + (0 if read[0] else math.log10(uni(x))))
        assert total == pytest.approx(1)


def test_odd_rows(spark):
    docs = odd_docs(spark, "k n h")
    m = lm.train(docs)
    out = lm.score(docs, m).collect()
    assert len(out) == docs.count() and min(r.n_tokens for r in out) == 1
    assert sum(r.n_tokens for r in out) == m.n and all(r.n_known == r.n_tokens for r in out)
    empty = lm.train(docs.limit(0))
    assert all(r.n_known == 0 and r.base_score == 0 for r in lm.score(docs, empty).collect())
    assert lm.score(docs.limit(0), m).count() == 0


def test_texts_of_one_id_keep_their_scores(spark):
    """Two texts without id whose hashes agree in their last 32 bits."""
    texts = ["w246684 a b c", "w375963"]
    both = spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id long, text string")
    assert both.select(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h")).distinct().count() == 1
    m = lm.train(both)
    alone = {lm.score(both.filter(F.col("text") == t).limit(1), m).select("n_tokens", "n_known", "score").first() for t in texts}
    got = lm.score(both, m).select("n_tokens", "n_known", "score").collect()
    assert len(got) == 4 and {(r[0], r[1], round(r[2], 9)) for r in got} == {(r[0], r[1], round(r[2], 9)) for r in alone} and {r[0] for r in got} == {5, 2}


def test_what_is_held_changes_no_score(spark):
    """Pairs beyond a share of the tokens count too, and those that the tasks don't hold add the same by the join."""
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [f"the {filler} {x} q r the" for x in "abcab"] + ["q r q r s t", "s t"]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    test = {100: "the q r s t unseen q r", 101: "", 102: None, 103: f"{filler} b q"}
    rows = spark.createDataFrame([(d, t) for d, t in test.items()], "doc_id long, text string")
    want, _, (after, _, _) = plain(test, texts)
    for s in (lm.Settings(), lm.Settings(held=12, held_arcs=2), lm.Settings(held=12, held_arcs=0), lm.Settings(held=0)):
        m = lm.train(docs, s)
        got = {r.doc_id: r for r in lm.score(rows.union(rows), m).collect()}
        assert len(m.arc_keys) <= s.held_arcs and (m.pair_bits is None) == (s == lm.Settings())
        assert len(m.arc_keys) + m.entries.filter("c IS NULL").count() == sum(map(len, after.values()))
        for d, w in want.items():
            assert (got[d].n_tokens, got[d].n_known) == w[:2]
            assert got[d].base_score == pytest.approx(w[2], rel=1e-9) and got[d].score == pytest.approx(w[3], rel=1e-9)


def test_runs_of_texts():
    """Texts in runs of bounded size give what they give alone; counts are handed on in parts."""
    texts = ["a b", None, "", "long " * 50, "x", "a b c"]
    column = pa.array(texts, pa.string())
    assert list(lm.batches(column, 20)) == [(0, 3), (3, 4), (4, 6)] and list(lm.batches(column.slice(0, 0))) == []
    keys, before, sizes = lm.read(column, lm.Words())
    assert sizes.tolist() == [len(toks(t)) for t in texts]
    want = [lm.key_of(w) for t in texts for w in toks(t)]
    assert keys.tolist() == want and before.tolist() == [lm.key_of(w) for t in texts for w in [b"\n", *toks(t)[:-1]]]
    held = np.sort(np.unique(keys)[:3])
    assert [int(held[i]) if i >= 0 else None for i in lm.find(held, keys)] == [k if k in held else None for k in want]
    most, lm.Words.MOST = lm.Words.MOST, 2
    try:
        assert lm.read(column, lm.Words())[0].tolist() == want
    finally:
        lm.Words.MOST = most


def test_counts_travel_packed(spark):
    """What is dealt between tasks takes few bytes and few rows, and comes back as it was."""
    rng = np.random.default_rng(3)
    for k in (np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 500)), np.array([-(1 << 63), -1, 0, (1 << 63) - 1]), np.zeros(0, np.int64)):
        n, x = rng.integers(-5, 5, len(k)), rng.normal(size=len(k))
        back = lm.unpack(lm.pack(k, n, x), np.int64, np.int64, np.float64)
        assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(back, (k, n, x)))
    a, b = rng.zipf(1.3, 40_000) % 20_000, rng.integers(0, 20_000, 40_000)
    k, n = np.unique(a << 21 | b, return_counts=True)
    assert len(lm.pack(k, np.zeros_like(k), n)) < 4 * len(k)  # 24 bytes a row, and 10 in a shuffle, before
    docs = spark.createDataFrame([(" ".join(f"w{i * 7 % 997}" for i in range(j, j + 400)),) for j in range(50)], "text string")
    found = {r.k: r.n for r in lm._sums(docs, lm.Singles).collect()}
    want = Counter(w for r in docs.collect() for w in toks(r.text))
    assert found == {lm.key_of(w): n for w, n in want.items()}


def test_words_of_any_length_have_keys_of_their_own():
    words = [b"a" * i for i in range(1, 140)] + [b"a" * i + b"\x00" for i in range(140)] + ["é".encode() * 33, "É".encode() * 33]
    column = pa.array([b" ".join(words).upper().decode("utf-8"), " \t\x0b\x0c a\x1cb\u0085 "])
    keys, before, sizes = lm.read(column, lm.Words())
    assert sizes.tolist() == [len(words) + 1, 2] and len(set(keys.tolist())) == len(set(words)) + 2
    assert keys.tolist() == [lm.key_of(w) for w in [*words, b"\n", "a\x1cb\u0085".encode(), b"\n"]]
