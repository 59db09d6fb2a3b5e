import hashlib
import random
import re

import xxhash

from trialforge.llm import simhash

from .helpers import DOCS, odd_docs


def plain(docs):
    """doc_id to (n_chars, hash of the edited text), by the contract; ids are distinct."""
    order = sorted(docs)
    out = {}
    for i, d in enumerate(order):
        t, nxt = docs[d] or "", docs[order[(i + 1) % len(order)]] or ""
        q = len(t) // 4
        out[d] = (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest())
    return out


def test_edit_and_likeness(spark, sf):
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain(docs)
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == want
    by_text, order = {}, sorted(got)
    for i, d in enumerate(order):
        r, n = got[d], got[order[(i + 1) % len(order)]]
        assert by_text.setdefault(docs[d], r.fingerprint) == r.fingerprint
        same = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint) and r.near_next == same(r.fingerprint, n.fingerprint)
    prints = {int(r.fingerprint, 16) for r in got.values()}
    for r in got.values():
        x = int(r.fingerprint, 16)
        assert r.n_near == sum(0 < (x ^ y).bit_count() <= 3 for y in prints)
    mean = lambda k: sum(getattr(r, k) for r in got.values()) / len(got)
    assert mean("near_edited") > 0.72 > 0.6 > mean("near_next")


def test_blocks_of_far_ids(spark):
    ids = [-5000, -1, 0, 255, 256, 257, 99999, 5 << 20, (5 << 20) + 1, 1 << 40]
    docs = {d: f"text number {i} has some words " * (i + 1) for i, d in enumerate(ids)}
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in docs.items()], DOCS)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in simhash.fingerprint_pairs(df).collect()} == plain(docs)


def test_odd_rows(spark):
    docs = odd_docs(spark, "block fp")
    out = simhash.fingerprint_pairs(docs)
    assert out.count() == docs.count()
    assert out.filter("n_chars = 0 and fp <> 0").count() == 0
    assert simhash.fingerprint_pairs(docs.limit(0)).count() == 0
    one = simhash.fingerprint_pairs(docs.filter("doc_id = 4").limit(1)).collect()
    assert len(one) == 1 and one[0].fp == one[0].next_fp


def test_within_radius(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for k in (1, 2, 3, 4):
            x = b
            for i in rnd.sample(range(64), k):
                x ^= 1 << i
            prints.add(x)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(s,) for s in [*signed, signed[0]]], "fp long")
    assert sorted((r.a, r.b) for r in simhash.within_radius(df).collect()) == sorted(want)
    far = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert sorted((r.a, r.b) for r in simhash.within_radius(df, 2, 1).collect()) == sorted(far)


def test_dense_keys(spark):
    """A thousand fingerprints of one template: half of the bits the same, so some tables have one key for all."""
    rnd = random.Random(8)
    base = rnd.getrandbits(64)
    prints = {base ^ rnd.getrandbits(22) for _ in range(900)} | {rnd.getrandbits(64) for _ in range(50)}
    assert len(prints) > 3 * simhash.DENSE
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    assert sorted((r.a, r.b) for r in simhash.within_radius(df).collect()) == want
    counts = {r.fp: r.n_near for r in simhash.near_counts(df).collect()}
    assert counts == {x: n for x in signed if (n := sum(x in p for p in want))}


def plain_print(text):
    """The fingerprint by definition: each pair of neighbouring words votes with its hash's bits, by its length."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    votes = [0] * 64
    for i, a in enumerate(words):
        b = words[i + 1] if i + 1 < len(words) else None
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        w = min(24, len(a) + len(b or ""))
        for k in range(64):
            votes[k] += w if h >> k & 1 else -w
    return sum(1 << k for k in range(64) if votes[k] > 0)


def test_fingerprints_by_definition(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    docs |= {-1: None, -2: "", -3: "one", -4: "Same same SAME", -5: "näïve 🙂 wörd " * 50, -6: "long text of words " * 260_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in simhash.fingerprints(df, ["doc_id"]).collect():
        assert r.fp & (1 << 64) - 1 == plain_print(docs[r.doc_id]), r.doc_id
