import random
import re
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from trialforge.llm import dedup

from .helpers import DOCS, odd_docs


def plain(docs, words, percent):
    """Brute force over all pairs: doc_id to (n_shingles, component); ids are distinct."""
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in docs if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = dedup.op4_minhash_dedup(spark, f"/root/testdata/{sf}").collect()
    want = plain(docs, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len({c for _, c in want.values()}) < len(docs)


def test_families_and_passages(spark):
    """Chains of edits, a large group of near copies, and many documents around one passage."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(5000)}"
    passage, docs, n = [word() for _ in range(60)], {}, 0
    for _ in range(60):
        docs[n := n + 1] = " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])
    base = [word() for _ in range(90)]
    for _ in range(60):
        t = list(base)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(90)] = word()
        docs[n := n + 1] = " ".join(t)
    chain = [word() for _ in range(120)]
    for i in range(0, 60, 2):
        chain[i] = word()
        docs[n := n + 1] = " ".join(chain)
    rows = [(d, t, None, None, 0) for d, t in docs.items()]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS)
    for s in (dedup.CONTRACT, dedup.Settings(), dedup.Settings(words=3, percent=85, k=16, stars=1, long=5, block=25), replace(dedup.CONTRACT, **dedup.EXACT)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_groups(df, s).collect()}
        assert got == plain(docs, s.words, s.percent)


def test_odd_rows(spark):
    docs = odd_docs(spark, "id rep")
    out = dedup.near_groups(docs).collect()
    assert len(out) == docs.count()
    same = {r.component_id for r in out if r.doc_id in (6, 7)}
    assert same == {6}
    assert {(r.doc_id, r.component_id) for r in out if not r.n_shingles} == {(d, d) for d in (0, 1, 2)}
    assert {r.component_id for r in out if r.doc_id is None} == {None}
    kept = dedup.drop_near_copies(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 6 in ids and 7 not in ids
    assert dedup.near_groups(docs.limit(0)).count() == 0 and dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (205, 203), (203, 209)]
    got = {r.node: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[209] == 203


def test_rows_of_one_id(spark):
    """Null and repeated ids: only near copies go, row by row."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, text(i)) for i in range(5)] + [(7, text(i)) for i in range(5, 10)] + [(8, None), (8, None), (None, ""), (None, None)]
    rows += [(7, text(20)), (3, text(20)), (9, text(5)), (None, text(30)), (1, text(30) + " end"), (None, text(0))]
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in dedup.drop_near_copies(docs).collect()), key=repr)
    want = rows[:14] + [(3, text(20)), (None, text(30))]
    assert kept == sorted(want, key=repr)


def test_wide_lists_are_filed_anew(spark):
    """A passage that is half of 300 texts, in which pairs of near copies hide: no pair of texts by the passage alone."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage, docs = [word() for _ in range(60)], {}
    for i in range(150):
        own = [word() for _ in range(50)]
        docs[2 * i] = " ".join(own + passage)
        if i % 3:
            docs[2 * i + 1] = " ".join([word(), *own[1:], *passage])
    df = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string")
    s = dedup.Settings(words=3, percent=85, k=8, stars=0, long=4, wide=10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_groups(df, replace(s, sigmas=1e5)).collect()}
    assert got == plain(docs, 3, 85)
    sets = dedup.with_shingles(df.withColumnRenamed("doc_id", "rep"), 3)
    members = sets.selectExpr("rep", "size(s) n", "rep label")
    assert dedup._filed_anew(members, sets.select("rep", "s"), s).agg({"size": "max"}).first()[0] == 2


def test_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(700_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "x" * 5_000_000), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_groups(df).collect()}
    assert got == {1: (699_996, 1), 2: (699_997, 1), 3: (1, 3), 4: (0, 4)}


def test_a_third_without_ids_and_repeated_ids(spark):
    """Rows that share an id, or have none, are texts of their own: components by plain search, kept never null."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[1].split()
            text[rng.randrange(len(text))] = rng.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(rng.choice(words) for _ in range(40))
        rows.append((rng.choice([None, 7, i]), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.near_groups(docs, dedup.CONTRACT).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).collect()
    sets = [{tuple(t.split()[i : i + 3]) for i in range(38)} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is not None, d or 0)
        least[find(i)] = min(least.get(find(i), key), key)
    want = sorted((str(d), len(sets[i]), str(least[find(i)][1] if least[find(i)][0] else None)) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want and all(r.kept is not None for r in got)
