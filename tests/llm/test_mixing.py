import pytest

from trialforge.llm import mixing

from .helpers import DOCS, odd_docs


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Deal, stop the full ones, deal the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, set(names)
    while left:
        level = (share * sum(sizes.values()) - sum(full.values())) / sum(w[s] for s in left)
        above = {s for s in left if level * w[s] > cap * sizes[s]}
        if not above:
            return full | {s: level * w[s] for s in left}
        full |= {s: cap * sizes[s] for s in above}
        left -= above
    return full


def test_targets_and_copies(spark, sf):
    rows = mixing.op5_systematic_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text)])
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        targets[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    largest = max(r.size for r in rows)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest
    assert rows and sorted(rows) == sorted(mixing.op5_systematic_mix(spark, sf).collect())


def test_odd_rows(spark):
    docs = odd_docs(spark, "taken __size")
    out = mixing.systematic_mix(docs.drop("__size"))
    assert out.count() == docs.count() and out.columns.count("taken") == 1
    assert out.filter("text is null and (size <> 0 or taken <> 0)").count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == out.agg({"copies": "sum"}).first()[0]
    empty = spark.createDataFrame([], DOCS)
    assert mixing.systematic_mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_many_sources_and_caps(spark):
    rows = [(i, "w " * (1 + i % 7), None, f"s{i % 11}" if i % 12 else None, 0) for i in range(300)]
    rows += [(1000 + i, "big " * 500, None, "zz", 0) for i in range(4)]
    out = mixing.systematic_mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
