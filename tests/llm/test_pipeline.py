"""The pipeline's stages against brute force, each on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline
from trialforge.llm import quality

from .test_dedup import plain as plain_groups
from .test_mixing import plain_targets
from .test_packing import well_packed
from .test_secrets import plain as plain_secrets


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    start, good, single, clean, mix, packed = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in good}
    judged = [(labels[r.doc_id], r.doc_id in left) for r in start if r.doc_id in labels]
    assert sum(bool(y) == x for y, x in judged) / len(judged) > 0.97
    groups = plain_groups({r.doc_id: r.text for r in good}, 5, 80)
    assert {r.doc_id for r in single} == {c for _, c in groups.values()} and len(single) == len({r.doc_id for r in single})
    before = {r.doc_id: r for r in single}
    assert {r.doc_id for r in clean} == set(before)
    owners = {}
    values = lambda t: [m[0] for m in re.finditer("[0-9a-f]{24,}", t)]
    for r in single:
        for v in values(r.text):
            owners.setdefault(v, set()).add(r.source)
    for r in clean:
        live = [v for v in values(before[r.doc_id].text) if len(owners[v]) < 3]
        assert not any(v in r.text for v in live) and r.n_chars == len(r.text)
        if not plain_secrets(before[r.doc_id].text):
            assert r == before[r.doc_id]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r.source] += size(r.text)
    for r in mix:
        taken[r.source] += size(r.text)
    want, largest = plain_targets(dict(sizes)), max(size(r.text) for r in clean)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes) and max(Counter(r.doc_id for r in mix).values()) <= 2
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mix)
    assert well_packed(packed) <= 1.02 * sum(r.length for r in packed) / 1024 + 1


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and well_packed(rows)
    assert quality.THRESHOLD == 0.7 and len(corpus_pipeline.STAGES) == 5
