"""Suffix sorting against sorted(), and repeated passages against all strings of the width."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.llm import repeats
from trialforge.llm.queries import oracle_sql, queries
from trialforge.llm.suffixes import common_prefix_reaches, suffix_array

from tests.llm.helpers import odd_docs
from tests.test_queries import canon


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc\n ", bytes(range(245)), bytes(3)])
def test_suffix_array(letters):
    rng = random.Random(1)
    for _ in range(150):
        data = bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 30, 300])))
        assert suffix_array(data, len(data) + 1).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_order_to_a_depth_keeps_equal_starts_together():
    rng = random.Random(2)
    block = bytes(rng.choice(b"ab \n") for _ in range(300))
    data = block + b"x" * 40 + block[20:] + b"zzzz" + block * 2
    order = suffix_array(data, 50)
    order = order[order <= len(data) - 50]
    assert [data[i : i + 50] for i in order] == sorted(data[i : i + 50] for i in range(len(data) - 49))
    shared = common_prefix_reaches(np.frombuffer(data, np.uint8), order[:-1], order[1:], 50)
    assert shared.tolist() == [data[i : i + 50] == data[j : j + 50] for i, j in zip(order[:-1], order[1:])]


def brute(texts, width):
    """Per text: removed bytes, runs, digest of the rest."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, dtype=bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        kept = bytes(c for c, g in zip(r, gone[1:]) if not g)
        out.append((int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=120, letters="ab cé"):
    make = lambda size: "".join(rng.choice(letters) for _ in range(size))
    passages = [make(rng.choice([15, 24, 25, 60, 200])) for _ in range(6)]
    texts = [None, "", "a" * 300, "a" * 300, "ab" * 200, make(5)]
    for _ in range(n):
        texts.append("".join(rng.choice([make(rng.randint(0, 40)), rng.choice(passages)]) for _ in range(rng.randint(0, 5))))
    return texts + rng.sample(texts, 20)


@pytest.mark.parametrize("most", [10**6, 3])
def test_passages_by_definition(spark, most):
    """With most = 3 nearly all anchors are told apart by longer grams, down to whole strings."""
    texts = corpus(random.Random(most))
    width = 24
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumns({"key": F.lit(1), "g": F.lit("x"), "spans": F.col("i")})
    found = {bytes(r["key"]): r for r in repeats.repeated_passages(docs, width, most).collect()}
    for t, (removed, runs, digest) in zip(texts, brute(texts, width)):
        r = found.get(hashlib.md5((t or "").encode()).digest())
        spans = [tuple(s) for s in r["spans"]] if r else []
        assert (sum(e - s for s, e in spans), len(spans)) == (removed, runs)
        assert not r or hashlib.sha256(r["kept"]).hexdigest() == digest and r["n_bytes"] == len(t.encode())


def run(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return queries()["op11_suffix_dedup"](spark, str(path)).toPandas()


def test_query_against_all_strings(spark, sf, tmp_path):
    """The smallest table with awkward rows: null, empty and repeated texts, near copies, clashing columns."""
    more = spark.createDataFrame([(-1, "q" * 5000), (-2, "x" * 399), (-2, "x" * 399)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(more).unionByName(odd_docs(spark).select("doc_id", "text")).withColumn("key", F.lit(0))
    got = run(spark, docs, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert canon(got) == canon(con.execute(oracle_sql()["op11_suffix_dedup"]).df())


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(2_000_000))
    rows = [(None, long), (1, long[800_000:]), (2, "q" * 300_000), (3, "abcdefg " * 100_000), (4, long[:399])]
    got = run(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    assert {r.n_bytes: (r.n_removed, r.n_spans) for r in got.itertuples()} == {2_000_000: (1_200_000, 1), 1_200_000: (1_200_000, 1), 300_000: (300_000, 1), 800_000: (800_000, 1), 399: (0, 0)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()["op11_suffix_dedup"](spark, str(tmp_path)).count() == 0
