"""Operators that work text by text on texts of five million characters, beside short ones."""

import math

import pytest

from trialforge.llm import chat, lm, mixing, pii, quality

from .helpers import DOCS

LONG = "Some ordinary words, and again some words. " * 116_280


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "en", "a", len(LONG)), (2, "a short text of some words", "en", "a", 26), (3, "x" * 5_000_000, "en", "b", 5_000_000), (4, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert set(scores) == {1, 2, 3, 4} and all(0 <= x <= 1 for x in scores.values())


def test_fit_is_bounded(spark, docs):
    """Rows that go beyond the bound on n-grams are left out; with none left the score is one for all."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    m = quality.train(docs, labels, quality.Settings(max_grams=1))
    assert {r.score for r in quality.score(docs, m).collect()} == {0.5}


def test_repeated_ids_count_once(spark):
    rows = spark.createDataFrame([(1, "good text here", None, None, 0)] * 40 + [(1, "other", None, None, 0), (2, "bad", None, None, 0)], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    m = quality.train(rows, labels)
    assert 0 < m.score("good text here") < 1 and (m.ratios != 0).any()


def test_mixing(docs):
    got = {r.doc_id: r for r in mixing.systematic_mix(docs).collect()}
    assert got[1].size == 7 * 116_280 and got[3].size == 1 and got[4].size == 0 and got[1].taken <= 2 * got[1].size


def test_language_model(docs):
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs)).collect()}
    assert got[1].n_tokens == 7 * 116_280 + 1 == got[1].n_known and got[3].n_tokens == 2 and got[4].n_tokens == 1
    assert got[1].score > got[1].base_score and all(math.isfinite(r.score) for r in got.values())


def test_personal_data(docs):
    assert {r.doc_id: r.pii for r in pii.pii_spans(docs).collect()} == {1: [], 2: [], 3: [], 4: []}


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "<|im_end|>"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len(LONG) + 10 and got[2].loss_chars == 0


@pytest.mark.parametrize("run", [lambda d: pii.pii_spans(d, ("pii",)), lambda d: quality.score(d, quality.fit([], []), ("score",))])
def test_clashing_names_are_refused(docs, run):
    with pytest.raises(ValueError, match="renamed"):
        run(docs.withColumn("pii", docs["doc_id"]).withColumn("score", docs["doc_id"]))
