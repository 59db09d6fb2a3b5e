"""Resolving labels to canonical names, evidence about them, and its conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STEM_SUFFIX

#: Longest suffix that a stem may lack: digits, a letter and a side.
MOST_SUFFIX = 6


def stems(names: DataFrame, name: str = "name") -> DataFrame:
    """stem, name: every way to cut a recognised suffix off a name, so that the prefix join is an equi join."""
    cut = names.select(F.col(name).alias("name"), F.explode(F.sequence(F.lit(1), F.least(F.length(name) - 1, F.lit(MOST_SUFFIX)))).alias("n")).filter("n >= 1")
    cut = cut.select("name", F.expr("substring(name, 1, length(name) - n)").alias("stem"), F.expr("substring(name, length(name) - n + 1, n)").alias("suffix"))
    return cut.filter(F.col("suffix").rlike(STEM_SUFFIX)).select("stem", "name", "suffix")


def _without_one(c: str):
    """A text and all that it is with one character less."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.expr(f"substring({c}, 1, 0)"), F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c))))))


def within_one_edit(a: DataFrame, b: DataFrame) -> DataFrame:
    """left, right from a(left) and b(right): different texts that one substitution, insertion, deletion or swap of
    neighbours turns into each other. Such texts share a text with a character less, which is what they are joined on."""
    x = a.filter("length(left) > 0").select("left", F.explode(_without_one("left")).alias("part"))
    y = b.filter("length(right) > 0").select("right", F.explode(_without_one("right")).alias("part"))
    pairs = x.join(y, "part").select("left", "right").distinct().filter("left <> right")
    i = F.length(F.expr("regexp_extract(concat(left, '\\u0000', right), '^(.*).*\\u0000\\\\1', 1)"))
    swap = F.concat(F.substring(F.col("left"), F.lit(1), i), F.substring(F.col("left"), i + 2, F.lit(1)), F.substring(F.col("left"), i + 1, F.lit(1)), F.substring(F.col("left"), i + 3, F.length("left")))
    return pairs.filter((F.levenshtein("left", "right") <= 1) | ((F.length("left") == F.length("right")) & (swap == F.col("right"))))


def resolve(labels: DataFrame, names: DataFrame) -> DataFrame:
    """label, status, kind, candidates from distinct labels and canonical names.

    In turn: the name itself, the only name that differs in case, the names that extend the label as a stem (two or
    more: ambiguous), else unresolved.
    """
    exact = names.select(F.col("name").alias("label"), F.lit(True).alias("exact"))
    fold = names.groupBy(F.lower("name").alias("folded")).agg(F.count("*").alias("n"), F.min("name").alias("variant")).filter("n = 1")
    ext = stems(names).groupBy(F.col("stem").alias("label")).agg(F.array_sort(F.collect_set("name")).alias("members")).filter("size(members) >= 2")
    x = labels.select("label").distinct().join(exact, "label", "left").withColumn("folded", F.lower("label")).join(fold, "folded", "left").join(ext, "label", "left")
    kind = F.when(F.col("exact"), "exact").when(F.col("variant").isNotNull(), "case_variant").when(F.col("members").isNotNull(), "class_label")
    found = F.when(F.col("exact"), F.array("label")).when(F.col("variant").isNotNull(), F.array("variant")).otherwise(F.coalesce("members", F.array().cast("array<string>")))
    status = F.when(F.col("exact"), "exact").when(F.col("variant").isNotNull(), "alias").when(F.col("members").isNotNull(), "ambiguous").otherwise("unresolved")
    return x.select("label", status.alias("status"), kind.alias("kind"), found.alias("candidates"))


def fan_out(evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """evidence with neuron_id: one row per candidate of its label, ambiguous_assignment where there are several."""
    x = evidence.join(resolved, "label")
    return x.withColumn("ambiguous_assignment", F.size("candidates") > 1).withColumn("neuron_id", F.explode("candidates"))


def merge_aliases(tables: DataFrame) -> DataFrame:
    """One row per alias and name from (alias, name, kind, priority, source): the kind of least priority, all sources, and
    how many names the alias has."""
    x = tables.groupBy("alias", "name").agg(F.min_by("kind", F.struct("priority", "kind")).alias("kind"), F.array_sort(F.collect_set("source")).alias("observed_in"))
    n = x.groupBy("alias").agg(F.count("*").alias("n_candidates"))
    return x.join(n, "alias").withColumn("ambiguous", F.col("n_candidates") > 1)


def single_valued_conflicts(evidence: DataFrame) -> DataFrame:
    """neuron_id, attribute, kind, severity, values: where sources differ (hard), or one source says several things (soft)."""
    by = evidence.groupBy("neuron_id", "attribute").agg(F.array_sort(F.collect_set("value")).alias("values"), F.array_sort(F.collect_set(F.struct("source", "value"))).alias("said")).filter("size(values) > 1")
    across = F.size(F.array_distinct(F.transform("said", lambda s: s["source"]))) > 1
    # With several sources and several values, two of different sources differ unless one source says all of it.
    return by.select("neuron_id", "attribute", F.when(across, "values_differ_across_sources").otherwise("several_values_in_one_source").alias("kind"), F.when(across, "hard").otherwise("soft").alias("severity"), "values")


def set_conflicts(evidence: DataFrame, wildcard: str, ignored: str) -> DataFrame:
    """Conflicts between the sources' sets of values: disjoint (hard), or overlapping but different (soft); wildcard
    overlaps with anything, ignored values don't count."""
    sets = evidence.filter(F.col("value") != ignored).groupBy("neuron_id", "attribute", "source").agg(F.array_sort(F.collect_set("value")).alias("v"))
    a, b = sets.select("neuron_id", "attribute", "source", "v"), sets.select("neuron_id", "attribute", F.col("source").alias("source2"), F.col("v").alias("v2"))
    pairs = a.join(b, ["neuron_id", "attribute"]).filter((F.col("source") < F.col("source2")) & (F.col("v") != F.col("v2")))
    loose = F.arrays_overlap("v", "v2") | F.array_contains("v", wildcard) | F.array_contains("v2", wildcard)
    worst = pairs.groupBy("neuron_id", "attribute").agg(F.bool_and(loose).alias("soft"))
    return worst.select("neuron_id", "attribute", F.when(F.col("soft"), "type_sets_overlap_but_differ").otherwise("type_sets_disjoint").alias("kind"), F.when(F.col("soft"), "soft").otherwise("hard").alias("severity"))


def wide(evidence: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per neuron: for each attribute its values and sources, sorted, and the number of evidence rows."""
    cols = []
    for a in attributes:
        on = F.col("attribute") == a
        cols += [F.array_sort(F.collect_set(F.when(on, F.col("value")))).alias(f"{a}_values"), F.array_sort(F.collect_set(F.when(on, F.col("source")))).alias(f"{a}_sources")]
    return evidence.groupBy("neuron_id").agg(*cols, F.count("*").alias("n_evidence"))
