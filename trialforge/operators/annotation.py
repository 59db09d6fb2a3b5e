"""Building annotations: alias tables, reasons for labels that name no neuron, transmitter conflicts and typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entity import stems
from .graph import symmetrise

#: Transmitters that are compared apart.
CLASSICAL = ("ACh", "Glu", "GABA")
MONOAMINES = ("dopamine", "serotonin", "octopamine", "tyramine")
#: Fixed value: the order of edge kinds.
KINDS = ("chem", "gap", "nmj", "putative_mod")


def _stem_reason(suffixes: Column) -> Column:
    """Why a stem is ambiguous, from all suffixes it lacks."""
    all_are = lambda pattern: F.forall(suffixes, lambda s: s.rlike(pattern))
    members = F.concat(F.lit("class label with "), F.size(suffixes).cast("string"), F.lit(" members"))
    return (
        F.when(all_are("^[LR]$"), "left/right not specified")
        .when(all_are("^[DV][LR]$"), "dorsal/ventral and left/right not specified")
        .when(all_are(r"^\d+$"), "member number of a numbered series not specified")
        .otherwise(members)
    )


def derive_aliases(observed: DataFrame, names: DataFrame, conventions: DataFrame | None = None) -> DataFrame:
    """alias, name, kind, ambiguous, n_candidates, reason, observed_in from observed (label, source) and canonical names (name).

    The first rule that maps a label counts: a convention (label, name, reason) with a canonical name, a zero in front
    of the series number, the only name that differs in case, the stem of two names or more. Canonical labels and
    those no rule maps give no row. Every rule is an equi join on a key made from the label or the name.
    """
    seen = observed.groupBy("label").agg(F.array_sort(F.collect_set("source")).alias("observed_in")).join(names.withColumnRenamed("name", "label"), "label", "left_anti")
    plain = F.regexp_extract("label", "^([A-Za-z]+)0(\\d+)$", 1)
    padded = seen.withColumn("name", F.concat(plain, F.regexp_extract("label", "^([A-Za-z]+)0(\\d+)$", 2))).filter(plain != "").join(names, "name")
    fold = names.groupBy(F.lower("name").alias("f")).agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n = 1")
    cased = seen.withColumn("f", F.lower("label")).join(fold, "f")
    groups = stems(names).groupBy(F.col("stem").alias("label")).agg(F.collect_list(F.struct("name", "suffix")).alias("m")).filter("size(m) > 1")
    classes = seen.join(groups, "label").withColumn("reason", _stem_reason(F.transform("m", lambda x: x["suffix"])))
    rows = [
        padded.select("label", "name", F.lit(1).alias("rule"), F.lit("zero_padded").alias("kind"), F.lit("leading zero in the series number").alias("reason"), "observed_in"),
        cased.select("label", "name", F.lit(2).alias("rule"), F.lit("case_variant").alias("kind"), F.lit("differs only in letter case").alias("reason"), "observed_in"),
        classes.select("label", F.explode("m.name").alias("name"), F.lit(3).alias("rule"), F.lit("class_label").alias("kind"), "reason", "observed_in"),
    ]
    if conventions is not None:
        agreed = seen.join(conventions, "label").join(names, "name", "left_semi")
        rows.insert(0, agreed.select("label", "name", F.lit(0).alias("rule"), F.lit("convention").alias("kind"), "reason", "observed_in"))
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    first = found.groupBy("label").agg(F.min("rule").alias("rule"))
    found = found.join(first, ["label", "rule"])
    counts = found.groupBy("label").agg(F.count("*").cast("int").alias("n_candidates"))
    ambiguous = F.col("kind").isin("convention", "class_label")
    return found.join(counts, "label").select(F.col("label").alias("alias"), "name", "kind", ambiguous.alias("ambiguous"), "n_candidates", "reason", "observed_in")


def resolve_by_table(labels: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """label, status, candidates, kind, reason of distinct labels: canonical names are exact, others as the alias table
    (alias, name, kind, ambiguous, reason) has them; its first row by name gives kind and reason."""
    exact = names.select(F.col("name").alias("label"), F.lit(True).alias("exact"))
    first = F.min_by(F.struct("kind", "reason", "ambiguous"), "name")
    held = aliases.groupBy(F.col("alias").alias("label")).agg(F.array_sort(F.collect_list("name")).alias("found"), first.alias("first"))
    x = labels.select("label").distinct().join(exact, "label", "left").join(held, "label", "left")
    one = (F.size("found") == 1) & ~F.col("first.ambiguous")
    status = F.when(F.col("exact"), "exact").when(F.col("found").isNull(), "unresolved").when(one, "alias").otherwise("ambiguous")
    candidates = F.when(F.col("exact"), F.array("label")).otherwise(F.coalesce("found", F.array().cast("array<string>")))
    reason = F.when(F.col("exact"), "canonical neuron name").otherwise(F.coalesce("first.reason", F.lit("")))
    return x.select("label", status.alias("status"), candidates.alias("candidates"), F.when(~F.coalesce("exact", F.lit(False)), F.col("first.kind")).alias("kind"), reason.alias("reason"))


def non_neuron_reasons(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """label and reason of the labels that name known other cells (name, description): one cell in any letter case, or
    the stem of two or more. Labels of under three characters are never stems."""
    told = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("no description"))
    x = labels.select("label").distinct().withColumn("f", F.lower("label"))
    same = cells.groupBy(F.lower("name").alias("f")).agg(F.min_by(F.struct("name", "description"), "name").alias("cell"))
    case = F.when(F.col("cell.name") == F.col("label"), "").otherwise(F.concat(F.lit(" (case differs from "), F.col("cell.name"), F.lit(")")))
    named = x.join(same, "f").select("label", F.concat(F.lit("known non-neuron cell: "), told(F.col("cell.description")), case).alias("reason"))
    members = F.array_sort(F.collect_set(F.struct("name", "description")))
    families = stems(cells).join(cells, "name").groupBy(F.lower("stem").alias("f")).agg(members.alias("m")).filter("size(m) > 1")
    listed = F.array_join(F.slice(F.transform("m", lambda c: c["name"]), 1, 4), ", ")
    text = F.concat(F.lit("class-level label of non-neuron cells ("), listed, F.lit("): "), told(F.col("m")[0]["description"]))
    classes = x.filter("length(label) >= 3").join(families, "f").select("label", text.alias("reason")).join(named, "label", "left_anti")
    return named.unionByName(classes)


def transmitter_conflicts(evidence: DataFrame, full: str = "", listing: str = "") -> DataFrame:
    """neuron_id, kind, severity: conflicts in evidence of transmitters (neuron_id, source, role, value).

    Classical ones, of roles dominant and reported, are compared between each two sources that name any: overlapping
    sets that differ (soft), a set that is within the other's alternatives (soft), or neither (hard, and then that is
    the verdict; else the first pair of sources gives it). Monoamines are compared between the source full, where it
    has any row, and the source listing, whose silence counts: disjoint (hard) or otherwise different (soft).
    """
    within = lambda roles, values: F.array_sort(F.collect_set(F.when(F.col("role").isin(*roles) & F.col("value").isin(*values), F.col("value"))))
    every = ("dominant", "reported", "alternative", "monoamine_source")
    sets = evidence.filter(F.col("role").isin(*every)).groupBy("neuron_id", "source").agg(within(every[:2], CLASSICAL).alias("main"), within(every[2:3], CLASSICAL).alias("alt"), within(every, MONOAMINES).alias("mono"))
    a = sets.filter("size(main) > 0").select("neuron_id", "source", "main", "alt")
    b = a.select("neuron_id", F.col("source").alias("source2"), F.col("main").alias("main2"), F.col("alt").alias("alt2"))
    pairs = a.join(b, "neuron_id").filter("source < source2 and main <> main2")
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    kind = F.when(F.arrays_overlap("main", "main2"), "classical_sets_overlap_but_differ").when(inside("main2", "alt") | inside("main", "alt2"), "dominant_matches_alternative_only").otherwise("classical_transmitter_differs")
    hard = F.col("kind") == "classical_transmitter_differs"
    verdict = pairs.withColumn("kind", kind).groupBy("neuron_id").agg(F.min_by("kind", F.struct(~hard, "source", "source2")).alias("kind"), F.bool_or(hard).alias("hard"))
    classical = verdict.select("neuron_id", "kind", F.when(F.col("hard"), "hard").otherwise("soft").alias("severity"))
    one = sets.filter(F.col("source") == full).select("neuron_id", "mono")
    other = sets.filter(F.col("source") == listing).select("neuron_id", F.col("mono").alias("mono2"))
    both = one.join(other, "neuron_id", "left").withColumn("mono2", F.coalesce("mono2", F.array().cast("array<string>"))).filter("mono <> mono2")
    disjoint = (F.size("mono") > 0) & (F.size("mono2") > 0) & ~F.arrays_overlap("mono", "mono2")
    amines = both.select("neuron_id", F.when(disjoint, "monoamine_sets_disjoint").otherwise("monoamine_reported_by_one_source_only").alias("kind"), F.when(disjoint, "hard").otherwise("soft").alias("severity"))
    return classical.unionByName(amines)


def type_edges(raw: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and drops from raw edges (row, layer, pre, post, weight, sign_raw) and what each label is: ends (label,
    what: neuron, muscle or drop; id; reason).

    Edges: source, target, kind, target_kind, weight, n_rows, signs, raw_pre and raw_post of the first row (row may be a
    struct, for an order that leaves no ties), added (a junction's missing reverse). Modulatory edges run between neurons,
    neuromuscular ones from neuron to muscle. Drops: reason, n. Sort edges by kind_order, source and target for the published order.
    """
    at = lambda c, p: ends.select(F.col("label").alias(c), F.col("what").alias(f"{p}_what"), F.col("id").alias(f"{p}_id"), F.col("reason").alias(f"{p}_reason"))
    x = raw.join(at("pre", "s"), "pre", "left").join(at("post", "t"), "post", "left")
    s, t = F.coalesce("s_what", F.lit("drop")), F.coalesce("t_what", F.lit("drop"))
    lost = F.when(s == "drop", F.coalesce("s_reason", F.lit("unknown_label"))).when(t == "drop", F.coalesce("t_reason", F.lit("unknown_label")))
    pair = F.concat(F.col("layer"), F.lit(":"), s, F.lit("_to_"), t)
    kind = F.when(lost.isNotNull(), None).when((s == "neuron") & (t == "neuron"), F.when(F.col("layer") == "mod", "putative_mod").otherwise(F.col("layer"))).when((s == "neuron") & (t == "muscle") & (F.col("layer") != "mod"), "nmj")
    mirror = (s == "muscle") & (t == "neuron") & (F.col("layer") == "gap")
    why = F.when(lost.isNotNull(), F.concat(F.col("layer"), F.lit(":"), lost)).when(mirror, "gap:mirror_of_neuron_to_muscle").otherwise(pair)
    x = x.withColumns({"kind": kind, "why": why, "target_kind": t})
    drops = x.filter("kind is null").groupBy(F.col("why").alias("reason")).agg(F.count("*").alias("n"))
    keys = [F.col("s_id").alias("source"), F.col("t_id").alias("target"), "kind", "target_kind"]
    first = F.min_by(F.struct("pre", "post"), "row")
    edges = x.filter("kind is not null").groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count("*").alias("n_rows"), F.array_sort(F.collect_set("sign_raw")).alias("signs"), first.alias("first"))
    edges = edges.select("source", "target", "kind", "target_kind", "weight", "n_rows", "signs", F.col("first.pre").alias("raw_pre"), F.col("first.post").alias("raw_post"))
    gaps = symmetrise(edges.filter("kind = 'gap'"), "source", "target")
    turned = lambda c, o: F.when(F.col("added"), F.col(o)).otherwise(F.col(c)).alias(c)
    gaps = gaps.select("source", "target", "kind", "target_kind", "weight", F.when(F.col("added"), 0).otherwise(F.col("n_rows")).alias("n_rows"), "signs", turned("raw_pre", "raw_post"), turned("raw_post", "raw_pre"), "added")
    return edges.filter("kind <> 'gap'").withColumn("added", F.lit(False)).unionByName(gaps), drops


def kind_order(kind: Column) -> Column:
    """Place of an edge's kind in KINDS."""
    return F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1


def sign_basis(loader: Column, kind: Column) -> Column:
    """What an edge's sign rests on (see functions.text.sign_for)."""
    return F.when(kind == "gap", "not_applicable").when((loader == "predicted") & (kind == "chem"), "fenyves2020_nt_r_prediction").otherwise("not_supplied")


def with_conflicts(wide: DataFrame, conflicts: DataFrame, attributes: list[str]) -> DataFrame:
    """A wide table of neurons with <attribute>_conflict for each, and n_conflicts, from conflicts (neuron_id, attribute)."""
    flags = [F.coalesce(F.bool_or(F.col("attribute") == a), F.lit(False)).alias(f"{a}_conflict") for a in attributes]
    by = conflicts.groupBy("neuron_id").agg(*flags, F.count("*").alias("n_conflicts"))
    return wide.join(by, "neuron_id", "left").fillna(False, [f"{a}_conflict" for a in attributes]).fillna(0, ["n_conflicts"])


def edge_conflicts(edges: DataFrame, pairs: DataFrame, skip: tuple[str, ...] = ("putative_mod",)) -> DataFrame:
    """conflict, entity (pre>post|kind), values, sources: where two bundles of one upstream dataset disagree on an edge.

    edges: dataset, pre, post, kind, weight (an edge is a row; a repeated one counts by its greatest weight); pairs: a, b,
    the datasets bundled twice. Each edge goes to its pairs by an equi join with that small table, and one grouping puts
    both sides' weights in one row, whatever the number of datasets. A pair counts once, in either order; one of which
    a dataset has no edges at all is left out.
    """
    twice = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    there = edges.select("dataset").distinct()
    twice = twice.join(there.withColumnRenamed("dataset", "a"), "a", "left_semi").join(there.withColumnRenamed("dataset", "b"), "b", "left_semi")
    sides = twice.select("a", "b", F.explode(F.array("a", "b")).alias("dataset"))
    rows = edges.filter(~F.coalesce(F.col("kind").isin(*skip), F.lit(False))).join(sides, "dataset")
    weight = lambda side: F.max(F.when(F.col("dataset") == F.col(side), F.col("weight")))
    both = rows.groupBy("a", "b", "pre", "post", "kind").agg(weight("a").alias("wa"), weight("b").alias("wb")).filter(~F.col("wa").eqNullSafe(F.col("wb")))
    text = lambda w: F.regexp_replace(F.col(w).cast("double").cast("string"), r"\.0$", "")
    source = lambda w, side: F.concat(F.coalesce(text(w), F.lit("absent")), F.lit("@"), F.col(side))
    differs = F.col("wa").isNotNull() & F.col("wb").isNotNull()
    return both.select(
        F.when(differs, "synapse_count_differs").otherwise("edge_in_one_bundle_only").alias("conflict"), F.concat("pre", F.lit(">"), "post", F.lit("|"), "kind").alias("entity"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(text("wa"), text("wb"))))), ",").alias("values"), F.array_join(F.array_sort(F.array(source("wa", "a"), source("wb", "b"))), ",").alias("sources"),
    )
