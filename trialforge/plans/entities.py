"""Queries over labels, evidence, catalogs and sets of ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, entity
from ..sources import readers
from .base import r6, read

_NAME = "chr(CAST(65 + {k} % 5 AS INT)) || 'A' || chr(CAST(86 - {k} % 3 AS INT)) || CASE {k} % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'DL' ELSE '2' END"
_CANON = f"SELECT DISTINCT {_NAME.format(k='c_custkey')} AS name FROM customer"
_LABELS = f"""SELECT row_id, source, CASE row_id % 6 WHEN 0 THEN n WHEN 1 THEN lower(n) WHEN 2 THEN substr(n, 1, 3) WHEN 3 THEN 'zz' || substr(n, 1, 2) WHEN 4 THEN substr(n, 1, 2) || 'q' || substr(n, 4)
 ELSE substr(n, 2, 1) || substr(n, 1, 1) || substr(n, 3) END AS label FROM (SELECT o_orderkey AS row_id, o_orderstatus AS source, {_NAME.format(k='o_custkey')} AS n FROM orders) x"""
_EVIDENCE = "SELECT 'n' || (n_chars % 60) AS neuron_id, CASE WHEN doc_id % 3 = 0 THEN 'type' ELSE 'role' END AS attribute, CASE doc_id % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'polymodal' WHEN 2 THEN lang ELSE 'v' || (n_chars % 3) END AS value, source FROM documents"


def _sql(spark, d, sql, *tables):
    for t in tables:
        read(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def _canon(spark, d):
    return _sql(spark, d, _CANON, "customer")


def _labels(spark, d):
    return _sql(spark, d, _LABELS, "orders")


def _evidence(spark, d):
    return _sql(spark, d, _EVIDENCE, "documents")


def join_text(c):
    return F.array_join(c, ",")


def label_status(spark, d):
    """Each label's status, whether it is repeated in its recording (source), and the identity that remains."""
    x = _labels(spark, d).select("row_id", "source", F.when(F.col("row_id") % 11 == 0, "").when(F.col("row_id") % 13 == 0, F.col("row_id").cast("string")).otherwise(F.col("label")).alias("label"))
    n = F.count("*").over(Window.partitionBy("source", "label", F.col("row_id") % 50))
    x = x.withColumns({"status": text.label_status(F.col("label")), "duplicated": n > 1})
    return x.select("row_id", "status", "duplicated", F.when((F.col("status") == "name") & ~F.col("duplicated"), F.col("label")).alias("neuron"))


_STATUS = f"""WITH l AS (SELECT row_id, source, CASE WHEN row_id % 11 = 0 THEN '' WHEN row_id % 13 = 0 THEN CAST(row_id AS VARCHAR) ELSE label END AS label FROM ({_LABELS})),
s AS (SELECT *, CASE WHEN trim(label) = '' THEN 'blank' WHEN regexp_full_match(label, '[0-9]+') THEN 'numeric' WHEN regexp_full_match(label, '[A-Z][A-Za-z0-9]*') THEN 'name' ELSE 'other' END AS status, count(*) OVER (PARTITION BY source, label, row_id % 50) > 1 AS duplicated FROM l)
SELECT row_id, status, duplicated, CASE WHEN status = 'name' AND NOT duplicated THEN label END AS neuron FROM s"""


def label_audit(spark, d):
    x = _labels(spark, d).withColumn("status", text.label_status(F.col("label")))
    return x.groupBy("label", "status").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.sum((F.col("row_id") % 2).cast("long")).alias("n_odd"))


def stem_join(spark, d):
    x = _labels(spark, d).select("label").distinct().join(entity.stems(_canon(spark, d)).withColumnRenamed("stem", "label"), "label")
    return x.select("label", "name", "suffix")


def case_variant(spark, d):
    x = entity.resolve(_labels(spark, d), _canon(spark, d)).filter("kind = 'case_variant'")
    return x.select("label", F.col("candidates")[0].alias("name"))


def edit_one(spark, d):
    a = _labels(spark, d).select(F.col("label").alias("left")).distinct()
    return entity.within_one_edit(a, _canon(spark, d).select(F.col("name").alias("right")))


def alias_resolution(spark, d):
    x = entity.resolve(_labels(spark, d), _canon(spark, d))
    return x.select("label", "status", F.coalesce("kind", F.lit("")).alias("kind"), join_text("candidates").alias("candidates"))


_RESOLVE = f"""c AS ({_CANON}), l AS (SELECT DISTINCT label FROM ({_LABELS})), st AS (SELECT label, array_to_string(list_sort(list(name)), ',') AS m, count(*) AS k FROM l JOIN c ON starts_with(name, label) AND name <> label AND regexp_full_match(substr(name, length(label) + 1), '(\\d+)?([DV])?([LR])?') GROUP BY label HAVING count(*) >= 2),
r AS (SELECT l.label, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'alias' WHEN st.m IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'case_variant' WHEN st.m IS NOT NULL THEN 'class_label' ELSE '' END AS kind, coalesce(e.name, f.v, st.m, '') AS candidates
 FROM l LEFT JOIN c e ON e.name = l.label LEFT JOIN (SELECT lower(name) AS f, min(name) AS v FROM c GROUP BY 1 HAVING count(*) = 1) f ON f.f = lower(l.label) LEFT JOIN st ON st.label = l.label)"""


def evidence_fan_out(spark, d):
    x = entity.fan_out(_labels(spark, d), entity.resolve(_labels(spark, d), _canon(spark, d)))
    return x.groupBy("neuron_id").agg(F.count("*").alias("n"), F.count_if("ambiguous_assignment").alias("n_ambiguous"))


def union_merge(spark, d):
    base = _labels(spark, d).select(F.upper(F.substring("label", 1, 2)).alias("alias"), F.upper("label").alias("name"), F.when(F.col("row_id") % 6 == 1, "case").otherwise("stem").alias("kind"), (F.col("row_id") % 6).alias("priority"), "source")
    x = entity.merge_aliases(base)
    return x.select("alias", "name", "kind", join_text("observed_in").alias("observed_in"), "n_candidates", "ambiguous")


def evidence_conflicts(spark, d):
    x = entity.single_valued_conflicts(_evidence(spark, d))
    return x.select("neuron_id", "attribute", "kind", "severity", join_text("values").alias("values"))


def type_conflicts(spark, d):
    return entity.set_conflicts(_evidence(spark, d), "polymodal", "unknown")


def wide_attributes(spark, d):
    x = entity.wide(_evidence(spark, d), ["type", "role"])
    return x.select("neuron_id", *[join_text(f"{a}_{k}").alias(f"{a}_{k}") for a in ("type", "role") for k in ("values", "sources")], "n_evidence")


_LISTED = lambda c, a: f"array_to_string(list_sort(list(DISTINCT {c}) FILTER (WHERE attribute = '{a}')), ',')"


def transmitter_names(spark, d):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, "*Acetylcholine - NEW, GABA (uptake), Glu").when(k == 1, "GABA (uptake), unknown (monoamine, x)").when(k == 2, F.concat(F.lit("5-HT , "), F.initcap("lang"))).otherwise("ACh (new),, Unknown")
    x = read(spark, d, "documents").select("doc_id", text.transmitters(raw).alias("t"))
    return x.select("doc_id", join_text("t").alias("names"), text.has_transmitter(F.col("t")).alias("has"))


_TN = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'other:acetylcholine,GABA_uptake,Glu' WHEN 1 THEN 'GABA_uptake,unknown_monoamine' WHEN 2 THEN 'serotonin,other:' || lang ELSE 'ACh,unknown_orphan' END AS names,
 doc_id % 4 <> 1 AS has FROM documents"""


def function_names(spark, d):
    raw = F.concat(F.lit(" Motor Neuron , , "), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, ",PHARYNGEAL interneuron,Unknown").otherwise(",sensory, Sensory neuron,Pharyngeal motor neuron"))
    return read(spark, d, "documents").select("doc_id", join_text(text.function_types(raw)).alias("types"))


def reason_keys(spark, d):
    r = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_orderpriority"), F.lit("; detail: (x)"))
    return read(spark, d, "orders").groupBy(text.reason_key(r).alias("key")).agg(F.count("*").alias("n"))


def muscle_alias(spark, d):
    label = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "BWN-").otherwise("BWM-"), F.when(F.col("s_suppkey") % 2 == 0, "D").otherwise("V"), F.lit("L"), F.format_string("%02d", "s_suppkey"))  # a longer number stays whole
    return read(spark, d, "supplier").select("s_suppkey", text.muscle_name(label).alias("name"))


def wallclock(spark, d):
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_run"))
    hms = F.lpad((F.col("o_orderkey") * 37 % 300000).cast("string"), 6, "0")
    return read(spark, d, "orders").select("o_orderkey", text.wallclock(name, hms).alias("at"), text.acquisition_date(name).alias("day"))


def edge_signs(spark, d):
    p = read(spark, d, "part")
    raws = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("+"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("-"), F.lit("-"))).otherwise(F.array(F.lit("+"), F.lit("-")))
    s = text.sign_for(F.when(F.col("p_size") > 10, "predicted").otherwise("matrix"), F.when(F.col("p_size") % 5 == 0, "gap").otherwise("chem"), raws)
    return p.groupBy(F.coalesce(s, F.lit("none")).alias("sign")).agg(F.count("*").alias("n"))


def license_category(spark, d):
    p = read(spark, d, "part")
    spdx = F.element_at(F.array(*[F.lit(x) for x in ("MIT", "GPL-3.0-only", "Custom", "", None, "ISC", "Unlicense", "MPL-2.0", "EUPL-1.2", "CC-BY-SA-4.0", "GPLv3", "CC-BY-NC-4.0")]), (F.col("p_partkey") % 12 + 1).cast("int"))
    status = F.when(F.col("p_size") % 4 == 0, "none_declared").when(F.col("p_size") % 4 == 1, "unknown").otherwise("declared")
    return p.groupBy(F.coalesce(spdx, F.lit("none")).alias("spdx"), text.license_category(spdx, status).alias("category")).agg(F.count("*").alias("n"))


def status_classify(spark, d):
    o = read(spark, d, "orders")
    reg = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("bytes"), F.when(F.col("o_orderkey") % 5 > 0, F.sha2("o_orderstatus", 256)).alias("sha256"), F.md5("o_orderstatus").alias("md5"))
    files = o.filter("o_orderstatus = 'P' or o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(F.col("o_custkey")).alias("bytes"), F.when(F.col("o_orderkey") % 17 == 0, "x").otherwise(F.sha2("o_orderstatus", 256)).alias("sha256"), F.md5("o_orderstatus").alias("md5"))
    return catalog.verify(reg, files).groupBy("status").agg(F.count("*").alias("n"))


_FILES = """reg AS (SELECT o_orderkey AS path, o_custkey AS bytes, CASE WHEN o_orderkey % 5 > 0 THEN sha256(o_orderstatus) END AS sha, md5(o_orderstatus) AS md5 FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_custkey END AS bytes, CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE sha256(o_orderstatus) END AS sha, md5(o_orderstatus) AS md5 FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority <> '5-LOW')"""


def pin_sources(spark, d):
    o = read(spark, d, "orders")
    reg = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("bytes"), F.when(F.col("o_orderkey") % 5 > 0, F.sha2("o_orderstatus", 256)).alias("sha256"), F.md5("o_orderstatus").alias("md5"))
    files = o.filter("o_orderstatus = 'P' or o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(F.col("o_custkey")).alias("bytes"), F.sha2("o_orderstatus", 256).alias("sha256"), F.md5("o_orderstatus").alias("md5"))
    return catalog.pin(reg, files).select("path", "sha256", "refused")


def catalog_diff(spark, d):
    c = read(spark, d, "customer")
    old = c.filter("c_nationkey < 20").select("c_custkey", "c_mktsegment")
    new = c.filter("c_nationkey > 3").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return catalog.merge(old, new, "c_custkey", "c_mktsegment")


def registry_validation(spark, d):
    n = read(spark, d, "customer").select((F.col("c_custkey") % 1400).alias("id"), "c_name", F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 2).alias("superseded_by"))
    return catalog.problems(n, "id", "superseded_by", ["segment"], {"c_name": "^Customer#[0-9]*[1-9]$"})


def source_attribution(spark, d):
    """Per customer, whether two readings of its orders agree column by column."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    other = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, 0.0).otherwise(F.col("o_totalprice")))
    return catalog.same_columns(o, other.drop("o_custkey"), ["o_orderkey"], ["o_totalprice", "o_orderstatus"], "o_custkey")


def target_reconcile(spark, d):
    """Code -3 gives way to a manual code where there is no comment; -2 never does."""
    o = read(spark, d, "orders").select("o_orderkey", (-(F.col("o_orderkey") % 5)).alias("code"))
    manual = read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("manual"), F.when(F.col("o_custkey") % 2 == 0, "note").alias("comment"))
    x = o.join(manual, "o_orderkey", "left")
    fixed = F.when((F.col("code") == -3) & F.col("comment").isNull() & (F.col("manual") >= 0), F.col("manual")).otherwise(F.col("code"))
    return x.select("o_orderkey", fixed.alias("code"))


def roundtrip_check(spark, d):
    e = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    again = e.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).filter("o_orderstatus <> 'P' or o_totalprice < 250000")
    return catalog.roundtrip(e, again, ["o_orderkey"], 1.0, 7)


def setops_intersect(spark, d):
    return read(spark, d, "customer").select("c_nationkey").intersect(read(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


def setops_except(spark, d):
    """Days and customers with orders of which none is finished, each once, however many orders there were."""
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("k"), F.col("o_custkey").alias("who"))
    return o.subtract(read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("k"), F.col("o_custkey").alias("who"))).select(F.date_format("k", "yyyy-MM-dd").alias("k"), "who")


def three_way(spark, d):
    """Suppliers that are in the graph, in the catalog's nations, and have a part of size 1."""
    l = read(spark, d, "lineitem")  # noqa: E741
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    small = l.join(read(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select(F.col("l_suppkey").alias("s_suppkey"))
    x = s.join(small, "s_suppkey", "left_semi").join(read(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey")), "s_nationkey", "left_semi")
    return x.select("s_suppkey")


def distinct_counts(spark, d):
    o = read(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), join_text(F.array_sort(F.collect_set("o_orderpriority"))).alias("priorities"))


def json_edges(spark, d):
    """Nonzero entries of a square matrix kept as JSON text."""
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    m = e.select(F.array(F.lit("a"), F.concat(F.lit("b"), F.col("k"))).alias("names"), F.format_string("[[0,%d],[%d,0]]", F.col("k"), F.col("k") % 2).alias("m"))
    x = readers.adjacency(m, "names", "m")
    return x.groupBy("pre", "post").agg(F.count("*").alias("n"), F.sum(F.col("weight").cast("long")).alias("w"))


def text_vectors(spark, d):
    """A text for each event, as a file would hold it: a header, numbers in two rows, a blank line; and its cells."""
    e = read(spark, d, "events")
    text = F.concat(F.lit('# {"k": 1}\n '), F.col("value").cast("string"), F.lit("\t-2.5e1  7\n\n"), F.when(F.col("event_id") % 7 == 0, "nan").otherwise("1.5"), F.lit(" 0\n"))
    x = readers.matrix_cells(e.select(F.col("event_id").cast("string").alias("path"), text.alias("value")))
    return x.select(F.col("path").cast("long").alias("event_id"), "row", "col", r6(F.nanvl("value", F.lit(-1.0))).alias("v"))


QUERIES = {
    "label_status": (label_status, _STATUS),
    "label_audit": (label_audit, f"SELECT label, CASE WHEN regexp_full_match(label, '[A-Z][A-Za-z0-9]*') THEN 'name' ELSE 'other' END AS status, count(*) AS n, count(DISTINCT source) AS n_sources, CAST(sum(row_id % 2) AS BIGINT) AS n_odd FROM ({_LABELS}) GROUP BY ALL"),
    "stem_join": (stem_join, f"WITH c AS ({_CANON}), l AS (SELECT DISTINCT label FROM ({_LABELS})) SELECT label, name, substr(name, length(label) + 1) AS suffix FROM l JOIN c ON starts_with(name, label) AND name <> label AND regexp_full_match(substr(name, length(label) + 1), '(\\d+)?([DV])?([LR])?')"),
    "case_variant": (case_variant, f"WITH {_RESOLVE} SELECT label, candidates AS name FROM r WHERE kind = 'case_variant'"),
    "edit_one": (edit_one, f"WITH c AS ({_CANON}), l AS (SELECT DISTINCT label FROM ({_LABELS})) SELECT label AS \"left\", name AS \"right\" FROM l JOIN c ON label <> name AND damerau_levenshtein(label, name) = 1"),
    "alias_resolution": (alias_resolution, f"WITH {_RESOLVE} SELECT label, status, kind, candidates FROM r"),
    "evidence_fan_out": (evidence_fan_out, f"WITH {_RESOLVE}, x AS (SELECT unnest(string_split(candidates, ',')) AS neuron_id, contains(candidates, ',') AS a FROM ({_LABELS}) y JOIN r USING (label) WHERE candidates <> '') SELECT neuron_id, count(*) AS n, count(*) FILTER (WHERE a) AS n_ambiguous FROM x GROUP BY 1"),
    "union_merge": (union_merge, f"WITH b AS (SELECT upper(substr(label, 1, 2)) AS alias, upper(label) AS name, row_id % 6 AS p, source FROM ({_LABELS})), m AS (SELECT alias, name, CASE WHEN min(p) = 1 THEN 'case' ELSE 'stem' END AS kind, array_to_string(list_sort(list(DISTINCT source)), ',') AS observed_in FROM b GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY alias) AS n_candidates, count(*) OVER (PARTITION BY alias) > 1 AS ambiguous FROM m"),
    "evidence_conflicts": (evidence_conflicts, f"SELECT neuron_id, attribute, CASE WHEN count(DISTINCT source) > 1 THEN 'values_differ_across_sources' ELSE 'several_values_in_one_source' END AS kind, CASE WHEN count(DISTINCT source) > 1 THEN 'hard' ELSE 'soft' END AS severity, array_to_string(list_sort(list(DISTINCT value)), ',') AS \"values\" FROM ({_EVIDENCE}) GROUP BY ALL HAVING count(DISTINCT value) > 1"),
    "type_conflicts": (type_conflicts, f"WITH s AS (SELECT neuron_id, attribute, source, list_sort(list(DISTINCT value)) AS v FROM ({_EVIDENCE}) WHERE value <> 'unknown' GROUP BY ALL), p AS (SELECT a.neuron_id, a.attribute, bool_and(list_has_any(a.v, b.v) OR list_contains(a.v, 'polymodal') OR list_contains(b.v, 'polymodal')) AS soft FROM s a JOIN s b ON a.neuron_id = b.neuron_id AND a.attribute = b.attribute AND a.source < b.source AND a.v <> b.v GROUP BY ALL) SELECT neuron_id, attribute, CASE WHEN soft THEN 'type_sets_overlap_but_differ' ELSE 'type_sets_disjoint' END AS kind, CASE WHEN soft THEN 'soft' ELSE 'hard' END AS severity FROM p"),
    "wide_attributes": (wide_attributes, f"SELECT neuron_id, " + ", ".join(f"coalesce({_LISTED(c, a)}, '') AS {a}_{k}" for a in ("type", "role") for c, k in (("value", "values"), ("source", "sources"))) + f", count(*) AS n_evidence FROM ({_EVIDENCE}) GROUP BY neuron_id"),
    "transmitter_names": (transmitter_names, _TN),
    "function_names": (function_names, "SELECT doc_id, 'motor,other:' || lang || CASE WHEN doc_id % 2 = 0 THEN ',interneuron,unknown' ELSE ',other:sensory,sensory,motor' END AS types FROM documents"),
    "reason_keys": (reason_keys, "SELECT regexp_replace('order N of ' || o_orderpriority, '\\b\\d+\\b', 'N', 'g') AS key, count(*) AS n FROM orders GROUP BY 1"),
    "muscle_alias": (muscle_alias, "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 AND s_suppkey < 100 THEN 'M' || CASE WHEN s_suppkey % 2 = 0 THEN 'D' ELSE 'V' END || 'L' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0') END AS name FROM supplier"),
    "wallclock": (wallclock, "WITH x AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS n, lpad(CAST(o_orderkey * 37 % 300000 AS VARCHAR), 6, '0') AS h FROM orders) SELECT o_orderkey, strftime(try_strptime(n || h, '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S') AS \"at\", substr(n, 1, 4) || '-' || substr(n, 5, 2) || '-' || substr(n, 7, 2) AS day FROM x"),
    "edge_signs": (edge_signs, "SELECT CASE WHEN p_size % 5 = 0 THEN 'none' WHEN p_size > 10 AND p_size % 3 = 0 THEN 'excitatory' WHEN p_size > 10 AND p_size % 3 = 1 THEN 'inhibitory' ELSE 'unknown' END AS sign, count(*) AS n FROM part GROUP BY 1"),
    "license_category": (license_category, "WITH p AS (SELECT p_size, ['MIT', 'GPL-3.0-only', 'Custom', '', NULL, 'ISC', 'Unlicense', 'MPL-2.0', 'EUPL-1.2', 'CC-BY-SA-4.0', 'GPLv3', 'CC-BY-NC-4.0'][p_partkey % 12 + 1] AS s FROM part) SELECT coalesce(s, 'none') AS spdx, CASE WHEN p_size % 4 = 0 THEN 'unlicensed' WHEN p_size % 4 = 1 OR coalesce(s, '') = '' THEN 'unknown' WHEN s IN ('MIT', 'ISC', 'Unlicense') THEN 'permissive' WHEN s IN ('GPL-3.0-only', 'MPL-2.0', 'EUPL-1.2', 'CC-BY-SA-4.0') THEN 'copyleft' ELSE 'other' END AS category, count(*) AS n FROM p GROUP BY ALL"),
    "status_classify": (status_classify, f"WITH {_FILES} SELECT CASE WHEN reg.path IS NULL THEN 'untracked' WHEN f.path IS NULL THEN 'missing' WHEN reg.bytes <> f.bytes THEN 'mismatch: size' WHEN reg.sha <> f.sha THEN 'mismatch: sha256' WHEN reg.md5 <> f.md5 THEN 'mismatch: md5' WHEN reg.sha IS NULL THEN 'unpinned' ELSE 'ok' END AS status, count(*) AS n FROM reg FULL JOIN f ON f.path = reg.path GROUP BY 1"),
    "pin_sources": (pin_sources, f"WITH {_FILES} SELECT reg.path, CASE WHEN coalesce(reg.bytes <> f.bytes, false) THEN reg.sha ELSE coalesce(reg.sha, CASE WHEN f.path IS NOT NULL THEN sha256(o_orderstatus) END) END AS sha256, coalesce(reg.bytes <> f.bytes, false) AS refused FROM reg LEFT JOIN f ON f.path = reg.path JOIN orders ON o_orderkey = reg.path"),
    "catalog_diff": (catalog_diff, "SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN 'added' WHEN c_nationkey <= 3 THEN 'removed' WHEN c_custkey % 9 = 0 THEN 'changed' ELSE 'same' END AS change, CASE WHEN c_nationkey >= 20 AND c_custkey % 9 = 0 THEN 'MOVED' ELSE c_mktsegment END AS value FROM customer"),
    "registry_validation": (registry_validation, "WITH n AS (SELECT c_custkey % 1400 AS id, c_name, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 END AS s FROM customer), p AS (SELECT 'id repeated' AS problem FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'segment missing' FROM n WHERE segment = '' UNION ALL SELECT 'c_name malformed' FROM n WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]*[1-9]') UNION ALL SELECT 'superseded_by unknown' FROM n WHERE s IS NOT NULL AND s NOT IN (SELECT id FROM n)) SELECT problem, count(*) AS n FROM p GROUP BY problem"),
    "source_attribution": (source_attribution, "SELECT o_custkey, bool_and(o_orderkey % 97 <> 0 OR o_totalprice = 0) AS o_totalprice, true AS o_orderstatus FROM orders GROUP BY o_custkey"),
    "target_reconcile": (target_reconcile, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 AND o_orderstatus = 'F' AND o_custkey % 2 <> 0 THEN o_custkey ELSE -(o_orderkey % 5) END AS code FROM orders"),
    "roundtrip_check": (roundtrip_check, "SELECT o_orderkey FROM orders WHERE o_orderkey % 500 = 3 OR o_orderstatus = 'P' AND o_totalprice >= 250000"),
    "setops_intersect": (setops_intersect, "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "setops_except": (setops_except, "SELECT strftime(k, '%Y-%m-%d') AS k, who FROM (SELECT CAST(o_orderdate AS DATE) AS k, o_custkey AS who FROM orders EXCEPT SELECT CAST(o_orderdate AS DATE), o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "three_way": (three_way, "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"),
    "distinct_counts": (distinct_counts, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1"),
    "json_edges": (json_edges, "WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INT) AS k FROM events), x AS (SELECT 'a' AS pre, 'b' || k AS post, k AS w FROM e UNION ALL SELECT 'b' || k, 'a', k % 2 FROM e) SELECT pre, post, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM x WHERE w <> 0 GROUP BY ALL"),
    "text_vectors": (text_vectors, "SELECT event_id, r AS row, c AS col, round(CASE WHEN r = 0 AND c = 0 THEN value WHEN r = 0 AND c = 1 THEN -25 WHEN r = 0 THEN 7 WHEN c = 1 THEN 0 WHEN event_id % 7 = 0 THEN -1 ELSE 1.5 END, 6) AS v FROM events, (VALUES (0, 0), (0, 1), (0, 2), (2, 0), (2, 1)) p(r, c)"),
}
