"""Queries over the annotation build: alias tables, labels of other cells, transmitter conflicts and typed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, entity
from .base import r6, read
from .entities import _CANON, _EVIDENCE, _NAME, _canon, _evidence, _sql, join_text

_SEEN = f"""SELECT CASE c_custkey % 5 WHEN 0 THEN n WHEN 1 THEN lower(n) WHEN 2 THEN substr(n, 1, 3) WHEN 3 THEN CASE WHEN n LIKE '%2' THEN substr(n, 1, 3) || '02' ELSE 'AWCON' END ELSE substr(n, 1, 2) || 'zz' END AS label,
 c_mktsegment AS source FROM (SELECT c_custkey, c_mktsegment, {_NAME.format(k='c_custkey')} AS n FROM customer) x"""
_AGREED = f"SELECT 'AWCON' AS label, min(name) AS name, 'a state, not a side' AS reason FROM ({_CANON}) a UNION ALL SELECT 'AWCON', max(name), 'a state, not a side' FROM ({_CANON}) b UNION ALL SELECT 'AWCOFF', 'none', 'x'"
_CELLS = "SELECT 'GL' || chr(CAST(65 + n_nationkey % 4 AS INT)) || CASE CAST(floor(n_nationkey / 4) AS INT) WHEN 0 THEN 'L' WHEN 1 THEN 'R' WHEN 2 THEN 'DL' WHEN 3 THEN 'VR' WHEN 4 THEN '1' WHEN 5 THEN '2' ELSE '3D' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'glia near ' || n_name END AS description FROM nation"
_OTHER = "SELECT CASE c_custkey % 5 WHEN 0 THEN 'GLAL' WHEN 1 THEN 'glBr' WHEN 2 THEN 'Gl' || chr(CAST(65 + c_nationkey % 4 AS INT)) WHEN 3 THEN 'GL' ELSE 'GLZ' || c_nationkey END AS label FROM customer"
_TX = """SELECT 'n' || (n_chars % 150) AS neuron_id, CASE doc_id % 4 WHEN 0 THEN 'atlas' WHEN 1 THEN 'list' ELSE lang END AS source,
 CASE CAST(floor(doc_id / 7) AS INT) % 5 WHEN 0 THEN 'dominant' WHEN 1 THEN 'alternative' WHEN 2 THEN 'monoamine_source' WHEN 3 THEN 'reported' ELSE 'other' END AS role,
 CASE CAST(floor(doc_id / 3) AS INT) % 7 WHEN 0 THEN 'ACh' WHEN 1 THEN 'Glu' WHEN 2 THEN 'GABA' WHEN 3 THEN 'ACh' WHEN 4 THEN 'dopamine' WHEN 5 THEN 'serotonin' ELSE 'betaine' END AS value FROM documents"""
_EDGES = """SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE l_linenumber % 3 WHEN 0 THEN 'chem' WHEN 1 THEN 'gap' ELSE 'mod' END AS layer, 'c' || (l_suppkey % 90) AS pre, 'c' || (l_partkey % 110) AS post,
 l_quantity AS weight, CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_returnflag = 'A' THEN '+' END AS sign_raw"""
_RAW = f"{_EDGES} FROM lineitem"
_ENDS = "SELECT 'c' || k AS label, CASE WHEN k % 10 < 6 THEN 'neuron' WHEN k % 10 < 8 THEN 'muscle' ELSE 'drop' END AS what, CASE WHEN k % 10 < 6 THEN 'n' || (k % 40) WHEN k % 10 < 8 THEN 'm' || k END AS id, CASE WHEN k % 10 = 8 THEN 'ambiguous_label' WHEN k % 10 = 9 THEN 'non_neuron_cell' ELSE '' END AS reason FROM (SELECT DISTINCT p_partkey % 100 AS k FROM part) p"


def _aliases(spark, d):
    agreed = _sql(spark, d, _AGREED, "customer")
    return annotation.derive_aliases(_sql(spark, d, _SEEN, "customer"), _canon(spark, d), agreed)


def alias_table(spark, d):
    return _aliases(spark, d).select("alias", "name", "kind", "ambiguous", "n_candidates", "reason", join_text("observed_in").alias("observed_in"))


_ALIASES = rf"""c AS ({_CANON}), o AS (SELECT label, array_to_string(list_sort(list(DISTINCT source)), ',') AS seen FROM ({_SEEN}) WHERE label NOT IN (SELECT name FROM c) GROUP BY 1),
st AS (SELECT label, name, substr(name, length(label) + 1) AS s FROM o JOIN c ON starts_with(name, label) AND regexp_full_match(substr(name, length(label) + 1), '(\d+)?([DV])?([LR])?')),
why AS (SELECT label, CASE WHEN bool_and(s IN ('L', 'R')) THEN 'left/right not specified' WHEN bool_and(regexp_full_match(s, '[DV][LR]')) THEN 'dorsal/ventral and left/right not specified' WHEN bool_and(regexp_full_match(s, '\d+')) THEN 'member number of a numbered series not specified' ELSE 'class label with ' || count(*) || ' members' END AS reason FROM st GROUP BY label HAVING count(*) > 1),
every AS (SELECT label, g.name, 0 AS rule, 'convention' AS kind, reason FROM o JOIN ({_AGREED}) g USING (label) JOIN c ON c.name = g.name
 UNION ALL SELECT label, name, 1, 'zero_padded', 'leading zero in the series number' FROM o JOIN c ON regexp_full_match(label, '[A-Za-z]+0\d+') AND name = regexp_replace(label, '^([A-Za-z]+)0(\d+)$', '\1\2')
 UNION ALL SELECT label, v, 2, 'case_variant', 'differs only in letter case' FROM o JOIN (SELECT lower(name) AS f, min(name) AS v FROM c GROUP BY 1 HAVING count(*) = 1) ON f = lower(label)
 UNION ALL SELECT label, name, 3, 'class_label', reason FROM st JOIN why USING (label)),
al AS (SELECT label AS alias, name, kind, kind IN ('convention', 'class_label') AS ambiguous, count(*) OVER (PARTITION BY label) AS n_candidates, reason, seen AS observed_in FROM every JOIN o USING (label) QUALIFY rule = min(rule) OVER (PARTITION BY label))"""


def alias_lookup(spark, d):
    x = annotation.resolve_by_table(_sql(spark, d, _SEEN, "customer"), _canon(spark, d), _aliases(spark, d))
    return x.select("label", "status", join_text("candidates").alias("candidates"), F.coalesce("kind", F.lit("")).alias("kind"), "reason")


def non_neuron_labels(spark, d):
    return annotation.non_neuron_reasons(_sql(spark, d, _OTHER, "customer"), _sql(spark, d, _CELLS, "nation"))


_NON = rf"""WITH c AS ({_CELLS}), l AS (SELECT DISTINCT label FROM ({_OTHER})), n AS (SELECT label, min(name) AS name FROM l JOIN c ON lower(name) = lower(label) GROUP BY label),
f AS (SELECT label, list_sort(list(name)) AS m FROM l JOIN c ON length(label) >= 3 AND length(name) > length(label) AND starts_with(lower(name), lower(label)) AND regexp_full_match(substr(name, length(label) + 1), '(\d+)?([DV])?([LR])?') WHERE label NOT IN (SELECT label FROM n) GROUP BY label HAVING count(*) > 1)
SELECT label, 'known non-neuron cell: ' || CASE WHEN description = '' THEN 'no description' ELSE description END || CASE WHEN name = label THEN '' ELSE ' (case differs from ' || name || ')' END AS reason FROM n JOIN c USING (name)
UNION ALL SELECT label, 'class-level label of non-neuron cells (' || array_to_string(m[1:4], ', ') || '): ' || CASE WHEN description = '' THEN 'no description' ELSE description END FROM f JOIN c ON name = m[1]"""


def transmitter_conflicts(spark, d):
    return annotation.transmitter_conflicts(_sql(spark, d, _TX, "documents"), "atlas", "list")


_TC = f"""WITH s AS (SELECT neuron_id, source, coalesce(list_sort(list(DISTINCT value) FILTER (WHERE role IN ('dominant', 'reported') AND value IN ('ACh', 'Glu', 'GABA'))), []) AS m, coalesce(list(DISTINCT value) FILTER (WHERE role = 'alternative' AND value IN ('ACh', 'Glu', 'GABA')), []) AS alt,
 coalesce(list_sort(list(DISTINCT value) FILTER (WHERE value IN ('dopamine', 'serotonin', 'octopamine', 'tyramine'))), []) AS am FROM ({_TX}) WHERE role <> 'other' GROUP BY ALL),
p AS (SELECT a.neuron_id, a.source AS x, b.source AS y, CASE WHEN list_has_any(a.m, b.m) THEN 'classical_sets_overlap_but_differ' WHEN list_has_all(a.alt, b.m) OR list_has_all(b.alt, a.m) THEN 'dominant_matches_alternative_only' ELSE 'classical_transmitter_differs' END AS kind
 FROM s a JOIN s b ON a.neuron_id = b.neuron_id AND a.source < b.source AND a.m <> b.m AND len(a.m) > 0 AND len(b.m) > 0),
v AS (SELECT neuron_id, arg_min(kind, (CASE WHEN kind = 'classical_transmitter_differs' THEN 0 ELSE 1 END, x, y)) AS kind FROM p GROUP BY 1),
w AS (SELECT a.neuron_id, a.am, coalesce(b.am, []) AS bm FROM s a LEFT JOIN s b ON b.neuron_id = a.neuron_id AND b.source = 'list' WHERE a.source = 'atlas')
SELECT neuron_id, kind, CASE WHEN kind = 'classical_transmitter_differs' THEN 'hard' ELSE 'soft' END AS severity FROM v
UNION ALL SELECT neuron_id, CASE WHEN len(am) > 0 AND len(bm) > 0 AND NOT list_has_any(am, bm) THEN 'monoamine_sets_disjoint' ELSE 'monoamine_reported_by_one_source_only' END, CASE WHEN len(am) > 0 AND len(bm) > 0 AND NOT list_has_any(am, bm) THEN 'hard' ELSE 'soft' END FROM w WHERE am <> bm"""


def _typed(spark, d):
    """Rows of one row_id are in the order of the table's files."""
    read(spark, d, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index").createOrReplaceTempView("lineitem")
    raw = spark.sql(f"{_EDGES}, file_path, row_index FROM lineitem")
    raw = raw.withColumn("row", F.when(F.col("row_id").isNotNull(), F.struct("row_id", "file_path", "row_index")))
    return annotation.type_edges(raw, _sql(spark, d, _ENDS, "part"))


def typed_edges(spark, d):
    e = _typed(spark, d)[0]
    return e.select("source", "target", "kind", annotation.kind_order(F.col("kind")).alias("kind_order"), "target_kind", r6("weight").alias("weight"), "n_rows", join_text("signs").alias("signs"), "raw_pre", "raw_post", "added", annotation.sign_basis(F.lit("predicted"), F.col("kind")).alias("basis"))


def dropped_edges(spark, d):
    return _typed(spark, d)[1]


_TYPED = f"""WITH e AS ({_ENDS}), x AS (SELECT r.*, coalesce(a.what, 'drop') AS s, a.id AS sid, coalesce(a.reason, 'unknown_label') AS sr, coalesce(b.what, 'drop') AS t, b.id AS tid, coalesce(b.reason, 'unknown_label') AS tr FROM ({_RAW}) r LEFT JOIN e a ON a.label = pre LEFT JOIN e b ON b.label = post),
k AS (SELECT *, CASE WHEN s = 'neuron' AND t = 'neuron' THEN CASE WHEN layer = 'mod' THEN 'putative_mod' ELSE layer END WHEN s = 'neuron' AND t = 'muscle' AND layer <> 'mod' THEN 'nmj' END AS kind FROM x),
g AS (SELECT sid AS source, tid AS target, kind, t AS target_kind, sum(weight) AS weight, count(*) AS n_rows, coalesce(array_to_string(list_sort(list(DISTINCT sign_raw) FILTER (WHERE sign_raw IS NOT NULL)), ','), '') AS signs, arg_min(pre, row_id) AS raw_pre, arg_min(post, row_id) AS raw_post FROM k WHERE kind IS NOT NULL GROUP BY ALL),
u AS (SELECT *, false AS added FROM g UNION ALL SELECT target, source, kind, target_kind, weight, 0, signs, raw_post, raw_pre, true FROM g WHERE kind = 'gap' AND NOT EXISTS (SELECT 1 FROM g h WHERE h.kind = 'gap' AND h.source = g.target AND h.target = g.source))"""


def neuron_table(spark, d):
    """One row per neuron: values by attribute, and which attributes have conflicts."""
    e = _evidence(spark, d)
    x = annotation.with_conflicts(entity.wide(e, ["type", "role"]), entity.single_valued_conflicts(e), ["type", "role"])
    return x.select("neuron_id", join_text("type_values").alias("types"), join_text("role_values").alias("roles"), "type_conflict", "role_conflict", "n_conflicts", "n_evidence")


QUERIES = {
    "alias_table": (alias_table, f"WITH {_ALIASES} SELECT * FROM al"),
    "alias_lookup": (alias_lookup, f"""WITH {_ALIASES}, r AS (SELECT alias, array_to_string(list_sort(list(name)), ',') AS m, count(*) AS n, arg_min(kind, name) AS kind, arg_min(reason, name) AS reason, bool_or(ambiguous) AS ambiguous FROM al GROUP BY alias)
SELECT l.label, CASE WHEN c.name IS NOT NULL THEN 'exact' WHEN r.alias IS NULL THEN 'unresolved' WHEN n = 1 AND NOT ambiguous THEN 'alias' ELSE 'ambiguous' END AS status, coalesce(c.name, m, '') AS candidates, CASE WHEN c.name IS NULL THEN coalesce(kind, '') ELSE '' END AS kind, CASE WHEN c.name IS NOT NULL THEN 'canonical neuron name' ELSE coalesce(reason, '') END AS reason
FROM (SELECT DISTINCT label FROM ({_SEEN})) l LEFT JOIN c ON c.name = l.label LEFT JOIN r ON r.alias = l.label"""),
    "non_neuron_labels": (non_neuron_labels, _NON),
    "transmitter_conflicts": (transmitter_conflicts, _TC),
    "typed_edges": (typed_edges, _TYPED + " SELECT source, target, kind, CASE kind WHEN 'chem' THEN 0 WHEN 'gap' THEN 1 WHEN 'nmj' THEN 2 ELSE 3 END AS kind_order, target_kind, round(weight, 6) AS weight, n_rows, signs, raw_pre, raw_post, added, CASE kind WHEN 'gap' THEN 'not_applicable' WHEN 'chem' THEN 'fenyves2020_nt_r_prediction' ELSE 'not_supplied' END AS basis FROM u"),
    "dropped_edges": (dropped_edges, _TYPED + " SELECT layer || ':' || CASE WHEN s = 'drop' THEN sr WHEN t = 'drop' THEN tr WHEN s = 'muscle' AND t = 'neuron' AND layer = 'gap' THEN 'mirror_of_neuron_to_muscle' ELSE s || '_to_' || t END AS reason, count(*) AS n FROM k WHERE kind IS NULL GROUP BY 1"),
    "neuron_table": (neuron_table, f"""WITH e AS ({_EVIDENCE}), c AS (SELECT neuron_id, attribute FROM e GROUP BY ALL HAVING count(DISTINCT value) > 1), n AS (SELECT neuron_id, bool_or(attribute = 'type') AS t, bool_or(attribute = 'role') AS r, count(*) AS k FROM c GROUP BY 1)
SELECT neuron_id, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE attribute = 'type')), ','), '') AS types, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (WHERE attribute = 'role')), ','), '') AS roles, coalesce(any_value(t), false) AS type_conflict, coalesce(any_value(r), false) AS role_conflict, coalesce(any_value(k), 0) AS n_conflicts, count(*) AS n_evidence FROM e LEFT JOIN n USING (neuron_id) GROUP BY neuron_id"""),
}
