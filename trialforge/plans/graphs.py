"""Queries over the weighted graph: aggregation, conflicts between bundles, normalisation and one tick of a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, graph
from .base import r6, read


def _edges(spark, d):
    """pre (supplier), post (part), weight, sign, delay in ticks."""
    x = read(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"), F.col("l_quantity").alias("weight"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"), (F.col("l_linenumber") % 3).alias("delay"), F.col("l_linestatus").alias("bundle"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("line"))


def _states(spark, d):
    """node, tick, value: three ticks of a made-up history of the suppliers."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal")
    return s.select("node", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tick"), "s_acctbal").select("node", "tick", (F.floor(F.col("s_acctbal") / 1000) % 3 + F.col("tick")).cast("double").alias("value"))


_E = "e AS (SELECT l_suppkey AS pre, l_partkey AS post, l_quantity AS weight, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign, l_linenumber % 3 AS delay, l_linestatus AS bundle, l_orderkey AS row_, l_linenumber AS line FROM lineitem)"
_H = "h AS (SELECT s_suppkey AS node, t AS tick, CAST(CAST(floor(s_acctbal / 1000) AS BIGINT) % 3 + t AS DOUBLE) AS value FROM supplier, range(3) r(t))"
_G = "g AS (SELECT least(o_custkey, o_custkey % 97) AS a, greatest(o_custkey, o_custkey % 97) AS b, max(o_totalprice) / 100000 AS g FROM orders WHERE o_custkey <> o_custkey % 97 GROUP BY 1, 2)"


def _gap(spark, d):
    o = read(spark, d, "orders").filter("o_custkey <> o_custkey % 97")
    return o.groupBy(F.least("o_custkey", F.col("o_custkey") % 97).alias("a"), F.greatest("o_custkey", F.col("o_custkey") % 97).alias("b")).agg((F.max("o_totalprice") / 100000).alias("g"))


def edge_aggregate(spark, d):
    x = graph.aggregate_edges(_edges(spark, d), ["pre", "post", "bundle"], "weight", ["sign", "delay"])
    return x.select("pre", "post", "bundle", r6("weight").alias("weight"), "n_rows", F.array_join(F.transform("sign", lambda v: v.cast("string")), ",").alias("signs"), F.array_join(F.transform("delay", lambda v: v.cast("string")), ",").alias("delays"))


def edge_pairs(spark, d):
    return _edges(spark, d).groupBy("pre", "post").agg(F.count_distinct("sign", "delay").alias("n_pairs"))


def row_normalise(spark, d):
    x = graph.normalise(_edges(spark, d).groupBy("pre", "post").agg(F.sum("weight").alias("weight")), "post", "weight")
    return x.select("pre", "post", F.round("norm", 9).alias("norm"))


def gap_symmetrise(spark, d):
    x = graph.symmetrise(_edges(spark, d).groupBy("pre", "post").agg(F.max("weight").alias("weight")), "pre", "post")
    return x.select("pre", "post", "weight", "added")


def gap_max(spark, d):
    return _gap(spark, d).select("a", "b", F.round("g", 8).alias("g"))


def bundle_full_outer(spark, d):
    e = _edges(spark, d).groupBy("bundle", "pre", "post").agg(F.sum("weight").alias("w"))
    a, b = (e.filter(F.col("bundle") == x).select("pre", "post", F.col("w").alias(f"w{x}")) for x in "FO")
    x = a.join(b, ["pre", "post"], "full_outer")
    kind = F.when(F.col("wF").isNull(), "only_o").when(F.col("wO").isNull(), "only_f").when(F.col("wF") == F.col("wO"), "equal").otherwise("different")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def edge_conflicts(spark, d):
    """Edges from suppliers to parts as two bundles have them, their kind the return flag."""
    e = read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("dataset"), F.concat(F.lit("s"), "l_suppkey").alias("pre"), F.concat(F.lit("p"), "l_partkey").alias("post"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("weight"))
    pairs = spark.createDataFrame([("F", "O"), ("O", "F"), ("F", "none")], "a string, b string")
    return annotation.edge_conflicts(e, pairs, ("N",))


def bundle_multiset(spark, d):
    """How many aggregated edges the two bundles share as multisets, and how many only one has."""
    e = _edges(spark, d).select("bundle", "pre", F.col("delay"), "sign")
    a, b = (e.filter(F.col("bundle") == x).select("pre", "delay", "sign") for x in "FO")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return count(a.intersectAll(b), "both").union(count(a.exceptAll(b), "only_f")).union(count(b.exceptAll(a), "only_o"))


def _sums(select):
    def run(spark, d):
        return graph.sum_in(_edges(spark, d), _states(spark, d), 2, select).select("post", r6("value").alias("value"))

    sign = {"exc": "CASE WHEN sign > 0 THEN weight * value ELSE 0.0 END", "inh": "CASE WHEN sign < 0 THEN weight * value ELSE 0.0 END", "all": "sign * weight * value"}[select]
    return run, f"WITH {_E}, {_H} SELECT post, round(sum({sign}), 6) AS value FROM e JOIN h ON h.node = e.pre AND h.tick = greatest(2 - e.delay, 0) GROUP BY post"


def count_in(spark, d):
    return graph.count_in(_edges(spark, d), _states(spark, d), 2, F.lit(2.0))


def gap_step(spark, d):
    nodes = read(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") / 1000).alias("old"), (F.col("c_acctbal") / 2000).alias("w"))
    return graph.gap_step(nodes, _gap(spark, d), 0.1, 2.0).select("node", F.round("next", 8).alias("next"))


def rule_tick(spark, d):
    """One tick of a rule compiled to columns: every local operator over the neighbourhood sums."""
    from ..sim.columns import tick_columns
    from .rules import TICK_RULE

    exc = graph.sum_in(_edges(spark, d), _states(spark, d), 2, "exc").withColumnRenamed("value", "exc_raw")
    inh = graph.sum_in(_edges(spark, d), _states(spark, d), 2, "inh").withColumnRenamed("value", "inh_raw")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("post"), "p_type", (F.col("p_size") / 50.0).alias("v"), (F.col("p_retailprice") % 7).alias("a"))
    x = p.join(exc, "post", "left").join(inh, "post", "left").fillna(0.0, ["exc_raw", "inh_raw"])
    cols = tick_columns(TICK_RULE, dt=0.1, registers={"v": F.col("v"), "a": F.col("a")}, sums={("v", "exc"): F.col("exc_raw") / 10000, ("v", "inh"): F.col("inh_raw") / 10000}, stimulus=F.when(F.col("post") % 10 == 0, 1.0).otherwise(0.0), node_type=F.split("p_type", " ")[0])
    return x.select("post", F.round(cols["v"], 8).alias("v"), F.round(cols["a"], 8).alias("a"))


_RULE_SQL = f"""WITH {_E}, {_H}, s AS (SELECT post, sum(CASE WHEN sign > 0 THEN weight * value ELSE 0.0 END) AS x, sum(CASE WHEN sign < 0 THEN weight * value ELSE 0.0 END) AS i FROM e JOIN h ON h.node = e.pre AND h.tick = greatest(2 - e.delay, 0) GROUP BY post),
p AS (SELECT p_partkey AS post, split_part(p_type, ' ', 1) AS ty, p_size / 50.0::DOUBLE AS v, p_retailprice % 7 AS a, coalesce(x, 0.0) / 10000 AS exc, coalesce(i, 0.0) / 10000 AS inh, CASE WHEN p_partkey % 10 = 0 THEN 1.0 ELSE 0.0 END AS u FROM part LEFT JOIN s ON s.post = p_partkey),
q AS (SELECT *, tanh(1.5::DOUBLE * exc - inh) + CASE WHEN ty = 'PROMO' THEN 1.0 ELSE 0.0 END * 0.25 AS drive FROM p)
SELECT post, round(CASE WHEN v >= 0.5 THEN drive + u - a + (v - (drive + u - a)) * exp(-(0.1::DOUBLE / 0.25)) ELSE least(greatest(drive, -1.0), 1.0) END, 8) AS v,
  round(v * 0.5 + (a - v * 0.5) * exp(-(0.1::DOUBLE / 2.0)), 8) AS a FROM q"""


def rule_tick_delays(spark, d):
    """One tick of a rule with a register's own past, n-ary extremes and Euler leaks, and its filtered observation."""
    from ..sim.columns import observed, tick_columns
    from .rules import DELAY_RULE

    p = read(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 25.0).alias("v"), (F.col("p_retailprice") / 500).alias("w"), (F.col("p_size") % 7 / 4.0).alias("two_ago"), (F.col("p_partkey") % 3 / 2.0).alias("held"))
    cols = tick_columns(DELAY_RULE, dt=0.1, registers={"v": F.col("v"), "w": F.col("w")}, delays={("v", 2): F.col("two_ago")})
    return p.select("node", F.round(cols["v"], 8).alias("v"), F.round(cols["w"], 8).alias("w"), F.round(observed(DELAY_RULE, 0.1, cols, F.col("held")), 8).alias("seen"))


def rule_tick_table(spark, d):
    """One tick of a rule on whole numbers: how many sources have the value 2, and a table of what follows."""
    from ..sim.columns import observed, tick_columns
    from .rules import TABLE_RULE

    n = graph.count_in(_edges(spark, d), _states(spark, d), 2, F.lit(2.0)).withColumnRenamed("value", "n")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("post")).join(n, "post", "left").fillna(0, ["n"])
    cols = tick_columns(TABLE_RULE, dt=0.1, registers={"v": F.lit(0.0)}, counts={("v", 2): F.col("n").cast("double")}, stimulus=F.when(F.col("post") % 4 == 0, 1.0).otherwise(0.0))
    return p.select("post", observed(TABLE_RULE, 0.1, cols).cast("double").alias("v"))


def delete_chemical(spark, d):
    pairs = read(spark, d, "supplier").select(F.col("s_suppkey").alias("pre"), (F.col("s_suppkey") * 3).alias("post"))
    return graph.delete_edges(_edges(spark, d), pairs, "pre", "post").groupBy("pre").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("w"))


def delete_gap(spark, d):
    pairs = read(spark, d, "customer").select((F.col("c_custkey") % 50).alias("b"), F.col("c_custkey").alias("a"))
    return graph.delete_edges(_gap(spark, d), pairs, "a", "b", undirected=True).agg(F.count("*").alias("n"), r6(F.sum("g")).alias("g"))


def graph_problems(spark, d):
    nodes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = _edges(spark, d).withColumns({"weight": F.col("weight") - 3, "post": F.col("post") % 120})
    return graph.check_graph(nodes, edges, _gap(spark, d).withColumn("b", F.when(F.col("b") % 11 == 0, F.col("a")).otherwise(F.col("b"))))


def connectome(spark, d):
    signs = _edges(spark, d).filter("post % 4 > 0").groupBy("pre", "post").agg(F.min("sign").alias("sign"))
    chem, _ = graph.connectome(_edges(spark, d), signs, _gap(spark, d))
    return chem.select("pre", "post", "sign", "assumed", F.round("norm", 9).alias("norm"))


def connectome_gap(spark, d):
    _, gap = graph.connectome(_edges(spark, d), _edges(spark, d).select("pre", "post", "sign").limit(0), _gap(spark, d))
    return gap.select("a", "b", F.round("g", 9).alias("g"))


def endpoint_mapping(spark, d):
    """Both endpoints looked up, with the first reason for which an edge is dropped."""
    s = read(spark, d, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("pre"), F.col("s_nationkey").alias("pre_nation"))
    p = read(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("post"), "p_brand")
    x = _edges(spark, d).join(s, "pre", "left").join(p, "post", "left")
    why = F.when(F.col("pre_nation").isNull(), "unknown source").when(F.col("p_brand").isNull(), "unknown target").when((F.col("sign") < 0) & (F.col("delay") == 0), "mirror").otherwise("kept")
    return x.groupBy(why.alias("outcome")).agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("w"))


def csr_order(spark, d):
    """Place of each edge in the row of its target, sorted by (source, delay, sign, weight)."""
    from pyspark.sql import Window

    x = _edges(spark, d)
    w = Window.partitionBy("post").orderBy("pre", "delay", "sign", "weight", "row", "line")
    return x.select("post", "pre", "row", "line", (F.row_number().over(w) - 1).alias("slot"), F.sum("weight").over(w).alias("running"))


QUERIES = {
    "edge_aggregate": (edge_aggregate, f"WITH {_E} SELECT pre, post, bundle, round(sum(weight), 6) AS weight, count(*) AS n_rows, array_to_string(list_sort(list_distinct(list(sign))), ',') AS signs, array_to_string(list_sort(list_distinct(list(delay))), ',') AS delays FROM e GROUP BY pre, post, bundle"),
    "edge_pairs": (edge_pairs, f"WITH {_E} SELECT pre, post, count(DISTINCT (sign, delay)) AS n_pairs FROM e GROUP BY pre, post"),
    "row_normalise": (row_normalise, f"WITH {_E}, a AS (SELECT pre, post, sum(weight) AS w FROM e GROUP BY ALL), t AS (SELECT max(s) AS m FROM (SELECT sum(w) AS s FROM a GROUP BY post)) SELECT pre, post, round(w / m, 9) AS norm FROM a, t"),
    "gap_symmetrise": (gap_symmetrise, f"WITH {_E}, g AS (SELECT pre, post, max(weight) AS weight FROM e GROUP BY ALL) SELECT pre, post, weight, false AS added FROM g UNION ALL SELECT post, pre, weight, true FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.pre = x.post AND y.post = x.pre)"),
    "gap_max": (gap_max, f"WITH {_G} SELECT a, b, round(g, 8) AS g FROM g"),
    "bundle_full_outer": (bundle_full_outer, f"WITH {_E}, a AS (SELECT bundle, pre, post, sum(weight) AS w FROM e GROUP BY ALL) SELECT CASE WHEN f.w IS NULL THEN 'only_o' WHEN o.w IS NULL THEN 'only_f' WHEN f.w = o.w THEN 'equal' ELSE 'different' END AS kind, count(*) AS n FROM (SELECT * FROM a WHERE bundle = 'F') f FULL JOIN (SELECT * FROM a WHERE bundle = 'O') o ON f.pre = o.pre AND f.post = o.post GROUP BY 1"),
    "edge_conflicts": (edge_conflicts, """WITH e AS (SELECT l_linestatus AS dataset, 's' || l_suppkey || '>p' || l_partkey || '|' || l_returnflag AS entity, sum(l_quantity) AS w FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
b AS (SELECT entity, max(w) FILTER (WHERE dataset = 'F') AS f, max(w) FILTER (WHERE dataset = 'O') AS o FROM e GROUP BY entity),
t AS (SELECT *, regexp_replace(CAST(CAST(f AS DOUBLE) AS VARCHAR), '\\.0$', '') AS tf, regexp_replace(CAST(CAST(o AS DOUBLE) AS VARCHAR), '\\.0$', '') AS tx FROM b WHERE f IS DISTINCT FROM o)
SELECT CASE WHEN f IS NOT NULL AND o IS NOT NULL THEN 'synapse_count_differs' ELSE 'edge_in_one_bundle_only' END AS conflict, entity, concat_ws(',', least(tf, tx), CASE WHEN tf <> tx THEN greatest(tf, tx) END) AS values,
  array_to_string(list_sort([coalesce(tf, 'absent') || '@F', coalesce(tx, 'absent') || '@O']), ',') AS sources FROM t"""),
    "bundle_multiset": (bundle_multiset, f"WITH {_E}, f AS (SELECT pre, delay, sign FROM e WHERE bundle = 'F'), o AS (SELECT pre, delay, sign FROM e WHERE bundle = 'O') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM f INTERSECT ALL SELECT * FROM o) UNION ALL SELECT 'only_f', count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM o) UNION ALL SELECT 'only_o', count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM f)"),
    **{f"sum_in_{k}": _sums(k) for k in ("exc", "inh", "all")},
    "count_in": (count_in, f"WITH {_E}, {_H} SELECT post, count(*) FILTER (WHERE value = 2.0) AS value FROM e JOIN h ON h.node = e.pre AND h.tick = greatest(2 - e.delay, 0) GROUP BY post"),
    "gap_step": (gap_step, f"WITH {_G}, n AS (SELECT c_custkey AS node, c_acctbal / 1000 AS o, c_acctbal / 2000 AS w FROM customer), r AS (SELECT a AS node, b AS other, g FROM g UNION ALL SELECT b, a, g FROM g), s AS (SELECT r.node, sum(g * 2.0) AS gg, sum(g * 2.0 * o) AS ss FROM r JOIN n ON n.node = r.other GROUP BY r.node) SELECT n.node, round((w + 0.1::DOUBLE * coalesce(ss, 0.0)) / (1 + 0.1::DOUBLE * coalesce(gg, 0.0)), 8) AS next FROM n LEFT JOIN s USING (node)"),
    "rule_tick": (rule_tick, _RULE_SQL),
    "rule_tick_delays": (rule_tick_delays, """WITH p AS (SELECT p_partkey AS node, p_size / 25.0::DOUBLE AS v, p_retailprice / 500 AS w, p_size % 7 / 4.0::DOUBLE AS d, p_partkey % 3 / 2.0::DOUBLE AS held FROM part),
q AS (SELECT *, 1 / (1 + exp(-(-w + 0.75::DOUBLE * d))) AS soft FROM p),
r AS (SELECT *, greatest(v + 0.1::DOUBLE / 0.5 * (soft - v), least(abs(d - 0.5), greatest(w - 1, 0.0), 2.0)) AS nv, w + 0.1::DOUBLE / 2 * (-greatest(v - soft, 0.0) - w) AS nw FROM q)
SELECT node, round(nv, 8) AS v, round(nw, 8) AS w, round(nv + (held - nv) * exp(-0.1::DOUBLE / 0.5), 8) AS seen FROM r"""),
    "rule_tick_table": (rule_tick_table, f"WITH {_E}, {_H}, c AS (SELECT post, count(*) FILTER (WHERE value = 2.0) AS n FROM e JOIN h ON h.node = e.pre AND h.tick = greatest(2 - e.delay, 0) GROUP BY post) SELECT p_partkey AS post, CAST([0, 1, 2, 1][least(coalesce(n, 0) + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END, 3) + 1] AS DOUBLE) AS v FROM part LEFT JOIN c ON c.post = p_partkey"),
    "delete_chemical": (delete_chemical, f"WITH {_E} SELECT pre, count(*) AS n, round(sum(weight), 6) AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = pre AND s_suppkey * 3 = post) GROUP BY pre"),
    "delete_gap": (delete_gap, f"WITH {_G} SELECT count(*) AS n, round(sum(g), 6) AS g FROM g WHERE NOT EXISTS (SELECT 1 FROM customer WHERE (c_custkey = a AND c_custkey % 50 = b) OR (c_custkey = b AND c_custkey % 50 = a))"),
    "graph_problems": (graph_problems, f"WITH {_E}, {_G}, x AS (SELECT pre, post % 120 AS post, weight - 3 AS weight FROM e), p AS (SELECT 'bad weight' AS problem FROM x WHERE weight < 0 UNION ALL SELECT 'unknown endpoint' FROM (SELECT pre AS id FROM x UNION ALL SELECT post FROM x) WHERE id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'gap self-loop' FROM g WHERE b % 11 = 0) SELECT problem, count(*) AS n FROM p GROUP BY problem"),
    "connectome": (connectome, f"WITH {_E}, c AS (SELECT pre, post, sum(weight) AS w FROM e GROUP BY ALL), s AS (SELECT pre, post, min(sign) AS sign FROM e WHERE post % 4 > 0 GROUP BY ALL), t AS (SELECT max(s) AS m FROM (SELECT sum(w) AS s FROM c GROUP BY post)) SELECT c.pre, c.post, CAST(coalesce(sign, 1) AS BIGINT) AS sign, sign IS NULL AS assumed, round(w / m, 9) AS norm FROM c LEFT JOIN s ON s.pre = c.pre AND s.post = c.post CROSS JOIN t"),
    "connectome_gap": (connectome_gap, f"WITH {_G}, t AS (SELECT max(s) AS m FROM (SELECT sum(g) AS s FROM (SELECT a, g FROM g UNION ALL SELECT b, g FROM g) GROUP BY a)) SELECT a, b, round(g / m, 9) AS g FROM g, t"),
    "endpoint_mapping": (endpoint_mapping, f"WITH {_E} SELECT CASE WHEN s_nationkey IS NULL THEN 'unknown source' WHEN p_brand IS NULL THEN 'unknown target' WHEN sign < 0 AND delay = 0 THEN 'mirror' ELSE 'kept' END AS outcome, count(*) AS n, round(sum(weight), 6) AS w FROM e LEFT JOIN supplier ON s_suppkey = pre AND s_acctbal >= 0 LEFT JOIN part ON p_partkey = post AND p_size > 5 GROUP BY 1"),
    "csr_order": (csr_order, f"WITH {_E} SELECT post, pre, row_ AS row, CAST(line AS BIGINT) AS line, row_number() OVER w - 1 AS slot, sum(weight) OVER w AS running FROM e WINDOW w AS (PARTITION BY post ORDER BY pre, delay, sign, weight, row_, line)"),
}
