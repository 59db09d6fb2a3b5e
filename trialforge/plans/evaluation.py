"""Queries over splits, rankings, posteriors and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import tables
from ..operators import scoring, splits
from ..search import select
from ..sources import readers
from .base import r6, read

K, SEED = 5, 20261008


def _animals(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("animal"), "c_nationkey", "c_acctbal", "c_mktsegment")


def group_kfold(spark, d):
    return splits.kfold(_animals(spark, d), "animal", K, SEED, "outer").select("animal", "fold")


def nested_folds(spark, d):
    x = splits.nested(_animals(spark, d), "animal", 3, 4, SEED)
    return x.groupBy("outer", "role", "inner").agg(F.count("*").alias("n"), F.min("animal").alias("first"))


_FOLD = lambda scope, where="": f"(SELECT CAST(c_custkey AS VARCHAR) AS animal, (row_number() OVER (ORDER BY sha256('{SEED}:{scope}:' || c_custkey)) - 1) % {{k}} AS fold FROM customer {where})"


def loao_folds(spark, d):
    x = splits.leave_one_out(_animals(spark, d), "animal")
    return x.select("animal", "fold")


def fold_coverage(spark, d):
    """Per target (segment): in how many outer folds it is tested, and the least and mean number of inner folds that can
    both fit and validate it."""
    f = splits.nested(_animals(spark, d), "animal", 3, 4, SEED).join(_animals(spark, d).select("animal", "c_mktsegment"), "animal")
    tested = f.filter("role = 'test'").select("c_mktsegment", "outer").distinct()
    by = f.filter("role = 'train'").groupBy("c_mktsegment", "outer", "inner").agg(F.count("*").alias("n"))
    usable = by.withColumn("all", F.sum("n").over(Window.partitionBy("c_mktsegment", "outer"))).withColumn("ok", ((F.col("n") >= 1) & (F.col("all") - F.col("n") >= 2)).cast("int"))
    per = usable.groupBy("c_mktsegment", "outer").agg(F.sum("ok").alias("usable"))
    x = tested.join(per, ["c_mktsegment", "outer"], "left").fillna(0)
    return x.groupBy("c_mktsegment").agg(F.count("*").alias("n_tested"), F.min("usable").alias("least"), r6(F.avg("usable")).alias("mean"))


def leakage_checks(spark, d):
    """Sessions (days) whose animals are in more than one fold, and animals on both sides of a fold: must be few, none."""
    f = splits.kfold(_animals(spark, d), "animal", K, SEED, "outer")
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("animal"), F.to_date("o_orderdate").alias("session"))
    spans = o.join(f, "animal").groupBy("session").agg(F.count_distinct("fold").alias("folds")).filter("folds > 1")
    both = f.filter("fold = 0").select("animal").join(f.filter("fold <> 0").select("animal"), "animal", "left_semi")
    return spans.agg(F.count("*").alias("n")).select(F.lit("session spans folds").alias("check"), "n").union(both.agg(F.count("*").alias("n")).select(F.lit("train meets test"), "n"))


def scheme_choice(spark, d):
    """Per year, the priority under which most customers ordered, then in fewest statuses."""
    o = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("scheme"))
    return splits.best_scheme(o.agg(F.count_distinct("o_custkey").alias("covered"), F.count_distinct("o_orderstatus").alias("folds")), "year")


def resume_anti(spark, d):
    """The (customer, year) pairs that are still to do, given what a log of finished orders holds."""
    o = read(spark, d, "orders")
    todo = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(1994), F.lit(1996))).alias("year"))
    done = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year")).distinct()
    return todo.join(done, ["k", "year"], "left_anti")


def pareto_front(spark, d):
    """Parts that no other part beats in price and size without losing in either, per brand."""
    p = read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return select.pareto(p, "p_size", "p_retailprice", "p_brand").select("p_brand", "p_partkey")


def rank_ties(spark, d):
    x = tables.ordered(read(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], ["p_size", "p_retailprice", "p_partkey"])
    return x.select("p_brand", "p_partkey", (F.col("position") + 1).alias("rank"))


def prefix_min(spark, d):
    x = tables.ordered(read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], ["p_partkey"], None, least={"earlier": "p_retailprice"})
    return x.select("p_brand", "p_partkey", F.least("earlier", "p_retailprice").alias("best_so_far"))


def posterior_weights(spark, d):
    x = scoring.weights(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), F.col("p_retailprice") / 100, F.col("p_size").cast("double"), 2.0)
    return x.select("p_partkey", F.round("weight", 9).alias("weight"))


_W = f"(SELECT p_partkey, x, exp(x - max(x) OVER ()) / sum(exp(x - m)) OVER () AS w FROM (SELECT *, max(x) OVER () AS m FROM (SELECT p_partkey, -(p_retailprice / 100) / 2.0 - CAST(p_size AS DOUBLE) * {math.log(2)!r} AS x FROM part)))"


def effective_number(spark, d):
    x = scoring.weights(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), F.col("p_retailprice") / 100, F.col("p_size").cast("double"), 2.0)
    return x.agg(r6(1 / F.sum(F.col("weight") * F.col("weight"))).alias("n_effective"))


def ratio_of_sums(spark, d):
    x = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.sum("o_totalprice").alias("b"))
    return x.select("o_orderpriority", r6(F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio"))


def drop_one_min(spark, d):
    """The least mean over the customers of a segment when any one of them is left out."""
    c = read(spark, d, "customer")
    t = c.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    x = c.join(t, "c_mktsegment").filter("n > 1")
    return x.groupBy("c_mktsegment").agg(r6(F.min((F.col("s") - F.col("c_acctbal")) / (F.col("n") - 1))).alias("least_mean"))


def paired_difference(spark, d):
    """Per customer, spending in two statuses; a customer with one of them only shows as unpaired."""
    o = read(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    a, b = (o.filter(F.col("o_orderstatus") == s).select("o_custkey", F.col("v").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    x = a.join(b, "o_custkey", "full_outer")
    return x.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"), F.count(F.col("a") - F.col("b")).alias("paired"), F.round(F.sum(F.col("a") - F.col("b")), 2).alias("difference"))


def argmin_ridge(spark, d):
    """The size of least mean price per brand, ties to the smaller size."""
    x = read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    return x.groupBy("p_brand").agg(F.min_by("p_size", F.struct(F.round("m", 6), "p_size")).alias("size"))


def nested_choice(spark, d):
    """Per year the winning priority by mean price, and how often each wins."""
    x = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 6).alias("m"))
    best = x.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("m", "o_orderpriority"))).filter("r = 1")
    return best.groupBy("o_orderpriority").agg(F.count("*").alias("wins"))


def even_subsample(spark, d):
    """Seven of a brand's parts at even ranks, the ranks rounded half to even."""
    p = tables.ordered(read(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], "r", "n")
    want = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.bround(i * (F.col("n") - 1) / 6.0).cast("int"))
    return p.filter(F.array_contains(want, F.col("r"))).select("p_brand", "p_partkey")


def top_labels(spark, d):
    w = Window.orderBy(F.desc("n"), "p_type")
    x = read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "p_type").limit(12).withColumn("rank", F.row_number().over(w))


def program_limit(spark, d):
    return read(spark, d, "part").orderBy("p_partkey").limit(100).select("p_partkey", "p_name")


def rank_interventions(spark, d):
    x = read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.avg("c_acctbal"), 6).alias("utility"))
    return x.orderBy(F.desc("utility"), "n_name").limit(10)


def benchmark_summary(spark, d):
    """Per status: mean price, the most common priority (ties to the first), share of the top size bucket, median price."""
    o = read(spark, d, "orders")
    mode = o.groupBy("o_orderstatus", "o_orderpriority").count().groupBy("o_orderstatus").agg(F.min_by("o_orderpriority", F.struct(-F.col("count"), "o_orderpriority")).alias("modal"))
    x = o.groupBy("o_orderstatus").agg(r6(F.avg("o_totalprice")).alias("mean"), r6(F.avg((F.col("o_totalprice") > 300000).cast("double"))).alias("at_edge"))
    middle = tables.quantiles(o, "o_orderstatus", "o_totalprice", {"median": 0.5}).select("o_orderstatus", r6("median").alias("median"))
    return x.join(middle, "o_orderstatus").join(mode, "o_orderstatus")


def gate_counts(spark, d):
    p = read(spark, d, "part")
    why = F.when(F.col("p_size") > 45, "budget").when(F.col("p_retailprice") > 1800, "unstable").when(F.col("p_type").contains("TIN"), "type").otherwise("kept")
    return p.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def common_animals(spark, d):
    """Customers that have an order of every status."""
    o = read(spark, d, "orders")
    n = o.agg(F.count_distinct("o_orderstatus").alias("want"))
    return o.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("has")).crossJoin(F.broadcast(n)).filter("has = want").select("o_custkey")


def dot_predict(spark, d):
    """Each vector's dot product with the kernel of its label; a label without one has the zero kernel."""
    e = read(spark, d, "embeddings")
    kernels = e.filter("label % 2 = 0").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("k"))
    x = e.join(F.broadcast(kernels), "label", "left")  # a row per class of vectors
    dot = F.aggregate(F.zip_with("embedding", F.coalesce("k", F.transform("embedding", lambda v: F.lit(0.0).cast("float"))), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return x.select("vec_id", r6(dot).alias("prediction"))


def long_matrix(spark, d):
    """All vectors as a wide table of 64 columns, and its nonzero entries to two digits as (row, column, weight)."""
    e = read(spark, d, "embeddings")
    cells = [F.bround(F.get("embedding", F.lit(i)).cast("double"), 2).alias(f"d{i}") for i in range(64)]
    return readers.labelled_matrix(e.select("vec_id", *cells), "vec_id").select(F.col("pre").alias("vec_id"), F.col("post").alias("col"), "weight")


def quantised(spark, d):
    """Balances on a grid of 2^6 - 1 steps over their range, rounded half to even."""
    c = read(spark, d, "customer")
    r = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    x = c.crossJoin(F.broadcast(r))
    return x.select("c_custkey", F.bround((F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 63).cast("long").alias("step"))


QUERIES = {
    "group_kfold": (group_kfold, f"SELECT * FROM {_FOLD('outer').format(k=K)}"),
    "loao_folds": (loao_folds, "SELECT CAST(c_custkey AS VARCHAR) AS animal, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS fold FROM customer"),
    "nested_folds": (nested_folds, _NEST := f"""WITH o AS (SELECT * FROM {_FOLD('outer').format(k=3)}), t AS (SELECT f.fold AS "outer", o.animal FROM o JOIN (SELECT DISTINCT fold FROM o) f ON o.fold <> f.fold),
i AS (SELECT "outer", animal, (row_number() OVER (PARTITION BY "outer" ORDER BY sha256('{SEED}:inner' || "outer" || ':' || animal)) - 1) % 4 AS "inner" FROM t),
n AS (SELECT "outer", 'train' AS role, "inner", animal FROM i UNION ALL SELECT fold, 'test', NULL, animal FROM o)
SELECT "outer", role, "inner", count(*) AS n, min(animal) AS first FROM n GROUP BY ALL"""),
    "fold_coverage": (fold_coverage, _NEST[: _NEST.rindex("SELECT \"outer\", role")].rstrip() + """, m AS (SELECT n.*, c_mktsegment FROM n JOIN customer ON CAST(c_custkey AS VARCHAR) = animal),
t2 AS (SELECT DISTINCT c_mktsegment, "outer" FROM m WHERE role = 'test'), b AS (SELECT c_mktsegment, "outer", "inner", count(*) AS n FROM m WHERE role = 'train' GROUP BY ALL),
u AS (SELECT c_mktsegment, "outer", sum(CASE WHEN n >= 1 AND a - n >= 2 THEN 1 ELSE 0 END) AS usable FROM (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment, "outer") AS a FROM b) GROUP BY ALL)
SELECT c_mktsegment, count(*) AS n_tested, CAST(min(coalesce(usable, 0)) AS BIGINT) AS least, round(avg(coalesce(usable, 0)), 6) AS mean FROM t2 LEFT JOIN u USING (c_mktsegment, "outer") GROUP BY c_mktsegment"""),
    "leakage_checks": (leakage_checks, f"WITH f AS (SELECT * FROM {_FOLD('outer').format(k=K)}) SELECT 'session spans folds' AS \"check\", count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) FROM orders JOIN f ON animal = CAST(o_custkey AS VARCHAR) GROUP BY 1 HAVING count(DISTINCT fold) > 1) UNION ALL SELECT 'train meets test', 0"),
    "scheme_choice": (scheme_choice, "SELECT year, arg_min(p, (-c, f, p)) AS scheme FROM (SELECT year(o_orderdate) AS year, o_orderpriority AS p, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS f FROM orders GROUP BY ALL) GROUP BY year"),
    "resume_anti": (resume_anti, "SELECT c_custkey AS k, y AS year FROM customer, range(1994, 1997) r(y) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y AND o_orderstatus = 'F')"),
    "pareto_front": (pareto_front, "SELECT p_brand, p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_retailprice <= p.p_retailprice AND q.p_size <= p.p_size AND (q.p_retailprice < p.p_retailprice OR q.p_size < p.p_size))"),
    "rank_ties": (rank_ties, "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS rank FROM part"),
    "prefix_min": (prefix_min, "SELECT p_brand, p_partkey, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS best_so_far FROM part"),
    "posterior_weights": (posterior_weights, f"SELECT p_partkey, round(w, 9) AS weight FROM {_W}"),
    "effective_number": (effective_number, f"SELECT round(1 / sum(w * w), 6) AS n_effective FROM {_W}"),
    "ratio_of_sums": (ratio_of_sums, "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / nullif(sum(o_totalprice), 0.0), 6) AS ratio FROM orders GROUP BY o_orderpriority"),
    "drop_one_min": (drop_one_min, "SELECT c_mktsegment, round(min((s - c_acctbal) / (n - 1)), 6) AS least_mean FROM (SELECT *, sum(c_acctbal) OVER w AS s, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment)) WHERE n > 1 GROUP BY c_mktsegment"),
    "paired_difference": (paired_difference, "WITH o AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT count(*) FILTER (WHERE a.v IS NULL OR b.v IS NULL) AS unpaired, count(a.v - b.v) AS paired, round(sum(a.v - b.v), 2) AS difference FROM (SELECT * FROM o WHERE o_orderstatus = 'F') a FULL JOIN (SELECT * FROM o WHERE o_orderstatus = 'O') b USING (o_custkey)"),
    "argmin_ridge": (argmin_ridge, "SELECT p_brand, CAST(p_size AS BIGINT) AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(m, 6), p_size) AS r FROM (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY ALL)) WHERE r = 1"),
    "nested_choice": (nested_choice, "SELECT o_orderpriority, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY m, o_orderpriority) AS r FROM (SELECT year(o_orderdate) AS y, o_orderpriority, round(avg(o_totalprice), 6) AS m FROM orders GROUP BY ALL)) WHERE r = 1 GROUP BY 1"),
    "even_subsample": (even_subsample, "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE list_contains([CAST(round_even(i * (n - 1) / 6.0::DOUBLE, 0) AS BIGINT) FOR i IN range(7)], r)"),
    "top_labels": (top_labels, "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 12"),
    "program_limit": (program_limit, "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100"),
    "rank_interventions": (rank_interventions, "SELECT n_name, round(avg(c_acctbal), 6) AS utility FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY utility DESC, n_name LIMIT 10"),
    "benchmark_summary": (benchmark_summary, "WITH m AS (SELECT o_orderstatus, arg_min(o_orderpriority, (-c, o_orderpriority)) AS modal FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL) GROUP BY 1) SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, round(avg(CASE WHEN o_totalprice > 300000 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS at_edge, round(quantile_cont(o_totalprice, 0.5), 6) AS median, any_value(modal) AS modal FROM orders JOIN m USING (o_orderstatus) GROUP BY 1"),
    "gate_counts": (gate_counts, "SELECT CASE WHEN p_size > 45 THEN 'budget' WHEN p_retailprice > 1800 THEN 'unstable' WHEN contains(p_type, 'TIN') THEN 'type' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1"),
    "common_animals": (common_animals, "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)"),
    "dot_predict": (dot_predict, "WITH k AS (SELECT label, arg_min(embedding, vec_id) AS k FROM embeddings WHERE label % 2 = 0 GROUP BY label) SELECT vec_id, round(coalesce(list_sum(list_transform(list_zip(embedding, k), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 0.0), 6) AS prediction FROM embeddings LEFT JOIN k USING (label)"),
    "long_matrix": (long_matrix, "SELECT vec_id, 'd' || i AS col, round_even(embedding[i + 1]::DOUBLE, 2) AS weight FROM embeddings, range(64) r(i) WHERE round_even(embedding[i + 1]::DOUBLE, 2) <> 0"),
    "quantised": (quantised, "SELECT c_custkey, CAST(round_even((c_acctbal - lo) / (hi - lo) * 63, 0) AS BIGINT) AS step FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"),
}
