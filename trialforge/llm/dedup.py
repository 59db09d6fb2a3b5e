"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import WORD, ascii_lower, scratch, small, table

LEAST_ID = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    """words: of a shingle; percent: documents link at 100 * intersection >= percent * union; k: sketch size.

    sigmas: how far a pair at the threshold may stray from its expected sketch overlap before the lists or the
    estimate miss it; at 5 and k = 64 the binomial tail is 2.4 pairs in a million for 85 percent, 1.2 for 80, for each
    of the two. EXACT misses none: its sketches are the full sets, and one common value is enough to be a candidate.
    stars: rounds of one pivot per list before all pairs. long: lists of more members than this are compared by matrix
    in blocks of at most `block` members, those of more than `wide` after their members are filed anew.
    """

    words: int = 5
    percent: int = 80
    k: int = 64
    sigmas: float = 5.0
    stars: int = 3
    long: int = 48
    block: int = 2000
    wide: int = 20_000


CONTRACT = Settings(words=3, percent=85)
#: Without statistical steps, at the cost of lists of all shingles that documents share.
EXACT = {"k": 1 << 30, "sigmas": 1e5}


def with_shingles(docs: DataFrame, words: int) -> DataFrame:
    """docs' columns but text, and s: the distinct hashes of the text's shingles, ascending. Fewer words: one hash of
    them all; null text or no words: empty."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0))
    out = docs.withColumn("__w", F.transform(found, lambda w: F.xxhash64(w))).drop("text")
    grams = F.col("__w")
    for j in range(1, words):
        grams = F.zip_with(grams, F.slice("__w", j + 1, F.size("__w")), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("__g", grams)
    n = F.size("__w")
    return out.withColumn("s", F.sort_array(F.array_distinct(F.slice("__g", F.lit(1), F.greatest(n - (words - 1), F.lit(1)))))).drop("__w", "__g")


def _least_overlap(size: Column, s: Settings) -> Column:
    """Values that the sketches of a linked pair share at least, up to s.sigmas; size: of the sketch."""
    j = s.percent / 100
    return F.greatest(F.lit(1), F.floor(size * j - F.sqrt(size * (j * (1 - j))) * s.sigmas)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it is connected with, for all nodes in edges (a, b).

    Labels fall to the least of the neighbours', then each takes its label's label, until none changes; chains
    shorten by half a round. Every round is a scratch table; only counts come to the driver.
    """
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = scratch(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.col("label") != F.least("new", F.coalesce("far", "new"))).alias("moved")))
        labels = moved.select("node", "label")
        if not moved.filter("moved").head(1):
            return labels


def _estimated(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose union sketch, the k least of both, may come from a link: the share of it in both estimates J."""
    a = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("ka"))
    b = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("kb"))
    rows = pairs.join(a, "a").join(b, "b").withColumn("u", F.slice(F.array_sort(F.array_union("ka", "kb")), 1, s.k))
    shared = F.size(F.array_intersect(F.array_intersect("u", "ka"), F.col("kb")))
    return rows.filter(shared >= _least_overlap(F.size("u"), s)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs that link by their full sets. No aggregation follows the joins in their stage, so that a pivot with many
    pairs can be split."""
    a = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - both
    return pairs.join(a, "a").join(b, "b").filter(both * 100 >= union * s.percent).select("a", "b")


def _forest(part: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links by full sets between rows (rep, label, block, s) of different labels: as many as join all that can be
    joined, no more. Where the rows are of two blocks, only pairs across them are looked at.

    Intersections are counted by a matrix product over elements that many rows have, and one by one over the others.
    """
    reps, sizes, m = part["rep"].to_numpy(), part["s"].map(len).to_numpy(np.int64), len(part)
    if not m:
        return []
    own = np.repeat(np.arange(m), sizes)
    _, at, count = np.unique(np.concatenate(part["s"].to_list()), return_inverse=True, return_counts=True)
    many = max(8, m // 32)
    both = np.zeros((m, m), np.float32)
    wide = np.flatnonzero(count >= many)
    for a in range(0, len(wide), 4096):
        column = np.full(len(count), -1)
        column[wide[a : a + 4096]] = np.arange(len(wide[a : a + 4096]))
        hit = column[at] >= 0
        has = np.zeros((m, len(wide[a : a + 4096])), np.float32)
        has[own[hit], column[at[hit]]] = 1
        both += has @ has.T
    rest = np.flatnonzero((count[at] > 1) & (count[at] < many))
    rest = rest[np.argsort(at[rest], kind="stable")]
    for rows in np.split(own[rest], np.flatnonzero(np.diff(at[rest])) + 1) if len(rest) else ():
        both[np.ix_(rows, rows)] += 1
    blocks = part["block"].to_numpy()
    across = len(np.unique(blocks)) > 1
    root, links = np.unique(part["label"].to_numpy(), return_inverse=True)[1], []
    for r in range(m):
        shared = both[r].astype(np.int64)
        good = (shared * 100 >= (sizes[r] + sizes - shared) * percent) & (root != root[r])
        if across:
            good &= blocks != blocks[r]
        for c in np.flatnonzero(good):
            if root[c] != root[r]:
                links.append((int(reps[r]), int(reps[c])))
                root[root == root[c]] = root[r]
    return links


def _long_lists(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) within lists of many members (value, rep, label, size), enough to connect what is connected.

    A list is cut into blocks by hash and each two blocks are a group of their own, so no task holds a long list and
    none of its pairs becomes a row. A set is copied once for each block, so lists must not be wider than _filed_anew
    leaves them.
    """
    ship(members.sparkSession)
    n = F.ceil(F.col("size") / s.block).cast("int")
    dealt = members.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = dealt.select("value", "rep", "label", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    dealt = dealt.withColumns({"lo": F.least("block", "j"), "hi": F.greatest("block", "j")}).drop("j").join(sets, "rep")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(part, s.percent), columns=["a", "b"], dtype="int64")

    links = dealt.groupBy("value", "lo", "hi").applyInPandas(work, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _filed_anew(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Other lists (value, rep, label, size) of the members (rep, n, label) of very wide lists, for all their links.

    Two sets of which each has n elements and that link share at least percent of n, so in any common order they share
    one of the n - that + 1 first. Here the order is by how many members hold an element, rarest first: what makes a
    list wide, a passage or a line that many texts hold, comes last and files nothing unless it is most of a text.
    An element of one member files nothing but takes its place. Full sets are exploded once.
    """
    who = members.select("rep", "n", "label").distinct()
    each = who.join(sets, "rep").select("rep", "n", "label", F.explode("s").alias("e"))
    held = each.groupBy("e").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    firsts = F.col("n") - F.ceil(F.col("n") * s.percent / 100).cast("int") + 1
    met = each.join(held.select("e", "df", (F.col("lo") < F.col("hi")).alias("apart")), "e")
    filed = met.groupBy("rep", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "e", "apart"))).alias("held"))
    filed = filed.select("rep", "label", F.explode(F.slice("held", F.lit(1), firsts)).alias("x")).filter("x.apart").select(F.col("x.e").alias("value"), "rep", "label")
    sizes = filed.groupBy("value").agg(F.count("*").alias("size")).filter("size > 1")
    return filed.join(sizes, "value")


def _lists(reps: DataFrame, s: Settings) -> DataFrame:
    """rep, n, values, weight: the retained values by which rep is filed, for reps that may have a link at all.

    Of two sketches of m values that share c, the m - c + 1 first in any common order meet. Ordered by how many
    documents retain a value, rarest first, a passage or line that many documents hold files none of them, unless it
    is most of them. A value of one document files nothing but takes its place, which leaves out most documents.
    """
    post = reps.select("rep", "n", F.explode("sketch").alias("value"))
    held = post.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    found = post.join(held, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    need = _least_overlap(F.least("n", F.lit(s.k)), s)
    found = found.filter(F.size("found") >= need)
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda acc, x: acc + x["df"])  # most at the centre of a group
    return found.select("rep", "n", weight.alias("weight"), F.transform(F.slice("found", F.lit(1), F.size("found") - need + 1), lambda x: x["value"]).alias("values"))


def near_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of docs: component_id is the least doc_id reachable.

    Texts of one shingle set are a class and only its least doc_id is compared. Documents that share a filed value
    are candidates; in rounds, each list compares all members with one pivot, first the most central, and members
    found linked, in whatever list, need no more comparing: a list within one component is done. In what is left
    after s.stars pivots, pairs across components are compared in full, those of long lists within their tasks. So
    the pairs of a group of copies don't become rows, and no pair that could join two components goes unseen. Only
    counts come to the driver.

    doc_id must be a whole number. Null text, or without words: linked with nothing. Null doc_id: before all others, as component too. Rows that
    share a doc_id are texts of their own. Empty table: empty result. Other columns are left out.
    """
    ratio = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * s.percent
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), "text")
    ids = ids.withColumn("node", F.xxhash64("id", F.coalesce("text", F.lit(""))))  # rows of one id are apart, but for equal texts
    base = scratch(with_shingles(ids, s.words).select("id", "node", F.size("s").alias("n"), F.xxhash64("s").alias("h"), F.xxhash64(F.lit(s.k), "s").alias("i"), F.slice("s", 1, s.k).alias("sketch")))
    classes = base.filter("n > 0").groupBy("n", "h", "i").agg(F.min(F.struct("id", "node", "sketch")).alias("m"))
    classes = scratch(classes.select("n", "h", "i", F.col("m.id").alias("id"), F.col("m.node").alias("rep"), F.col("m.sketch").alias("sketch")))
    filed = scratch(_lists(classes, s))
    lists = filed.select("rep", "n", "weight", F.explode("values").alias("value"))
    sketches = scratch(classes.join(small(filed.select("rep")), "rep", "left_semi").select("rep", "sketch"))
    texts = ids.select(F.col("node").alias("rep"), "text").join(small(filed.select("rep").distinct()), "rep", "left_semi")
    sets = scratch(with_shingles(texts, s.words).select("rep", "s").distinct())
    labels, tried = None, None
    for turn in range(s.stars + 1):
        named = lists.withColumn("label", F.col("rep")) if labels is None else lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        pivot = F.min_by(F.struct("rep", "n", "label"), F.struct(-F.col("weight"), "rep") if turn == 0 else F.struct(F.xxhash64("rep", F.lit(turn)), "rep"))
        heads = named.groupBy("value").agg(pivot.alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
        if turn < s.stars:
            pairs = named.join(heads.select("value", "p"), "value").filter((F.col("label") != F.col("p.label")) & ratio(F.col("n"), F.col("p.n")))
            pairs = pairs.select(F.least("rep", F.col("p.rep")).alias("a"), F.greatest("rep", F.col("p.rep")).alias("b"))
        else:
            left = scratch(named.join(heads.select("value", "size"), "value"))
            many = left.filter((F.col("size") > s.long) & (F.col("size") <= s.wide)).select("value", "rep", "label", "size")
            widest = left.filter(F.col("size") > s.wide)
            if widest.head(1):
                many = many.union(_filed_anew(widest, sets, s).select("value", "rep", "label", "size"))
            more = _long_lists(many, sets, s)
            short = left.filter(F.col("size") <= s.long)
            x, y = short.alias("x"), short.alias("y")
            pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & ratio(F.col("x.n"), F.col("y.n")))
            pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch(_estimated(pairs, sketches, s))
        tried = pairs if tried is None else tried.union(pairs)
        links = _verified(pairs, sets, s)
        links = scratch(links if turn < s.stars else links.union(more))
        if not links.head(1):
            continue
        if labels is None:
            labels = components(links)
            continue
        to = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        links = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        merged = components(scratch(links.filter("a <> b")))
        known = labels.select("node", "label").union(merged.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        labels = scratch(known.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    reach = classes.select("n", "h", "i", F.col("id").alias("component"), "rep")
    if labels is not None:
        found = scratch(reach.join(labels.withColumnRenamed("node", "rep"), "rep").select("rep", "label", "component"))
        least = found.groupBy("label").agg(F.min("component").alias("least"))
        reach = reach.join(found.join(least, "label").select("rep", "least"), "rep", "left").withColumn("component", F.coalesce("least", "component"))
    out = base.select("id", "n", "h", "i").join(reach.select("n", "h", "i", "component"), ["n", "h", "i"], "left").withColumn("component", F.coalesce("component", "id"))
    real = lambda c: F.when(F.col(c) != LEAST_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one row of each group of linked texts, the one of least doc_id (null before all), then the first; columns
    as they were.

    Rows count each alone, whatever their doc_id, so that only linked rows go: texts that share an id, or have none, stay
    unless they are near copies, and so do all without words. The rows are numbered in a written table; the numbers to
    drop are broadcast if few, else joined.
    """
    rows = scratch(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = near_groups(rows.select(F.col("__row").alias("doc_id"), "text"), s).select(F.col("doc_id").alias("__row"), "component_id")
    linked = scratch(found.filter(F.col("__row") != F.col("component_id")))
    members = scratch(linked.union(linked.select(F.col("component_id").alias("__row"), "component_id").distinct()))
    named = rows.select("__row", F.col("doc_id").cast("long").alias("id")).join(small(members), "__row")
    kept = named.groupBy("component_id").agg(F.min(F.struct("id", "__row")).alias("m")).select("m.__row")
    gone = scratch(members.select("__row").join(kept, "__row", "left_anti"))
    return rows.join(small(gone), "__row", "left_anti").select(*docs.columns)


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), CONTRACT)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))  # of a group that a null id leads, the rows without id


#: Brute force over all pairs that share a shingle, and everything reachable from the least id.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a WHERE reach.r < e.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
