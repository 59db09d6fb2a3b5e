"""Document fingerprints by SimHash, and the search within a Hamming radius (DataFrame functions only)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, scratch, table

#: Documents whose ids agree beyond so many low bits are put in order together; then so many blocks, and so on.
BLOCK_BITS, MORE_BITS = 8, 12
#: Documents that a task puts in order and votes on, about.
TASK_ROWS = 4000
#: A term is a pair of neighbouring words and weighs as many votes as it has characters, up to MOST.
MOST = 24
LANES = 0x0000000100000001
LEAST_ID = -(1 << 63)


def _terms(text: Column) -> Column:
    """(hash, weight) of each pair of neighbouring words; the last word stands with nothing."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    weight = lambda a, b: F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(MOST)).cast("long")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), weight(a, b).alias("w")))


def _votes() -> list[Column]:
    """Sums of weights of the terms with bit i and, 32 bits higher, with bit i + 32."""
    return [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{i}") for i in range(32)]


def _signs() -> Column:
    """The fingerprint: bit i is set where more than half of the weight has it."""
    bits = [F.when(2 * F.shiftrightunsigned(f"v{i % 32}", 32 * (i // 32)).bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("w"), F.lit(1 << i if i < 63 else LEAST_ID)).otherwise(F.lit(0)) for i in range(64)]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp, the 64-bit SimHash of each text; the keys must tell the rows apart. Texts without words: 0.

    The term hashes vote in 32 sums of two lanes each, so one hash aggregation with partial sums does it all; where
    the rows are already dealt by a key it needs no shuffle.
    """
    terms = texts.select(*keys, F.explode_outer(_terms(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    voted = terms.select(*keys, "t.h", "t.w").groupBy(*keys).agg(*_votes(), F.sum("w").alias("w"))
    return voted.select(*keys, F.coalesce(_signs(), F.lit(0)).cast("long").alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _next_block(blocks: DataFrame, shift: int = MORE_BITS) -> DataFrame:
    """block and the next block that exists (null for the last), from distinct blocks, without one task for all."""
    up = blocks.select("block", F.shiftright("block", shift).alias("up"))
    inner = up.withColumn("next", F.lead("block").over(Window.partitionBy("up").orderBy("block")))
    tops = up.groupBy("up").agg(F.min("block").alias("first"))  # one row per 2 ** (BLOCK_BITS + MORE_BITS) ids
    over = tops.select("up", F.lead("first").over(Window.orderBy("up")).alias("over"))
    return inner.join(over, "up").select("block", F.coalesce("next", "over").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, block, rn (place in the block), is_last (of the block), next_id and next_text.

    The next document is the next doc_id up, a whole number; after the last the first. Null text: empty. Null doc_id: before all
    others. Rows of one doc_id follow each other by text hash. A single row is its own next. One shuffle of the
    texts, by blocks of ids; each block's first document is found again for the block before it.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), k.alias("k"), F.shiftright(k, BLOCK_BITS).alias("block"), F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("block").orderBy("k", "tie")
    firsts = rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("block", F.struct("doc_id", "text").alias("first"))
    blocks = rows.select("block").distinct()
    follow = _next_block(blocks).crossJoin(F.broadcast(blocks.agg(F.min("block").alias("zero")))).select(F.col("block").alias("of"), F.coalesce("next", "zero").alias("block"))
    follow = follow.join(firsts, "block").select(F.col("of").alias("block"), "first")
    parts = max(1, -(-docs.select("doc_id").count() // TASK_ROWS))  # so tasks don't grow with the input
    lead = rows.repartition(parts, "block").withColumns({"rn": F.row_number().over(order), "after": F.lead(F.struct("doc_id", "text")).over(order)})
    out = lead.join(follow, "block", "left").withColumn("then", F.coalesce("after", "first"))
    return out.select("block", "rn", "doc_id", "text", F.col("after").isNull().alias("is_last"), F.col("then.doc_id").alias("next_id"), F.col("then.text").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/4) code points replaced by the first as many (or all) of other."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - q), F.substring(other, F.lit(1), q))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's and the next document's: one row per row of docs (see with_next)."""
    rows = with_next(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("block", "rn", "doc_id", "next_id", F.length("text").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "text", "edit", F.when(F.col("is_last"), F.col("next_text")).alias("beyond"))
    texts = rows.select("block", "rn", "doc_id", "next_id", "n_chars", "edited_sha256", F.posexplode(F.array("text", "edit", "beyond")).alias("side", "t")).filter("side < 2 or t is not null")
    keys = ["block", "rn", "doc_id", "next_id", "n_chars", "edited_sha256"]
    each = fingerprints(texts, [*keys, "side"], "t")
    at = lambda i: F.max(F.when(F.col("side") == i, F.col("fp"))).alias(f"f{i}")
    wide = each.groupBy(*keys).agg(at(0), at(1), at(2))
    after = F.coalesce("f2", F.lead("f0").over(Window.partitionBy("block").orderBy("rn")))
    return wide.withColumn("next_fp", after).select("doc_id", "next_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("f0").alias("fp"), F.col("f1").alias("edited_fp"), "next_fp")


#: Fingerprints that share a key are compared as they are up to so many, beyond that by finer keys.
DENSE = 256


def _mask(bits: range) -> int:
    m = sum(1 << i for i in bits)
    return m - (1 << 64) if m >> 63 else m


def _cuts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _block_tables(radius: int, spare: int) -> tuple[list[int], list[list[int]]]:
    """Per choice of spare of the radius + spare blocks its mask, and the masks of radius + 1 parts of the other bits."""
    blocks = _cuts(list(range(64)), radius + spare)
    masks, finer = [], []
    for chosen in combinations(range(len(blocks)), spare):
        rest = [i for k, b in enumerate(blocks) if k not in chosen for i in b]
        masks.append(_mask([i for k in chosen for i in blocks[k]]))
        finer.append([_mask(part) for part in _cuts(rest, radius + 1)])
    return masks, finer


def _candidates(prints: DataFrame, radius: int, spare: int) -> tuple[DataFrame, DataFrame, Column]:
    """Two sides (a and b, both keyed by at, key, part) and the condition under which a meets b, each pair once."""
    masks, finer = _block_tables(radius, spare)
    fps = prints.select("fp").where("fp is not null").distinct()
    tables = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    keyed = fps.select("fp", F.posexplode(tables).alias("at", "key"))
    dense = keyed.groupBy("at", "key").agg(F.count("*").alias("n")).filter(F.col("n") > DENSE).select("at", "key", F.lit(True).alias("dense"))
    parts = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in finer])
    dealt = keyed.join(dense, ["at", "key"], "left")
    fine = F.transform(F.element_at(parts, F.col("at") + 1), lambda m, i: F.struct(i.alias("part"), F.col("fp").bitwiseAND(m).alias("sub")))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub")))
    dealt = dealt.select("fp", "at", "key", F.inline(F.when(F.col("dense"), fine).otherwise(whole)))
    a, b = dealt.withColumnRenamed("fp", "a"), dealt.select(F.col("fp").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("at", "key", "part", "sub")])
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.when(differ.bitwiseAND(F.lit(masks[0])) == 0, 0)
    for i, m in enumerate(masks[1:], 1):
        first = first.when(differ.bitwiseAND(F.lit(m)) == 0, i)
    agree = F.transform(F.element_at(parts, F.col("at") + 1), lambda m: differ.bitwiseAND(m) == 0)
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (first == F.col("at"))
    near = near & F.when(F.col("part") < 0, True).otherwise(F.array_position(agree, F.lit(True)) == F.col("part") + 1)
    for c in ("at", "key", "part", "sub"):
        near = near & (F.col(c) == F.col(f"{c}_b"))
    return a, b, near


def within_radius(prints: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints in column fp at a Hamming distance up to radius.

    The 64 bits are cut into radius + spare blocks. Two fingerprints within the radius agree in at least spare of
    them, so one table per choice of spare blocks, keyed by those, holds every such pair. Of the other bits, cut into
    radius + 1 parts, they agree in one part at least, so a key that many fingerprints share is divided by these parts
    and no pair is lost: a family made from one template isn't compared all with all. The join settles a candidate's
    distance and lets it through in the first table and part that hold it only, so no pair is made twice. Equal
    fingerprints are one row here: classes of copies aren't expanded. A fingerprint has at most 43,744 others within 3.
    """
    a, b, near = _candidates(prints, radius, spare)
    return a.join(b, near).select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fp and n_near: for each fingerprint that has any, how many different ones lie within the radius.

    Pairs are counted where the join finds them; what is shuffled then is one row per task and fingerprint.
    """
    pairs = within_radius(prints, radius)
    return pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_near"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = scratch(fingerprint_pairs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.join(scratch(near_counts(found)), "fp", "left")  # so nothing keeps a hot fingerprint's rows together
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    likes = [likeness(F.col("fp"), F.col(c)).alias(n) for c, n in (("edited_fp", "near_edited"), ("next_fp", "near_next"))]
    return found.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), *likes, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
