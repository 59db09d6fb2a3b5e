"""Secret scans by corpus-wide ownership frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import between, let, of, pieces, running, scratch, table

#: Fixed values of the contract, in its order. {n,} states "drop what is shorter" where no shorter match can hide a
#: longer one; assign keeps its plain form, as a dropped match there still consumes its text.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Added by the method: private key blocks. A body is base64 in chunks of 16 characters or more between line ends (real or
#: written) or spaces, after the header fields of encrypted keys, up to the END line; without an END line its first chunk
#: has 32 or more. Nothing else is a body, prose least of all. The match ends with it, so that its place is known.
#: Possessive, as Java repeats such groups in a loop at any length. A header without a body stands for itself.
_GAP = r"(?:\s|\\[nr])"
_CHUNKS = rf"(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+)*+"
PEM_FIELDS = rf"(?:[A-Z][A-Za-z-]{{1,40}}+:[^\r\n\\]{{0,200}}+{_GAP}++)*+"
PEM_CLOSED = rf"[A-Za-z0-9+/=]{{16,}}+{_CHUNKS}(?:{_GAP}++[A-Za-z0-9+/=]{{1,15}}+)?+(?={_GAP}*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----)"
PEM_LINES = rf"[A-Za-z0-9+/=]{{32,}}+{_CHUNKS}(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}={{1,2}})?"
PEM = rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_GAP}*+{PEM_FIELDS}({PEM_CLOSED}|{PEM_LINES}))?"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem")
#: The places to mask are broadcast if they take so many bytes at most, else joined.
LIVE_BYTES = 16_000_000
EMPTY = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"


def _matches(text: Column, pattern: str, kind: str, group: int, least: int = 1) -> Column:
    """Matches of one kind with their places: the pieces between matches give the distances. Without a value in the
    group, the match is the value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())  # the last piece has no match after it

    def placed(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")), lambda a, b: a + b, F.lit(0).cast("long"))
        return F.zip_with(rows, before, lambda x, at: span(x, (at + F.length(x["gap"])).cast("int")))

    def span(x: Column, start: Column) -> Column:
        value = F.when(x["value"] == "", x["hit"]).otherwise(x["value"])
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), value.alias("value"))

    found = F.filter(let(rows, placed), lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(EMPTY))


def secret_spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed: array of (start, order, kind, end, value), in code points."""
    text = F.coalesce(text, F.lit(""))
    found = [_matches(text, ASSIGN, "assign", 2, 6), _matches(text, ACCESS, "access", 0), _matches(text, HEX, "hex", 0), _matches(text, PEM, "pem", 1)]
    return F.sort_array(F.concat(*found))


def _digest(value: Column) -> Column:
    """Of the value without line ends, real or written, which only a key's body has: a copy may be wrapped anew."""
    return F.md5(F.regexp_replace(value, r"\s|\\[nr]", ""))


def ownership(found: DataFrame, min_owners: int = 3) -> DataFrame:
    """A verdict for each candidate hash, from (repository, owner, hash, strong).

    example: min_owners owners or more hold it, so it was copied around; live: fewer hold it and it is strong enough
    to be a credential; weak: the rest. A repository counts once, however often it is seen. Three aggregations, each
    summed before its shuffle: of a value that a third of all rows hold, repositories are dealt apart, then one row
    per task and owner is left.
    """
    once = found.groupBy("hash", "owner", "repository").agg(F.max("strong").alias("strong"))  # a key wrapped anew may look strong in one form alone
    held = once.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("strong").alias("strong"))
    counted = held.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("strong").alias("strong"))
    verdict = F.when(F.col("n_owners") >= min_owners, "example").when(F.col("strong"), "live").otherwise("weak")
    return counted.select("hash", "n_owners", "n_repositories", verdict.alias("verdict"))


def _strong(value: Column, min_length: int, min_letters: int) -> Column:
    """Long and varied, or of 10 characters at least with lower case, upper case and digits."""
    varied = (F.length(value) >= min_length) & (F.size(F.array_distinct(F.split(value, ""))) >= min_letters)
    return varied | ((F.length(value) >= 10) & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]"))


def scan_secrets(docs: DataFrame, owner: str = "source", min_owners: int = 3, min_length: int = 16, min_letters: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find secrets in whole texts and judge each by how many repositories (documents) and owners hold its value.

    Returns one row per row of docs: doc_id, spans (array of start, order, kind, end, value, sorted), verdicts (one
    per span: live, example or weak), live (hashes of the live values) and the columns in carry. Null text: no spans.
    Null owner: an owner of its own. Null doc_id: one repository. Repeated doc_id: rows stay apart, as one repository.
    Empty table: empty result. Other columns are left out.
    """
    own = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    keep = docs.select("doc_id", *own, F.col(owner).alias("owner"), secret_spans(F.col("text")).alias("spans"))
    found = scratch(keep.withColumn("row", F.monotonically_increasing_id()))  # narrow; the ids are fixed once written
    some = found.filter(F.size("spans") > 0)
    each = some.select("row", F.posexplode("spans").alias("i", "span")).select("row", "i", _digest(F.col("span.value")).alias("hash"))
    distinct = some.select(F.col("doc_id").alias("repository"), "owner", F.explode("spans.value").alias("v")).select("repository", "owner", _digest(F.col("v")).alias("hash"), _strong(F.col("v"), min_length, min_letters).alias("strong"))
    judged = each.join(ownership(distinct, min_owners), "hash", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "verdict", "hash"))).alias("judged"))
    out = found.join(judged, "row", "left")
    live = F.array_distinct(F.transform(F.filter("judged", lambda j: j["verdict"] == "live"), lambda j: j["hash"]))
    none = F.array().cast("array<string>")
    return out.select("doc_id", "spans", F.coalesce(F.col("judged.verdict"), none).alias("verdicts"), F.coalesce(live, none).alias("live"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])


def live_places(spans: Column, verdicts: Column) -> Column:
    """(start, end) of the live values among spans, by start."""
    hot = F.filter(F.arrays_zip(spans.alias("s"), verdicts.alias("v")), lambda x: x["v"] == "live")
    return F.sort_array(F.transform(hot, lambda x: F.struct((x["s"]["end"] - F.length(x["s"]["value"])).cast("long").alias("start"), x["s"]["end"].cast("long").alias("end"))))


def redact(text: Column, places: Column, mask: str = "[SECRET]") -> Column:
    """The text with mask at each of places (start, end; by start); places that overlap become one mask.

    Gaps between places are cut out of pieces of the text and joined once, so the work grows with the text and the
    number of places, not with their product.
    """

    def joined_up(cut: Column) -> Column:
        past = running(F.transform(places, lambda p: p["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
        gaps = F.zip_with(places, past, lambda p, at: F.when(p["start"] >= at, F.concat(between(cut, at, p["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(gaps, ""), between(cut, F.array_max(F.transform(places, lambda p: p["end"])), F.length(text).cast("long")))

    return let(pieces(text), joined_up)


def remove_secrets(docs: DataFrame, **options) -> DataFrame:
    """docs with every live-looking value masked in text (and n_chars, if there, set anew); other rows as they were.

    What to mask follows from the text, so the places go by its digest; those of the few texts concerned are
    broadcast if their bytes are within LIVE_BYTES, and joined else.
    """
    key = F.md5(F.col("text").cast("binary"))
    found = scan_secrets(docs.withColumn("__key", key), carry=("__key",), **options).filter(F.size("live") > 0)
    live = scratch(found.groupBy(F.col("__key").alias("__of")).agg(F.first(live_places(F.col("spans"), F.col("verdicts"))).alias("__places")))
    held = live.agg(F.coalesce(F.sum(F.size("__places") * 16 + 64), F.lit(0))).first()[0]
    out = docs.join(F.broadcast(live) if held <= LIVE_BYTES else live, key == F.col("__of"), "left")
    out = out.withColumn("text", F.when(F.col("__places").isNotNull(), redact(F.col("text"), F.col("__places"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__places").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_ownership(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    counts = [F.size(F.filter("spans", of(k, "kind"))).cast("long").alias(f"n_{k}") for k in BASE]
    judged = [F.size(F.filter("verdicts", of(k))).cast("long").alias(f"n_{k}") for k in ("live", "example")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join("verdicts", ",").alias("verdicts"), *judged)


#: The assign pattern as the SQL engine writes it.
SQL_ASSIGN = r'''(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'''
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, source, 'assign' AS k, 0 AS o, string_split_regex(t, '{SQL_ASSIGN}') AS g, regexp_extract_all(t, '{SQL_ASSIGN}') AS h, regexp_extract_all(t, '{SQL_ASSIGN}', 2) AS v FROM d
  UNION ALL SELECT r, source, 'access', 1, string_split_regex(t, 'AKIA[A-Z0-9]{{16,}}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{{16,}}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{{16,}}') FROM d
  UNION ALL SELECT r, source, 'hex', 2, string_split_regex(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}') FROM d
  UNION ALL SELECT r, source, 'pem', 3, string_split_regex(t, '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----') FROM d
), x AS (
  SELECT r, source, k, o, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0
), s AS (
  SELECT r, source, k, o, v[i] AS val, CAST(list_sum(list_transform(g[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda p: len(p))), 0) AS BIGINT) AS st, len(h[i]) AS n
  FROM x WHERE k <> 'assign' OR len(v[i]) >= 6
), own AS (
  SELECT val, CASE WHEN count(DISTINCT coalesce(source, chr(1))) >= 3 THEN 'example' WHEN len(val) >= 16 AND len(list_distinct(string_split(val, ''))) >= 8 OR len(val) >= 10 AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]') THEN 'live' ELSE 'weak' END AS verdict FROM s GROUP BY val
), a AS (
  SELECT r, count(*) FILTER (WHERE k = 'assign') AS n_assign, count(*) FILTER (WHERE k = 'access') AS n_access, count(*) FILTER (WHERE k = 'hex') AS n_hex,
    string_agg(k || ':' || st || ':' || (st + n), ',' ORDER BY st, o) FILTER (WHERE o < 3) AS base, string_agg(k || ':' || st || ':' || (st + n), ',' ORDER BY st, o) AS spans,
    string_agg(verdict, ',' ORDER BY st, o) AS verdicts, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example
  FROM s JOIN own USING (val) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(verdicts, '') AS verdicts, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (r)
"""
