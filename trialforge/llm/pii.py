"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import of, table

BASE = ("email", "ip", "card", "phone")
#: Added by the method: account numbers under mod 97, and identity or call numbers that only context words make likely.
KINDS = (*BASE, "iban", "ssn")
#: Possessive forms of the contract's patterns: what they consume can't be given back to make a match anyway.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Words that raise or lower a span's score, within WINDOW characters before it or, to raise it, AFTER characters behind it.
HINTS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|payment|cc)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|release|example|order|invoice|isbn|serial)\b")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.4}
WINDOW, AFTER, HINT, COUNTER, ACCEPT = 40, 24, 0.3, 0.3, 0.6


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right is doubled, its digits summed."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(text: str) -> bool:
    """The check of account numbers: country and check digits moved last, letters as 10 to 35, remainder 1."""
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at-sign takes the run of local characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str | None) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) in code points, by start, then kind as listed. Null and empty texts have none."""
    if not text:
        return []
    found = [(s, "email", e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        found += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found += [(m.start(), "iban", m.end()) for m in IBAN.finditer(text) if mod97(m[0])]
    found += [(m.start(), "ssn", m.end()) for m in SSN.finditer(text)]
    out = []
    for start, kind, end in found:
        near = text[max(0, start - WINDOW) : start]
        hinted = HINTS[kind].search(near) or HINTS[kind].search(text[end : end + AFTER])
        score = PRIOR[kind] + HINT * bool(hinted) - COUNTER * bool(AGAINST.search(near))
        if kind in BASE or score >= ACCEPT:
            out.append((start, kind, end, round(min(1.0, max(0.0, score)), 2)))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in carry, and pii: every span with kind, start, end and score, in whole texts.

    One pass over each partition in Arrow batches; nothing is shuffled. Null and empty texts: an empty array.
    Repeated rows each get their own. Empty table: empty result. Linear in the text: no pattern rescans a long run.
    Columns in carry must not be called pii.
    """
    ship(docs.sparkSession)
    names = list(carry)
    if taken := {"pii", "__text"} & set(names):
        raise ValueError(f"carried columns must be renamed first: {', '.join(sorted(taken))}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e, "score": p} for s, k, e, p in find_spans(t.as_py())] for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(spans, kind)], names=[*names, "pii"])

    rows = docs.select(*names, F.col("text").alias("__text"))
    return rows.mapInArrow(scan, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema if f.name != '__text')}, pii {SPANS}")


def mask_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become the first one's."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end, _ in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("pii", of(k, "kind"))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), scores.alias("scores"))
