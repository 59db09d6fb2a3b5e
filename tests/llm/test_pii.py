import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from trialforge.llm import pii

from .helpers import odd_docs


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The contract read plainly: base spans by start, then kind."""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [x[2] for x in sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))]


def base(text):
    return [f"{k}:{s}:{e}" for s, k, e, _ in pii.find_spans(text) if k in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.cc", "_d@", "@", ".", "-", " ", "1", "23", "255", "256.", "1.2.3.4", "+1 (2", "+4", ")", "4111 1111 1111 1111", "0", "é", "x", "\n", "007.1.1.1", "%"]), max_size=24).map("".join))
def test_as_plain(text):
    assert base(text) == plain(text)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op8_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.BASE]
        assert set(want) <= set(r.spans.split(","))


def test_validators_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [k for _, k, _, _ in pii.find_spans("pay to iban GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert pii.find_spans("order 123-45-6789") == [] and pii.find_spans("his ssn 123-45-6789")[0][1] == "ssn"
    assert pii.find_spans("call +1 (743) 555-3824")[0][3] > pii.find_spans("+1 (743) 555-3824")[0][3]
    assert pii.mask_text("to a@b.cc or 10.0.0.1") == "to [EMAIL] or [IP]" and pii.mask_text(None) is None


def added(text):
    """Account and identity numbers, and all scores, by definition."""
    def mod97(s):
        s = s.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in s[4:] + s[:4])) % 97 == 1

    found = [(int(w.split(":")[1]), w.split(":")[0], int(w.split(":")[2])) for w in plain(text)]
    found += [(m.start(), "iban", m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text) if mod97(m[0])]
    found += [(m.start(), "ssn", m.end()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text)]
    words = {"email": "email e-mail mail contact write", "ip": "ip host server address login", "card": "card visa credit payment cc", "phone": "phone tel call fax mobile", "iban": "iban account bank transfer", "ssn": "ssn social security"}
    has = lambda part, listed: any(re.search(rf"\b{re.escape(w)}\b", part.lower()) for w in listed.split())
    out = []
    for s, k, e in found:
        before, after = text[max(0, s - 40) : s], text[e : e + 24]
        score = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.95, "ssn": 0.4}[k]
        score += 0.3 * (has(before, words[k]) or has(after, words[k])) - 0.3 * has(before, "version release example order invoice isbn serial")
        if k in pii.BASE or score >= 0.6:
            out.append((s, k, e, round(min(1.0, max(0.0, score)), 2)))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[1])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.cc", "1.2.3.4", "+1 (743) 555-3824", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "123-45-6789", "my SSN", "social", "Order", "bank", "host", "call", "é and more words", "version"]), max_size=14).map(" ".join))
def test_added_spans_and_scores(text):
    assert pii.find_spans(text) == added(text)


def test_long_runs_are_linear():
    for run in ("a" * 300000, "1" * 300000, "1." * 100000, "+1" * 100000, "a@" * 100000, "GB12 " * 50000):
        pii.find_spans(run)


def test_odd_rows(spark):
    docs = odd_docs(spark, "pii")
    out = pii.pii_spans(docs, ("doc_id", "lang"))
    assert out.count() == docs.count() and out.columns == ["doc_id", "lang", "pii"]
    assert pii.pii_spans(docs.limit(0)).count() == 0
