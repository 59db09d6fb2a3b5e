"""Conversation repair against a plain search over all edits, and the damage and faults by definition."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trialforge.llm import repair
from trialforge.llm.queries import oracle_sql, queries

from tests.test_queries import canon

GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows, most):
    """The least (cost, letters, repaired rows) by a search in that order: rows are (role, text, fault)."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, letters, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in out)
        if i == len(rows) and GOOD.match(initials):
            return cost, letters, out
        if not re.match(r"s?(ua)*u?\Z", initials) or cost > most:
            continue
        grow = [("I", 5, i, (*out, (r, ""))) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            more = 5 * (fault == "truncated")
            grow.append(("D", 2, i + 1, out))
            if fault not in ("blank", "duplicate"):
                grow.append(("K", more, i + 1, (*out, (role, text))))
                grow += [("R", 1 + more, i + 1, (*out, (r, text))) for r in ("user", "assistant")]
        for letter, add, to, made in grow:
            heapq.heappush(heap, (cost + add, letters + letter, to, made))
    raise AssertionError


def brute(turns):
    """conv_id: all columns, from (conv_id, turn, role, text) rows, by definition."""
    by, out = defaultdict(list), {}
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in turns:
        by.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text)
        by[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        known = {t for t, _, _ in rows if t is not None}
        seen, marked = set(), []
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, letters, fixed = cheapest(marked, 2 * len(marked))
        out[conv] = {
            "gaps": max(known) - min(known) + 1 - len(known) if known else 0, **{k: sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), "cost": cost, "audit": letters,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        }
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries()["op13_conversation_repair"](spark, str(tmp_path)).collect()}


def test_random_conversations(spark, tmp_path):
    rng, rows = random.Random(5), []
    for conv in range(300):
        for turn in range(rng.randint(0, 6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "uncle", "sage"])
            rows.append((conv if conv else None, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "No", "", " \n", None, "Why?", "Go!\t", f"number {turn}.", "é…"])))
    a, b = got(spark, frame(spark, rows).withColumn("fault", F.lit(1)), tmp_path), brute(rows)
    assert {k: (a.get(k), b.get(k), [r for r in rows if r[0] == k]) for k in b if a.get(k) != b[k]} == {}


def test_given_table(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, frame(spark, rows), tmp_path) == brute(rows)


def test_empty_table_and_dropped_rows(spark, tmp_path):
    assert got(spark, frame(spark, []), tmp_path / "a") == {}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    assert got(spark, frame(spark, [(gone, 0, "user", "Hi.")]), tmp_path / "b") == {gone: empty}


@pytest.mark.parametrize("stride", [1, 3, 1024])
def test_long_conversations_in_stretches(stride):
    """Costs kept at some rows only give the same letters; the cost is that of a forward search."""
    rng = random.Random(stride)
    codes = [rng.choice([0, 1, 2, 3, 2, 3, 8, 18, 19]) for _ in range(3000)]
    path = repair.Path(stride)
    for c in codes:
        path.add(c)
    total = path.begin()
    letters = [x for _ in range(len(codes) + 1) for x in path.step()]
    best = [0, *[repair.FAR] * 3]
    for c in codes:
        for _ in range(2):
            for q in range(4):
                best[repair.TURN_OF[q]] = min(best[repair.TURN_OF[q]], best[q] + 5)
        new = [repair.FAR] * 4
        for q in range(4):
            for _, cost, to in repair.ARCS[c][q]:
                new[to] = min(new[to], best[q] + cost)
        best = new
    assert total == min(best[repair.START], best[repair.ASSISTANT], best[repair.USER] + 5, best[repair.SYSTEM] + 10)
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    body = [x for x, _ in letters if x != "I"]
    assert len(body) == len(codes) and sum(price[x] for x, _ in letters) + 5 * sum(c & 16 > 0 and x != "D" for c, x in zip(codes, body)) == total
    assert letters == _letters(codes)


def _letters(codes):
    p = repair.Path(10**6)
    for c in codes:
        p.add(c)
    p.begin()
    return [x for _ in range(len(codes) + 1) for x in p.step()]


def test_sql_agrees(spark, sf, tmp_path):
    """The SQL on the given table and on repeated turns, null turns and texts, and empty roles."""
    rng, rows = random.Random(9), []
    for conv in range(120):
        for _ in range(rng.randint(0, 6)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["system", "user", "assistant", None, "tool", ""]), rng.choice(["Yes.", "No", "", None, "Why?", "more words. "])))
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    for where, files in ((sf, f"{sf}/conversations.parquet"), (str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from read_parquet('{files}')")
        assert canon(queries()["op13_conversation_repair"](spark, where).toPandas()) == canon(con.execute(oracle_sql()["op13_conversation_repair"]).df())
