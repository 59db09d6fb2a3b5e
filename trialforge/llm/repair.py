"""Conversation structure repair: the cheapest edits that give alternating roles, as a path through a graph of tight arcs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import WORD, table

#: Fixed by the contract.
DROPPED, EMPTIED, UNENDED, REPEATED, REROLED, KINDS = 0, 1, 2, 3, 4, 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: What WORD leaves out.
SPACE = " \t\n\x0b\f\r"

#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
FAR = 1 << 60
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a turn of an initial leads to; the state that a user's or an assistant's turn may follow.
BY_INITIAL = {(START, "s"): SYSTEM, **{(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
TURN_OF = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}

#: What a row is to the path is one byte: see code_of.
INITIALS = " sua"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy (0, or 1 for a repeat) after the contract's damage, which depends on the CRC-32
    of `conv_id:turn`. Null role or text: one space, and so is a null in that key. The text is edited before it is repeated."""
    space = lambda c, kind="string": F.coalesce(F.col(c).cast(kind), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % KINDS
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter(F.col("kind") != DROPPED)
    text = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNENDED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == REROLED, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows, fault: blank, duplicate, truncated (the first that holds) or null, and text_hash.

    The earlier rows of a conversation are those before in (turn, role, text_hash, copy), nulls first. A duplicate is any but
    the first of its conversation, role and text; they meet by a hash of the text, so neither a long conversation nor
    its texts come into one task for that, and equal rows are counted in order.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    same = Window.partitionBy("conv_id", "role", "text_hash").orderBy(F.col("turn").asc_nulls_first(), "copy")
    marked = rows.withColumn("text_hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("__nth", F.row_number().over(same))
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(F.col("__nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return marked.withColumn("fault", fault).drop("__nth")


def code_of(role: Column, fault: Column) -> Column:
    """A row in one number: its initial's place in INITIALS (0 for any other), plus 8 if it must go, plus 16 if it is cut off."""
    initial = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(0)
    return initial + F.when(fault.isin("blank", "duplicate"), 8).when(fault == "truncated", 16).otherwise(0)


def arcs(code: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of what a row allows in state q, apart from insertions."""
    out = [("D", DELETE, q)]
    if not code & 8:
        more = TRUNCATED if code & 16 else 0
        to = BY_INITIAL.get((q, INITIALS[code & 7]))
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, TURN_OF[q]))
    return out


ARCS = {code: [arcs(code, q) for q in range(4)] for base in (0, 8, 16) for code in range(base, base + 4)}


def inserted(costs: list[int]) -> list[int]:
    """The costs of the states at one place once insertions may be made there: each leads to the state of the turn that fits."""
    for _ in range(2):  # no cheapest path inserts more than two turns in one place
        costs = [min(c, costs[TURN_OF[q]] + INSERT) for q, c in enumerate(costs)]
    return costs


class Path:
    """The cheapest edits of one conversation, with memory of a byte a row.

    add() takes the rows' codes in order. Then each step() goes by one row and gives the letters for it: insertions
    before it and its own. Backward costs (from a state at a row to the end) are kept at every stride-th row and made
    anew for the stretch that is being walked. An arc is tight if forward cost, arc and backward cost make up the
    total. All states that the letters so far lead to by tight arcs are the frontier; the least letter on is taken.
    """

    def __init__(self, stride: int = 1024):
        self.codes, self.stride = bytearray(), stride

    def add(self, code: int) -> None:
        self.codes.append(code)

    def _back(self, code: int, after: list[int]) -> list[int]:
        return inserted([min(cost + after[to] for _, cost, to in options) for options in ARCS[code]])

    def begin(self) -> int:
        """The total cost; to be called once all rows are added."""
        cost = inserted([0 if q in ENDS else FAR for q in range(4)])
        self.marks = {len(self.codes): cost}
        for i in range(len(self.codes) - 1, -1, -1):
            cost = self._back(self.codes[i], cost)
            if i % self.stride == 0:
                self.marks[i] = cost
        self.total, self.at, self.stretch = cost[START], 0, []
        self.frontier = {START: 0}  # state: forward cost
        self._load()
        return self.total

    def _load(self) -> None:
        """Backward costs of the stretch of rows that begins at self.at."""
        end = min(self.at + self.stride, len(self.codes))
        cost = self.marks[end]
        self.stretch = [cost]
        for i in range(end - 1, self.at - 1, -1):
            cost = self._back(self.codes[i], cost)
            self.stretch.append(cost)
        self.stretch.reverse()
        self.base = self.at

    def _options(self, now: list[int], code: int | None) -> Iterator[tuple[str, int, int, int]]:
        after = self.stretch[self.at - self.base + 1] if code is not None else None
        for q, cost in self.frontier.items():
            if cost + INSERT + now[TURN_OF[q]] == self.total:
                yield "I", cost + INSERT, q, TURN_OF[q]
            for letter, add, to in ARCS[code][q] if code is not None else ():
                if cost + add + after[to] == self.total:
                    yield letter, cost + add, q, to

    def step(self) -> list[tuple[str, int]]:
        """(letter, state) for the next row: any insertions, then its own. At the end, the insertions there."""
        out = []
        code = self.codes[self.at] if self.at < len(self.codes) else None
        while True:
            now = self.stretch[self.at - self.base]
            if code is None and any(q in ENDS and cost == self.total for q, cost in self.frontier.items()):
                return out
            found = list(self._options(now, code))
            letter = min(x[0] for x in found)
            self.frontier = {to: cost for x, cost, _, to in found if x == letter}
            out.append((letter, next(iter(self.frontier))))
            if letter != "I":
                self.at += 1
                if self.at - self.base >= self.stride and self.at < len(self.codes):
                    self._load()
                return out


COLUMNS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


class Repair:
    """One conversation: codes first, then its rows in the same order, with no text held."""

    def __init__(self):
        self.path, self.begun = Path(), False
        self.counts, self.illegal, self.audit, self.hash, self.first, self.initial = [0, 0, 0], 0, [], hashlib.sha256(), True, None

    def _put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def _apply(self, letters: list[tuple[str, int]], role: str = "", text: str = "") -> None:
        for letter, state in letters:
            self.audit.append(letter)
            if letter == "I":
                self._put(NAMES[state], "")
            elif letter == "R":
                self._put(NAMES[state], text)
            elif letter == "K":
                self._put(role, text)

    def row(self, role: str, text: str, fault: str | None) -> None:
        if not self.begun:
            self.cost, self.begun = self.path.begin(), True
        if fault:
            self.counts[("blank", "duplicate", "truncated").index(fault)] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self._apply(self.path.step(), role, text)

    def done(self) -> tuple:
        if not self.begun:
            self.cost = self.path.begin()
        self._apply(self.path.step())
        return (*self.counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id and COLUMNS of each conversation of turns (conv_id, turn, role, text, copy): its faults, the adjacent rows
    whose initials aren't su, ua or au, the cost and the letters of the cheapest edits (ASCII-least of equal ones), and
    the digest of the repaired conversation.

    Each row goes to its conversation's task twice: as a code, all of which come first, and with its text, in order.
    So a task holds a byte a row and no text; a digest runs over the turns in order, which is why one conversation is one
    task's. A role without an initial fits nowhere: it is
    given a role or goes. Null conv_id: one conversation. Null turns come first; rows of one turn in the order of role, hash of the text and copy.
    Repeated rows are duplicates. Empty table: empty result. Other columns are left.
    """
    ship(turns.sparkSession)
    rows = with_faults(turns.select("conv_id", "turn", "role", "text", "copy"))
    rows = rows.withColumn("code", code_of(F.col("role"), F.col("fault")))
    both = rows.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            for conv, role, text, fault, code, second in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "fault", "code", "pass")), strict=True):
                if one is None or now != conv:
                    if one is not None:
                        out.append((now, *one.done()))
                    now, one = conv, Repair()
                if second:
                    one.row(role, text, fault)
                else:
                    one.path.add(code)
            if len(out) >= 5000:
                yield flush()
        if one is not None:
            out.append((now, *one.done()))
        if out:
            yield flush()

    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "pass", F.col("turn").asc_nulls_first(), "role", "text_hash", "copy")
    return dealt.select("conv_id", "role", "fault", "code", "pass", "text").mapInArrow(work, f"conv_id long, {COLUMNS}")


def gaps(turns: DataFrame) -> DataFrame:
    """conv_id and gaps: whole turns that are missing between the least and the greatest; null turns don't count."""
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = damaged(turns)
    every = turns.select("conv_id").distinct()
    out = every.join(gaps(rows).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    out = out.join(repaired(rows).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    none = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return out.select("conv_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])


def _sql() -> str:
    """The query in DuckDB SQL: the CRC-32 by its table, and a recursion over rows with the least (cost, letters) of each state.

    Two ways into one state at one row with equal costs never have letters of which one begins the other (the longer one
    would have more insertions), so the least letters of a state stay the least whatever follows.
    """
    add = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}}"
    least = lambda *xs: f"list_sort([{', '.join(xs)}])[1]"
    given = lambda when, x: f"CASE WHEN {when} THEN {x} ELSE {{'c': {FAR}::BIGINT, 'a': ''}} END"
    states = "n s u a".split()

    def inserted(source: str) -> str:
        once = f"SELECT * REPLACE ({least('u', *[add(q, INSERT, 'I') for q in 'nsa'])} AS u, {least('a', add('u', INSERT, 'I'))} AS a) FROM ({source})"
        return f"SELECT * REPLACE ({least('u', *[add(q, INSERT, 'I') for q in 'nsa'])} AS u, {least('a', add('u', INSERT, 'I'))} AS a) FROM ({once})"

    more = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    free = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    keep = lambda q, x: given(f"{free} AND role LIKE '{x}%'", add(q, f"{KEEP} + {more}", "K"))
    rerole = lambda q: given(free, add(q, f"{REROLE} + {more}", "R"))
    gone = lambda q: add(q, DELETE, "D")
    step = {"n": gone("n"), "s": least(gone("s"), keep("n", "s")), "u": least(gone("u"), *[f(q) for q in "nsa" for f in (lambda q: keep(q, "u"), rerole)]), "a": least(gone("a"), keep("u", "a"), rerole("u"))}
    far = f"{{'c': {FAR}::BIGINT, 'a': ''}}"
    return f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % {KINDS} AS kind FROM src CROSS JOIN tab),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = {REROLED} THEN 'user' ELSE role END AS role, CASE WHEN kind = {EMPTIED} THEN '' WHEN kind = {UNENDED} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = {REPEATED} THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> {DROPPED}),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM rows_),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0::BIGINT, 'a': ''}} AS n, {far} AS s, {far} AS u, {far} AS a FROM counts
  UNION ALL
  SELECT conv_id, i + 1, {', '.join(f'{step[q]} AS {q}' for q in states)} FROM (SELECT p.*, role, fault FROM ({inserted('SELECT conv_id, i, n, s, u, a FROM walk')}) p JOIN f ON f.conv_id = p.conv_id AND f.i = p.i + 1)
),
ends AS (SELECT conv_id, {least('n', 'a')} AS best FROM ({inserted('SELECT w.conv_id, w.n, w.s, w.u, w.a FROM walk w JOIN counts c ON c.conv_id = w.conv_id AND c.m = w.i')})),
letters AS (SELECT conv_id, j, best.a[j] AS x FROM (SELECT conv_id, best, unnest(range(1, len(best.a) + 1)) AS j FROM ends)),
placed AS (SELECT conv_id, j, x, count(*) FILTER (WHERE x <> 'I') OVER w AS i, count(*) FILTER (WHERE x <> 'D') OVER w AS k FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
made AS (SELECT p.conv_id, j, k, x, role, CASE WHEN x = 'I' THEN '' ELSE text END AS text FROM placed p LEFT JOIN f ON f.conv_id = p.conv_id AND f.i = p.i AND p.x <> 'I' WHERE x <> 'D'),
lead_ AS (SELECT *, max(CASE WHEN k = 1 AND x = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS first FROM made),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (k - first) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h FROM lead_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id) LEFT JOIN fixed USING (conv_id)
"""


ORACLE = _sql()
