import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from trialforge.llm import chat

BITS = st.lists(st.sampled_from([chat.START, chat.END, "<\\|im_end|>", "<\\\\|im_start|>", "<", "|", "\\", "\n", "im_end|>", "|im_start", "ok", "é🙂", "assistant", " "]), max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(BITS, BITS), max_size=4))
def test_round_trip(turns):
    blocks = [chat.render_turn(r, t) for r, t in turns]
    whole = "".join(b[0] for b in blocks)
    assert chat.parse(whole) == turns
    for (_, t), (b, s, e, _) in zip(turns, blocks):
        assert chat.unescape(b[s:e]) == t
    p, got = chat.Parser(), []
    for c in whole:
        got += p.feed(c)
    assert got == turns


def test_bad_input():
    for bad in ("x", chat.START, f"{chat.START}a\n{chat.END}", f"{chat.START}a{chat.END}\n", f"a{chat.START}a\nb{chat.END}\n", f"{chat.START}a\n{chat.START}{chat.END}\n"):
        try:
            chat.parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def plain(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1])):
        convs.setdefault(c, []).append((r or "", x or ""))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), h("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), h(loss))
    return out


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op3_chat_round_trip(spark, sf).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", chat.PROBE * 3), (1, 2, "a\nb\\", "x" * 100000), (None, 0, "assistant", ""), (2, 5, "assistant", "late"), (2, 4, "user", "early"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_chat(df.withColumn("block", df["turn"])))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == plain(rows)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
