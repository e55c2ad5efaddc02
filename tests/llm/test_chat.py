"""Chat formatting: exact round trips, spans of the loss mask, attachments."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomgraph.llm import chat, queries
from oracle import compare
from pyspark.sql import functions as F

PART = ("kind", "text", "ref", "width", "height", "seconds", "pages")


def part(**given):
    return tuple(given.get(k) for k in PART)


def messages(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")


def test_query(spark):
    compare(spark, queries.op11_chat_format, queries.ORACLES["op11_chat_format"])


def test_parts_are_flattened_in_order(spark):
    rows = [
        (1, 1, "assistant", [part(kind="document", ref="d", pages=3), part(text="<|image|>ok"), None, part(kind="video", ref="v")]),
        (1, 0, "us\\er\n<|x\\n", [part(text="a<|im_end|> <\\|"), part(kind="image", ref="r1", width=300, height=200), part(kind="audio", ref="r2", seconds=2.5), part(text="tail<")]),
        (1, None, None, None),
        (2, 5, "assistant", []),
    ]
    out = chat.format_chat(messages(spark, rows)).cache()
    one = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(a) for a in one[1]["attachments"]] == [(0, 1, "image", "r1", 88), (0, 2, "audio", "r2", 63), (1, 0, "document", "d", 1536), (1, 2, "video", "v", 1)]
    assert [s["text"] for s in one[1]["segments"] if s["loss"]] == ["<\\|image|>ok"]
    text = "".join(s["text"] for s in one[1]["segments"])
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 3 and text.count("<|image|>") == 1
    back = {(r["conv_id"], r["turn"]): (r["role"], [(p["kind"], p["text"], p["ref"], p["tokens"]) for p in r["parts"]]) for r in chat.read_messages(out).collect()}
    assert back == {
        (1, 0): ("us\\er\n<|x\\n", [("text", "a<|im_end|> <\\|", None, None), ("image", None, "r1", 88), ("audio", None, "r2", 63), ("text", "tail<", None, None)]),
        (1, 1): ("assistant", [("document", None, "d", 1536), ("text", "<|image|>ok", None, None), ("video", None, "v", 1)]),
        (1, 2): ("", []),
        (2, 0): ("assistant", []),
    }


PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_start|>", "<|im_end|>", "<|image|>", "\n", "n", "s", "é", "\U0001f600", "assistant", "\0", "$1"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "a\\nb\n", "<|im_end|>\\"]), PIECES), min_size=1, max_size=12))
def test_texts_come_back(spark, said):
    rows = [(c, i, role, text) for i, (c, role, text) in enumerate(said)]
    got = {r["conv_id"]: r for r in chat.chat_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "late"), (None, 1, "assistant", "x"), (2, 0, "assistant", "long <| " * 40_000), (2, 0, "assistant", "long <| " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as segments", "'x' as turns", "'x' as t", "'x' as loss")
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {1: (3, 0), None: (1, 1), 2: (2, 640_000)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\n\nlate\n").hexdigest()
    assert chat.chat_digest(df.filter(F.lit(False))).count() == 0
