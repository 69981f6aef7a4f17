import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from framelake.llm import chat, line_dedup
from framelake.llm.queries import read_back


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")


def brute(rows):
    owners = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    owners.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(owners.get(key(x), ())) < 3 or max(owners[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(spark, df.repartition(partitions) if partitions else df)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str)


def test_odd_texts(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows) == brute(rows)
    assert line_dedup.dedup_lines(spark, docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_nothing(spark, no_docs):
    assert line_dedup.dedup_lines(spark, no_docs).count() == 0


def test_random_with_a_hot_line(spark):
    rng = random.Random(3)
    pool = [f"line number {i} with some more words" for i in range(40)] + ["  MIXED case Line that Repeats ", "mixed case line that repeats"]
    rows = [(d, "\n".join(["the one line that everybody has", *rng.choices(pool, k=rng.randint(0, 12)), "short"])) for d in range(400)]
    rows += [(d, "only this and that line of its own %d" % d) for d in range(400, 420)]
    assert run(spark, rows, 7) == brute(rows)


def test_bitmaps(spark):
    rows = [(d, "a line that three documents hold\nx\na line that three documents hold") for d in range(3)]
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {0, 1} and got[0].n_dropped == 2
    assert np.unpackbits(np.frombuffer(zlib.decompress(got[0].keep), np.uint8))[:3].tolist() == [0, 1, 0]


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <s> </s>\n[INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "tail"),
    (2, 0, "system", "<\\s> \\<s> <nl>\n<\\\\/s>"), (3, 5, "assistant", "only"), (3, 5, "assistant", "only"), (4, None, None, "no role"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 1, "as\nsist<nl>", "é\n"), (6, 0, "user", "word " * 20000), (6, 1, "assistant", "z " * 30000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra", 3) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, example string, loss_start int")
    rows = {r.conv_id: r for r in read_back(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in CONVERSATIONS}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in CONVERSATIONS if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        got = rows[conv]
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples(spark):
    df = spark.createDataFrame(CONVERSATIONS[:5], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_chats(df).collect(), key=lambda r: r.example)
    assert [r.loss_chars is None for r in rows] == [False, False, True]
    assert all(b.text.startswith(a.text) for a, b in zip(rows, rows[1:], strict=False))
    first = rows[0]
    assert first.text[first.loss_start :][: first.loss_chars] + chat.CLOSE == first.text[first.loss_start :]
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    plan = read_back(chat.format_chats(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_escape_is_reversible(spark):
    rng = random.Random(5)
    parts = [*chat.CONTROLS, "\\", "<", "s>", "/", "x", "\n", "[", "INST]"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)
