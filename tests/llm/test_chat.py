"""Chat windows against plain code: spans, repeated turns, masks and the way back."""

import hashlib
import random
import re
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from veinstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, mid string, key string, start long, tokens string"


def tokens(text):
    return len(re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", text)) + 4


def escape(text):
    return re.sub(r"(?<!\\)(\\*</?turn)", r"\\\1", text)


def plain(rows, budget, fresh, history):
    """conversation -> [(formatted text, texts under the mask)] by spans and sums over lists."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        system = turns[0][0] == "system"
        own, at = [], 0
        for i, (_, text) in enumerate(turns):
            n = 0 if system and i == 0 else tokens(text)
            own.append((at, at + n))
            at += n
        spans = {}
        for i, (_, after) in enumerate(own):
            spans.setdefault(max(after - 1, 0) // fresh, []).append(i)
        windows = []
        for span, members in spans.items():
            first = members[0]
            if own[first][0] < span * fresh and own[members[-1]][1] - own[first][0] > fresh:
                windows += [[first], members[1:]]
            else:
                windows.append(members)
        out[conv] = []
        for members in filter(None, windows):
            begin, end = own[members[0]][0], own[members[-1]][1]
            room = min(history, max(budget - (tokens(turns[0][1]) if system else 0) - (end - begin), 0))
            repeated = [i for i in range(members[0]) if not (system and i == 0) and own[i][0] >= begin - room] if room else []
            if system and members[0] > 0:
                repeated = [0, *repeated]
            text = "".join(f"<turn {quote_plus(turns[i][0])}>\n{escape(turns[i][1])}\n</turn>\n" for i in repeated + members)
            out[conv].append((text, [turns[i][1] for i in members if turns[i][0] == "assistant"], len(repeated)))
    return out


def table(seed=13):
    """Conversations of all lengths; turns with one number have different texts or are repeated whole."""
    rng = random.Random(seed)
    pieces = ["word", "</turn>", "<turn user>", "\\</turn", "\\\\<turn", "\n", "\n</turn>\n", "é", "中", "\U0001f600", "\\", "<", "### Assistant:", " ", "9"]
    rows = []
    for conv in range(60):
        if rng.random() < 0.5:
            rows.append((conv, 0, "system", " ".join(rng.choice(pieces) for _ in range(rng.choice([0, 3, 30])))))
        for turn in range(1, rng.choice([1, 2, 5, 12, 40])):
            rows.append((conv, turn, ["user", "assistant", "tool use/1>", "system"][rng.choice([0, 0, 1, 1, 1, 2, 3])], "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 4, 20, 90])))))
    rows += [(100, 0, "system", "alone"), (101, None, "assistant", None), (101, 2, None, "x"), (102, 1, "user", None), (102, 2, "assistant", "long " * 20_000)]
    rows += [(103, 5, "assistant", "same")] * 4 + [(104, t, "user" if t % 2 else "assistant", f"turn {t} of a long conversation") for t in range(2500)]
    rows += [(None, 1, "user", "q"), (None, 2, "assistant", "a \\")]
    return rows


@pytest.mark.parametrize("budget, fresh, history", [(chat.BUDGET, chat.FRESH, chat.HISTORY), (60, 30, 20), (20, 10, 0)])
def test_windows_equal_plain_code(spark, monkeypatch, budget, fresh, history):
    monkeypatch.setattr(chat, "BLOCK", 4 if budget < 100 else chat.BLOCK)
    rows = table()
    turns = spark.createDataFrame([(*r, "m", "k", 1, "t") for r in rows], SCHEMA)
    found = chat.windows(turns, budget=budget, fresh=fresh, history=history)
    got, masked = {}, {}
    for r in found.orderBy("start").collect():
        got.setdefault(r["key"]["id"], []).append((r["text"], [re.sub(r"(?<!\\)\\(\\*</?turn)", r"\1", r["text"][s["from"] : s["to"]]) for s in r["loss"]], r["n_repeated"]))
        masked.setdefault(r["key"]["id"], []).extend(got[r["key"]["id"]][-1][1])
    want = plain(rows, budget, fresh, history)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert masked[104] == [t for _, _, role, t in sorted(r for r in rows if r[0] == 104) if role == "assistant"]


def test_digest_is_read_back(spark):
    rows = table(14)
    turns = spark.createDataFrame([(*r, "m", "k", 1, "t") for r in rows], SCHEMA)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    formatted = plain(rows, 60, 30, 20)
    for conv, said in by.items():
        said = sorted(said)
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        want.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for _, _, r, t in said)), len(loss), sha(loss), sum(len(w[0]) for w in formatted[conv])))
    got = chat.digest(chat.windows(turns, budget=60, fresh=30, history=20)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert chat.digest(chat.windows(turns.limit(0))).collect() == []


def test_escapes_are_undone(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["\\", "\\\\", "<turn", "</turn", "</turn>", "<", "\n", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["\\" * 100_000 + "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    assert df.where(chat.unescaped(F.col("e")) != F.col("t")).count() == 0
    assert df.where(F.col("e").rlike(r"(?<!\\)</?turn")).count() == 0


def test_windows_keep_the_budget(spark):
    rng = random.Random(6)
    rows = [(c, t, ["user", "assistant"][t % 2], "w " * rng.randint(0, 20)) for c in range(20) for t in range(60)]
    found = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=80, fresh=40, history=30)
    for r in found.collect():
        texts = [p.split("\n", 1)[1] for p in r["text"].split(chat.LAST)[:-1]]
        assert sum(map(tokens, texts)) <= 80 and sum(map(tokens, texts[r["n_repeated"] :])) <= 40


def test_a_hot_conversation_lies_in_many_tasks(spark):
    turns = spark.createDataFrame([(1 if i < 3000 else i, i, "user", f"text {i}") for i in range(4000)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = chat.in_order(turns, "conv_id", "turn", "role", "text").where("key.id = 1").groupBy(F.shiftright("mid", 33)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and sum(p["count"] for p in parts) == 3000
