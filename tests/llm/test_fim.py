"""Fill-in-middle against plain code, and places in chunks and blocks of any size."""

import hashlib
import random
import re

import numpy as np
import pytest

from veinstone.llm import fim

SCHEMA = "doc_id long, text string, n string, form string, row string, whole long, places string, output string"


def plain(i, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    drawn = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    marked = any(x in text for x in ("<P>", "<S>", "<M>"))
    form = "plain" if not text or marked or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(tokens), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(output), sha(text)


def rows():
    rng = random.Random(11)
    texts = ["".join(rng.choice("aB zZ1é中\U0001f600\n\0<PSM>") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += [None, "", "a" * 50, "<P>x", "a<S>b", "x <M", "<<S", "<P", "x" * 9000 + " y" * 9000, "é" * 5000, "\r\n \x85  a", "lorem ipsum " * 30_000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "abc def"), (None, None), (3, "again and again"), (3, "again and again"), (-5, "x y z"), (1 << 60, "x y z")]


@pytest.mark.parametrize("size", [2, fim.CHUNK])
def test_fill_in_middle_equals_plain_code(spark, size):
    docs = spark.createDataFrame([(i, t, "n", "f", None, 1, "p", "o") for i, t in rows()], SCHEMA)
    few = docs if size == fim.CHUNK else docs.where("length(text) < 1000 OR text IS NULL")
    got = fim.digest(fim.fill_in_middle(few, size=size)).collect()
    want = [plain(i, t) for i, t in rows() if size == fim.CHUNK or len(t or "") < 1000]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fill_in_middle_keeps_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here", "n", "f", "r", 7, "p", "o")], SCHEMA)
    found = fim.fill_in_middle(docs).select("row.*").first()
    assert tuple(found) == tuple(docs.first())
    assert fim.digest(fim.fill_in_middle(docs.limit(0))).collect() == []
    other = docs.select("doc_id", "text").toDF("id", "body")
    assert fim.fill_in_middle(other, id_col="id", text_col="body").count() == 1


@pytest.mark.parametrize("chunk, block", [(1, 1), (3, 5), (3, 1000), (50, 49), (4096, 1 << 22)])
def test_cuts_in_chunks_and_blocks_of_any_size(chunk, block):
    rng = random.Random(chunk * 1000 + block)
    texts = ["".join(rng.choice("ab é中\U0001f600") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(80)]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)]).astype("i8")
    one, other = (np.array([rng.randrange(1 << 32) for _ in texts], "i8") for _ in range(2))
    got = fim.cuts(np.frombuffer(b"".join(data), "u1"), bounds, one, other, chunk, block)
    for text, x, y, (n, a, b) in zip(texts, one.tolist(), other.tolist(), got.tolist(), strict=True):
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        first, second = sorted((x % (len(tokens) + 1), y % (len(tokens) + 1)))
        assert (n, a, b) == (len(tokens), len("".join(tokens[:first])), len("".join(tokens[:second])))


def test_restored_from_the_output_alone(spark):
    parts = ["", "<", "<S", "P>", "a<", "S>b", "M>", "x\n"]
    rows = [(f"<P>{p}<S>{s}<M>{m}", "psm", p + m + s) for p in parts for m in parts for s in parts] + [(f"<S>{s}<P>{p}<M>{m}", "spm", p + m + s) for p in parts for m in parts for s in parts]
    rows = [r for r in rows if not re.search("<[PSM]>", r[2]) and not any(re.search("<[PSM]>", x) for x in re.split("<[PSM]>", r[0]))] + [("<P", "plain", "<P")]
    df = spark.createDataFrame(rows, "output string, form string, want string")
    from pyspark.sql import functions as F

    wrong = df.where(fim.restored(F.col("output"), F.col("form")) != F.col("want")).collect()
    assert wrong == []
