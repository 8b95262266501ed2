"""Importance resampling against plain code over all rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from veinstone.llm import resample

SCHEMA = "doc_id long, text string, key string, score string, rank string, copies long, id string"


def plain(docs, items, percent=10, min_words=20, longest=1, buckets=10_000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (t or "").translate(lower))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(f for _, x in docs for f in features(x)), Counter(f for x in items for f in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, x in docs:
        own = features(x)
        weight = sum(gain(b) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)), hashlib.sha256((x or "").encode()).digest()])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[6]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdeé中Z9") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 40, 90]))) + rng.choice(["", "!", "\n.", "\x00 x"]) for _ in range(300)]
    texts += [texts[7]] * 120 + [None, "", "...", "word " * 40_000, "A" * 5000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[5]), (5, texts[6]), (5, texts[5])], [" ".join(rng.choice(vocabulary[:40]) for _ in range(30)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50, "percent": 33, "min_words": 5}])
def test_resample_equals_plain_code(spark, options):
    docs, items = rows()
    table = spark.createDataFrame([(i, t, "k", "s", "r", 1, "i") for i, t in docs], SCHEMA)
    target = spark.createDataFrame([(t, 1) for t in items], "text string, copies long")
    found = resample.resample(table, target, **options)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == plain(docs, items, **options)
    taken = resample.sample(table, found)
    assert taken.columns == table.columns and taken.count() >= found.where("rank IS NOT NULL").count()


def test_resample_of_empty_tables(spark):
    docs, items = rows()
    table = spark.createDataFrame([(i, t, "k", "s", "r", 1, "i") for i, t in docs[:30]], SCHEMA)
    target = spark.createDataFrame([(t, 1) for t in items], "text string, copies long")
    assert resample.resample(table.limit(0), target).collect() == []
    got = resample.resample(table, target.limit(0))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain(docs[:30], [])


def test_identical_texts_are_collapsed_before_features(spark):
    docs, _ = rows()
    table = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    found = resample.features(resample.collapsed(table)).collect()
    assert len(found) == len({t or "" for _, t in docs})
    assert sum(r["copies"] for r in found) == len(docs)


def test_ranks_over_many_partitions(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    values = [(i, rng.randrange(500)) for i in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.ranked(spark.createDataFrame(values, "id long, score long"), [F.desc("score"), F.asc("id")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {i: place + 1 for place, (i, _) in enumerate(sorted(values, key=lambda v: (-v[1], v[0])))}
    assert {r["id"]: r["rank"] for r in got} == want
