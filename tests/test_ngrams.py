"""Search by trigrams finds what a scan finds, in every script, and reads few blobs."""

import hashlib
import random

import numpy as np
import pytest

from veinstone.operators import graph, ngrams


def contents():
    rng = random.Random(31)
    words = ["alpha", "beta", "Gamma", "ΣΊΣΥΦΟΣ", "straße", "İstanbul", "日本語テスト", "नमस्ते", "\U0001f600\U0001f601\U0001f602", "ab", "x"]
    texts = [("\n" if i % 7 == 0 else " ").join(rng.choice(words) for _ in range(rng.randint(1, 8))) for i in range(300)]
    return [t.encode() for t in dict.fromkeys(texts)] + [b"\xff\xfe alpha", b"", b"ab", b"abc", ("rare " + "filler " * 5000).encode()]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(hashlib.sha256(c).hexdigest(), bytearray(c)) for c in contents()]
    blobs, path = spark.createDataFrame(rows, "cid string, data binary"), f"file://{tmp_path_factory.mktemp('index')}/i"
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        ngrams.build(spark.createDataFrame(part, "cid string, data binary"), path, block=40, folders=8)
    return blobs, path


@pytest.mark.parametrize("query", ["ALPHA", "a b", "gamma\nbeta", "σίσυφοσ", "ΣΊΣΥΦΟΣ", "Straße", "i̇stanbul", "本語テ", "नमस्", "\U0001f600\U0001f601", "\U0001f601\U0001f602 x", "ab", "", "absent", "rare filler"])
def test_search_by_index_equals_a_scan(indexed, query):
    blobs, path = indexed
    assert ngrams.search(blobs, path, query, None, folders=8).collect() == graph.search(blobs, query, None).collect()


@pytest.mark.parametrize("query", ["Alpha Beta", "日本語"])
def test_lines_by_index_equal_a_scan(indexed, monkeypatch, query):
    blobs, path = indexed
    want = sorted(map(tuple, graph.search_lines(blobs, query, None).collect()))
    for most in (ngrams.LOOKED_UP, 0):
        monkeypatch.setattr(ngrams, "LOOKED_UP", most)
        assert sorted(map(tuple, ngrams.search_lines(blobs, path, query, None, folders=8).collect())) == want and want


def test_blobs_that_are_read_follow_the_hits(indexed):
    blobs, path = indexed
    assert ngrams.narrowed(blobs, path, "rare filler", folders=8).count() == 1
    assert ngrams.narrowed(blobs, path, "no such text", folders=8).count() == 0
    assert ngrams.narrowed(blobs, path, "ab", folders=8).count() == blobs.count()


def test_posting_lists_are_arrays_or_bitmaps():
    rng = random.Random(2)
    for size in (1, 7, 40, 4096):
        for n in {0, 1, size // 20, size // 2, size}:
            places = sorted(rng.sample(range(size), n))
            data = ngrams.packed(places, size)
            assert np.flatnonzero(ngrams.unpacked(data, size)).tolist() == places
            assert len(data) <= 2 + size // 8
