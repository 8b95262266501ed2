"""Bloom filters as tables: nothing is missed, merging equals building, and garbage is what an exact join finds."""

import pytest
from pyspark.sql import functions as F

from veinstone.operators import blobs, bloom

BITS = 1 << 14


def keys(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("cid"))


def test_no_key_is_missed_and_few_others_pass(spark):
    words = bloom.build(keys(spark, 0, 1000).union(spark.createDataFrame([(None,)], "cid string")), "cid", BITS)
    found = bloom.marked(keys(spark, 0, 20_000), "cid", words, "maybe", BITS)
    assert found.where("cast(substr(cid, 2) AS int) < 1000 AND NOT maybe").isEmpty()
    assert found.where("cast(substr(cid, 2) AS int) >= 1000 AND maybe").count() < 0.02 * 19_000
    assert not bloom.marked(spark.createDataFrame([(None,)], "cid string"), "cid", words, "maybe", BITS).first()["maybe"]
    assert words.count() <= BITS // 64 and found.columns == ["cid", "maybe"]


def test_merged_filters_equal_the_filter_of_all(spark):
    whole = sorted(map(tuple, bloom.build(keys(spark, 0, 900), "cid", BITS).collect()))
    parts = [bloom.build(keys(spark, a, b), "cid", BITS) for a, b in ((0, 300), (200, 650), (650, 900), (5, 5))]
    assert sorted(map(tuple, bloom.merged(parts).collect())) == whole
    with pytest.raises(ValueError, match="bits"):
        bloom.build(keys(spark, 0, 1), "cid", 100)


@pytest.mark.parametrize("bits", [64, BITS])
def test_orphans_by_filter_equal_an_exact_join(spark, bits):
    nodes = spark.createDataFrame([(f"n{i}", f"o{i}", [f"n{i - 1}"] if i else []) for i in range(200)], "cid string, output_cid string, parents array<string>")
    stored = nodes.select("cid").union(nodes.select("output_cid").where("output_cid <> 'o7'")).union(keys(spark, 0, 300)).withColumn("size", F.lit(1).cast("long"))
    want = sorted(r["cid"] for r in blobs.orphans(stored, nodes).collect())
    assert sorted(r["cid"] for r in bloom.orphans(stored, nodes, bits=bits).collect()) == want and len(want) == 300
    more = bloom.merged([bloom.build(blobs.referenced(nodes), "cid", bits), bloom.build(keys(spark, 0, 50), "cid", bits)])
    assert sorted(r["cid"] for r in bloom.orphans(stored, nodes, more, bits).collect()) == want


def test_share_of_blobs_that_skip_the_join(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"o{i}", []) for i in range(500)], "cid string, output_cid string, parents array<string>")
    words = bloom.build(blobs.referenced(nodes), "cid", BITS)
    assert bloom.marked(keys(spark, 0, 5000), "cid", words, "maybe", BITS).where("NOT maybe").count() > 0.98 * 5000
