"""Tables compared by digests: the same differences as by joining all, from few rows."""

import random

import pytest
from pyspark.sql import functions as F

from veinstone.operators import digests, projection

SCHEMA = "parent_cid string, child_cid string, ordinal int, edge_kind string"


def edges(n=3000):
    return [(f"p{i % 97}", f"c{i}", i % 4, ["derives", "grounds"][i % 2]) for i in range(n)]


def both(spark, one, other, levels):
    frames = [spark.createDataFrame(x, SCHEMA) for x in (one, other)]
    want = sorted(map(tuple, projection.diff_edges(*frames).collect()), key=str)
    got = sorted(map(tuple, digests.diff_edges(*frames, levels).collect()), key=str)
    return got, want


@pytest.mark.parametrize("levels", [(16,), (2, 5), digests.LEVELS])
def test_diff_by_digests_equals_diff_by_join(spark, levels):
    rng = random.Random(7)
    one = edges()
    other = [r for r in one if rng.random() > 0.01] + [("x", f"c{i}", 0, "derives") for i in range(5)]
    other = [(p, c, o + (rng.random() < 0.01), k if rng.random() > 0.01 else "proposes") for p, c, o, k in other]
    other += [(None, "c1", 0, "derives"), ("n", "c", None, "grounds")]
    rng.shuffle(other)
    got, want = both(spark, one, other, levels)
    assert got == want and len(want) > 60


def test_equal_and_empty_tables(spark):
    one = edges(300)
    assert both(spark, one, one[::-1], (3, 9)) == ([], [])
    got, want = both(spark, one, [], (3, 9))
    assert got == want and len(got) == 300
    assert both(spark, [], [], (4,)) == ([], [])


def test_repeated_and_swapped_rows_change_a_digest(spark):
    tables = [[("p", "c", 0, "a")] * 2, [("p", "c", 0, "b")] * 2, [("p", "c", 0, "a")], [("p", "c", 0, None)], [("p", "c", None, "a")]]
    found = [tuple(digests.tree(spark.createDataFrame(t, SCHEMA), projection.EDGE_KEY, (4,)).first())[2:] for t in tables]
    assert len(set(found)) == len(tables)


def test_rows_that_are_joined_follow_the_differences(spark):
    one = spark.createDataFrame(edges(20_000), SCHEMA)
    other = one.where("child_cid NOT IN ('c17', 'c4711')").withColumn("edge_kind", F.when(F.col("child_cid") == "c9", "proposes").otherwise(F.col("edge_kind")))
    sides = digests.narrowed(one, other, projection.EDGE_KEY, (4, 8, 12))
    assert all(s.count() <= 60 for s in sides)  # three ranges of 4,096, with about five rows each
    with pytest.raises(ValueError, match="bits"):
        digests.tree(one, projection.EDGE_KEY, (8, 24))
