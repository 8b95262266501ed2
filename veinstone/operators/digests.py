"""Tables compared by a tree of digests: only the key ranges that differ are joined.

The hash of a row's key falls into one of ``2 ** bits`` ranges.  A range's digest is a count, two sums and an
exclusive or over hashes of whole rows, so it doesn't depend on their order, counts repeated rows, and the
digest of a wider range is that of its parts together.  Trees are small tables that can be kept beside the
data; two are compared from the widest ranges down, each level only below what differs above.  Rows
of other ranges are read, but neither shuffled nor joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import scratch, written
from . import projection

#: Bits of the key hash that name a range, by level; the last is at most ``MOST_BITS``, which bounds what is broadcast.
LEVELS, MOST_BITS = (4, 8, 12, 16), 20


def ranged(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``rows`` with ``__range``, the first ``bits`` bits of the hash of their key."""
    return rows.withColumn("__range", F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).cast("int"))


def _together() -> list:
    return [F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.bit_xor("odd").alias("odd")]


def tree(rows: DataFrame, keys: list[str], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``bits, range, n, high, low, odd``: the digests of all ranges that have rows; a null is a value like any other."""
    if not levels or list(levels) != sorted(set(levels)) or levels[-1] > MOST_BITS:
        raise ValueError(f"levels rise up to {MOST_BITS} bits")
    columns = sorted(rows.columns)
    marked = [F.col(c).isNull() for c in columns]  # a hash leaves nulls out, so ('a', null) would be (null, 'a')
    one, other = F.xxhash64(F.lit(1), *columns, *marked), F.xxhash64(F.lit(2), *marked, *columns)
    sums = [F.lit(1).cast("long").alias("n"), F.shiftrightunsigned(one, 40).alias("high"), F.shiftrightunsigned(one, 16).bitwiseAND(0xFFFFFF).alias("low"), other.alias("odd")]
    leaves = ranged(rows, keys, levels[-1]).select("__range", *sums).groupBy(F.col("__range").alias("range")).agg(*_together())
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("range", levels[-1] - b).alias("range")) for b in levels]))
    return leaves.select(each.alias("at"), "n", "high", "low", "odd").groupBy(F.col("at.bits").alias("bits"), F.col("at.range").alias("range")).agg(*_together())


def differing(one: DataFrame, other: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``range``: the narrowest ranges whose digests differ between two trees."""
    found, above = None, 0
    for bits in levels:
        sides = [t.where(F.col("bits") == bits).select("range", F.struct("n", "high", "low", "odd").alias(name)) for t, name in ((one, "a"), (other, "b"))]
        if found is not None:
            wider = found.select(F.col("range").alias("wider"))
            sides = [s.join(F.broadcast(wider), F.shiftright("range", bits - above) == F.col("wider"), "left_semi") for s in sides]
        found, above = sides[0].join(sides[1], "range", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("range"), bits
    return found


def narrowed(one: DataFrame, other: DataFrame, keys: list[str], levels: tuple[int, ...] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in ranges that differ."""
    with scratch(one.sparkSession):
        trees = [written(tree(t, keys, levels), "digests") for t in (one, other)]
        ranges = written(differing(*trees, levels), "ranges", keep=True)
    return tuple(ranged(t, keys, levels[-1]).join(F.broadcast(ranges.withColumnRenamed("range", "__range")), "__range", "left_semi").drop("__range") for t in (one, other))


def diff_edges(expected: DataFrame, actual: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """What ``projection.diff_edges`` says, from the ranges that differ alone."""
    columns = [*projection.EDGE_KEY, "ordinal", "edge_kind"]
    return projection.diff_edges(*narrowed(expected.select(*columns), actual.select(*columns), projection.EDGE_KEY, levels))
