"""Mergeable Bloom filters, as tables of words, and garbage that is found with them.

A filter is a table (word, bits): the words of one bit array, of which an aggregation takes the union.  So
a filter is built by one partial aggregation, has at most ``bits / 64`` rows whatever is in it, and two of them
are merged by the same aggregation: every batch of nodes that is logged can leave its filter beside it.
A test is two lookups in one broadcast row, of a size that the number of bits fixes.

A blob whose address isn't in the filter of all references is referred to by nothing, for certain, and never
joined.  Only what may be referred to is looked up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs as B

#: Bits of a filter, at most ``MOST_BITS``: a megabyte and sixteen; a key sets ``HASHES`` of them.
BITS, MOST_BITS, HASHES = 1 << 23, 1 << 27, 7


def places(key: Column, bits: int = BITS) -> list[Column]:
    """The bits of a key: multiples of one hash added to another."""
    one, other = F.xxhash64(F.lit("a"), key), F.xxhash64(F.lit("b"), key)
    step = F.pmod(other, F.lit(bits)).bitwiseOR(F.lit(1).cast("long"))
    return [F.pmod(F.pmod(one, F.lit(bits)) + step * i, F.lit(bits)) for i in range(HASHES)]


def build(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``word, bits``: the filter of a column; nulls are not in it, an empty table has no word."""
    if bits % 64 or not 64 <= bits <= MOST_BITS:
        raise ValueError(f"a filter has a multiple of 64 bits, at most {MOST_BITS}")
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*places(F.col(key), bits))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    return at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(filters: list[DataFrame]) -> DataFrame:
    """The filter of everything that is in one of ``filters``, which have the same number of bits."""
    both = filters[0]
    for f in filters[1:]:
        both = both.unionByName(f)
    return both.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def marked(rows: DataFrame, key: str, words: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``rows`` with the flag ``name``: false where the key is not in the filter for certain, or null."""
    # a dense array of all words, built from rows of which there are at most as many
    all_ = rows.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    dense = all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("__filter"))
    # one expression for each bit, not a lambda over them: that would copy the filter for every row
    tested = F.col(key).isNotNull()
    for at in places(F.col(key), bits):
        tested = tested & (F.getbit(F.get("__filter", F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return rows.crossJoin(F.broadcast(dense)).withColumn(name, F.coalesce(tested, F.lit(False))).drop("__filter")


def orphans(blobs: DataFrame, nodes: DataFrame, words: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """The blobs that nothing refers to, as ``blobs.orphans`` finds them.

    ``words`` is the filter of all references, merged from those of earlier batches; it may hold more (a node
    that went), but has to hold every reference.  Without one it is built here.
    """
    refs = B.referenced(nodes)
    tested = marked(blobs, "cid", build(refs, "cid", bits) if words is None else words, "__maybe", bits)
    certain = tested.where(~F.col("__maybe")).drop("__maybe")
    return certain.unionByName(tested.where("__maybe").drop("__maybe").join(refs, "cid", "left_anti").select(*blobs.columns))
