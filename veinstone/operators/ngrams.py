"""Search by an index of trigrams: posting lists say which blobs can contain a text, and only those are read.

Blobs are indexed in blocks of at most ``BLOCK``, each by one task.  A block's posting list of a trigram is
an array of 16-bit places, or a bitmap where that is shorter.  The lists lie in folders by trigram, so a
search reads the folders of its own trigrams, intersects their lists block by block, and verifies the
text of what is left.  Texts are compared in lower case, as everywhere in this package; an index never says
no to a blob that contains the text.  Texts under three characters have no trigram and are searched for
in all blobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph

#: Blobs and, beyond one of them, characters of a block, folders of posting lists, and candidates that are looked up by their addresses.
BLOCK, BLOCK_CHARS, FOLDERS, LOOKED_UP = 4096, 8 << 20, 64, 1000


def folder_of(gram: str, folders: int = FOLDERS) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % folders


def grams_of(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def packed(places: list[int], size: int) -> bytes:
    """A posting list over a block of ``size``: 16-bit places, or a bitmap where that is shorter; the first byte tells."""
    if 2 * len(places) < -(-size // 8):
        return b"\0" + np.array(places, "<u2").tobytes()
    bits = np.zeros(size, bool)
    bits[places] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    """Whether each place of the block is in the list."""
    if data[0]:
        return np.unpackbits(np.frombuffer(data, "u1", offset=1), count=size).astype(bool)
    found = np.zeros(size, bool)
    found[np.frombuffer(data, "<u2", offset=1)] = True
    return found


def _lower(data: Column) -> Column:
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), F.lower(text))


def build(blobs: DataFrame, path: str, *, block: int = BLOCK, folders: int = FOLDERS) -> None:
    """Writes the index of blobs(cid, data) to the folder ``path``: ``lists`` by trigram, ``members`` by block.

    Blobs that aren't text, or have under three characters, are in no list.  A block is one task's, so a
    task that is run again makes all of its blocks anew, under new names.  An index of more blobs can be
    added to the same folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, list[int]] = {}
        cids: list[str] = []
        chars = 0

        def out() -> Iterator[pa.RecordBatch]:
            name, size = uuid.uuid4().hex, len(cids)
            yield pa.RecordBatch.from_pydict({"folder": pa.array([-1], pa.int32()), "gram": [""], "block": [name], "size": pa.array([size], pa.int32()), "data": [None], "cids": pa.array([cids], pa.list_(pa.string()))}, schema=arrow)
            grams = sorted(lists)
            for at in range(0, len(grams), 10_000):
                some = grams[at : at + 10_000]
                columns = {"folder": [folder_of(g, folders) for g in some], "gram": some, "block": [name] * len(some), "size": [size] * len(some), "data": [packed(lists[g], size) for g in some], "cids": [None] * len(some)}
                yield pa.RecordBatch.from_pydict(columns, schema=arrow)

        arrow = pa.schema([("folder", pa.int32()), ("gram", pa.string()), ("block", pa.string()), ("size", pa.int32()), ("data", pa.binary()), ("cids", pa.list_(pa.string()))])
        for batch in batches:
            for cid, text in zip(batch.column(0), batch.column(1), strict=True):
                said = text.as_py()
                for gram in grams_of(said):
                    lists.setdefault(gram, []).append(len(cids))
                cids.append(cid.as_py())
                chars += len(said)
                if len(cids) == block or chars >= BLOCK_CHARS:
                    yield from out()
                    lists, cids, chars = {}, [], 0
        if cids:
            yield from out()

    rows = blobs.select("cid", _lower(F.col("data")).alias("text")).where(F.length("text") >= 3)
    made = rows.mapInArrow(run, "folder int, gram string, block string, size int, data binary, cids array<string>")
    # lists of one trigram from all blocks come together, a large folder in several files
    made.repartition("folder", F.crc32(F.col("block").cast("binary")) % 8).sortWithinPartitions("folder", "gram").write.mode("append").partitionBy("folder").parquet(path)


def candidates(spark: SparkSession, path: str, query: str, *, folders: int = FOLDERS) -> DataFrame | None:
    """``cid`` of the blobs that have all trigrams of ``query``; None for a query that has none."""
    grams = sorted(grams_of(spark.range(1).select(F.lower(F.lit(query))).first()[0]))
    if not grams:
        return None
    index = spark.read.schema("gram string, block string, size int, data binary, cids array<string>, folder int").parquet(path)
    lists = index.where(F.col("folder").isin(sorted({folder_of(g, folders) for g in grams})) & F.col("gram").isin(grams))
    by_block = lists.groupBy("block").agg(F.first("size").alias("size"), F.collect_list("data").alias("lists")).where(F.size("lists") == len(grams))

    @F.arrow_udf("array<int>")
    def shared(size: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for n, some in zip(size.to_pylist(), lists, strict=True):
            left = np.ones(n, bool)
            for data in sorted(some.as_py(), key=len):
                left &= unpacked(data, n)
            out.append(np.flatnonzero(left).astype("i4"))
        return pa.array(out, pa.list_(pa.int32()))

    places = by_block.select("block", F.explode(shared("size", "lists")).alias("place"))
    members = index.where("folder = -1").select("block", "cids")
    return places.join(members, "block").select(F.element_at("cids", F.col("place") + 1).alias("cid"))


def narrowed(blobs: DataFrame, path: str, query: str, *, folders: int = FOLDERS) -> DataFrame:
    """The blobs that can contain ``query``: by address where they are few, so that files are skipped, else by a join."""
    found = candidates(blobs.sparkSession, path, query, folders=folders)
    if found is None:
        return blobs
    few = found.limit(LOOKED_UP + 1).collect()
    return blobs.where(F.col("cid").isin([r["cid"] for r in few])) if len(few) <= LOOKED_UP else blobs.join(found, "cid", "left_semi")


def search(blobs: DataFrame, path: str, query: str, limit: int | None = graph.SEARCH_LIMIT, snippet: int = 200, *, folders: int = FOLDERS) -> DataFrame:
    """What ``graph.search`` finds, by the index at ``path``; blobs that aren't indexed yet aren't found."""
    return graph.search(narrowed(blobs, path, query, folders=folders), query, limit, snippet)


def search_lines(blobs: DataFrame, path: str, query: str, limit: int | None = graph.SEARCH_LIMIT, *, folders: int = FOLDERS) -> DataFrame:
    """What ``graph.search_lines`` finds, by the index at ``path``."""
    return graph.search_lines(narrowed(blobs, path, query, folders=folders), query, limit)
