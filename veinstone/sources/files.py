"""Addresses of files that tasks read in ranges, so that no content has to fit into a row or a task's memory.

With ``blake3`` a file is cut into pieces, a row each, which any task may hash; the values of ``FAN``
neighbours are joined by an aggregation, round by round, until each file has one.  That is the tree of
the digest's specification, as pieces and groups are powers of two.  ``sha256`` goes through a file from front
to end, so one task streams each file.

Paths are those of a file system that tasks can open (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import blake3_joined, blake3_values

#: Bytes of a piece (a power of two of 1024), values that are joined at a time (a power of two), bytes that are read at a time.
PIECE, FAN, READ = 1 << 20, 256, 1 << 22
#: Pieces that a task hashes at once.
TOGETHER = 16


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path, with or without a scheme; names are as they are, not percent-encoded."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.LocalFileSystem(), path
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@?=&')}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all files below a folder but empty ones, which Spark's readers leave out; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def sized(files: DataFrame) -> DataFrame:
    """``path, length`` of those of files(path) that are there and are files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                fs, place = _open(path)
                info = fs.get_file_info(place)
                found.append((path, info.size if info.type == pa.fs.FileType.File else None))
            there = [f for f in found if f[1] is not None]
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in there], pa.string()), "length": pa.array([n for _, n in there], pa.int64())})

    return files.select("path").where("path IS NOT NULL").distinct().mapInArrow(run, "path string, length long")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, found = batch.column(0).to_pylist(), []
        for path in paths:
            digest = hashlib.sha256()
            fs, place = _open(path)
            with fs.open_input_file(place) as f:
                while part := f.read(READ):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "cid": pa.array(found, pa.string())})


def _pieces(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TOGETHER) for b in batches for lo in range(0, b.num_rows, TOGETHER)):
            data, first, root = [], [], []
            for path, length, index, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, place = _open(path)
                size = min(piece, length - index * piece)
                with fs.open_input_file(place) as f:
                    f.seek(index * piece)
                    data.append(f.read(size))
                if len(data[-1]) != size:
                    raise OSError(f"{path} changed while it was read")
                first.append(index * piece // 1024)
                root.append(n == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(blake3_values(data, first, root), pa.binary())], ["path", "index", "n", "value"])

    return run


def addresses(files: DataFrame, method: str = "sha256", *, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """``path, cid`` of files(path, length); an empty file has the address of no bytes, and one that is gone fails."""
    if method == "sha256":
        return files.select("path").mapInArrow(_streamed, "path string, cid string")
    if method != "blake3":
        raise ValueError(f"unknown address method {method!r}")
    if piece % 1024 or (piece // 1024).bit_count() != 1 or fan < 2 or fan.bit_count() != 1:
        raise ValueError("a piece has a power of two of 1024 bytes, and a power of two of values is joined")

    @F.arrow_udf("binary")
    def joined(values: pa.Array, whole: pa.Array) -> pa.Array:
        return pa.array(blake3_joined(values.to_pylist(), whole.to_pylist()), pa.binary())

    n = F.greatest(F.ceil(F.col("length") / piece), F.lit(1)).cast("long")
    rows = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("index"), n.alias("n"))
    values = rows.repartition("path", "index").mapInArrow(_pieces(piece), "path string, index long, n long, value binary")
    left = files.agg(F.max(n)).first()[0] or 0
    while left > 1:
        group = values.groupBy("path", F.floor(F.col("index") / fan).alias("index"), "n").agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("values"))
        value = F.when(F.col("n") == 1, F.col("values")[0]["value"]).otherwise(joined(F.col("values.value"), (F.col("n") > 1) & (F.col("n") <= fan)))
        values = group.select("path", "index", F.ceil(F.col("n") / fan).cast("long").alias("n"), value.alias("value"))
        left = -(-left // fan)
    return values.select("path", F.lower(F.hex("value")).alias("cid"))
