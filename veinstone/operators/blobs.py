"""Content-addressed blobs as a table: putting, reading, verifying, sizes and garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import cid


def blobs_of(rows: DataFrame, data: Column, method: str = "sha256") -> DataFrame:
    """``cid, data, size``: every distinct content once; null contents are no blobs."""
    b = data.cast("binary")
    return rows.select(cid(b, method).alias("cid"), b.alias("data")).where("data IS NOT NULL").groupBy("cid").agg(F.any_value("data").alias("data")).withColumn("size", F.octet_length("data").cast("long"))


def new_blobs(puts: DataFrame, blobs: DataFrame) -> DataFrame:
    """What of ``puts`` isn't stored yet; what is stored isn't verified again."""
    return puts.dropDuplicates(["cid"]).join(blobs.select("cid"), "cid", "left_anti")


def get(blobs: DataFrame, address: str) -> DataFrame:
    return blobs.where(F.col("cid") == address)


def exists(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """``wanted(cid)`` with a flag."""
    return wanted.join(blobs.select("cid", F.lit(True).alias("stored")), "cid", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def verify(blobs: DataFrame, method: str = "sha256") -> DataFrame:
    """``cid, valid``: whether the content still has its address; one projection over the scan."""
    return blobs.select("cid", F.coalesce(cid(F.col("data"), method) == F.col("cid"), F.lit(False)).alias("valid"))


def listing(blobs: DataFrame) -> DataFrame:
    return blobs.where(F.length("cid") == 64).select("cid").orderBy("cid")


def blob_sizes(blobs: DataFrame) -> DataFrame:
    return blobs.select("cid", F.octet_length("data").cast("long").alias("size"))


def total_size(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0).cast("long")).alias("total_size"))


def delete(blobs: DataFrame, gone: DataFrame) -> DataFrame:
    return blobs.join(gone.select("cid"), "cid", "left_anti")


def referenced(nodes: DataFrame) -> DataFrame:
    """``cid`` of every node, its output and its parents; schemas are not references."""
    refs = F.array_union(F.array("cid", "output_cid"), F.col("parents"))
    return nodes.select(F.explode(refs).alias("cid")).where("cid IS NOT NULL").distinct()


def orphans(blobs: DataFrame, nodes: DataFrame, keep_schemas: bool = False) -> DataFrame:
    """Blobs that nothing refers to."""
    refs = referenced(nodes)
    if keep_schemas:
        refs = refs.union(nodes.where("schema_cid IS NOT NULL").select("schema_cid"))
    return blobs.join(refs, "cid", "left_anti")


def gc_report(blobs: DataFrame, nodes: DataFrame) -> DataFrame:
    return orphans(blobs, nodes).agg(F.count(F.lit(1)).alias("orphans"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("orphan_bytes"))


def cas_stats(blobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: blobs, bytes, nodes, other blobs that are referred to, and orphans."""
    is_node = nodes.select("cid", F.lit(1).alias("is_node")).dropDuplicates(["cid"])
    is_ref = referenced(nodes).withColumn("is_ref", F.lit(1))
    all_ = blobs.select("cid", "size").join(is_node, "cid", "left").join(is_ref, "cid", "left")
    node, ref = F.col("is_node").isNotNull(), F.col("is_ref").isNotNull()
    return all_.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes"), F.count_if(node).alias("nodes"), F.count_if(~node & ref).alias("content"), F.count_if(~node & ~ref).alias("orphan"))
