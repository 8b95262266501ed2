"""Drift of tracked files and verification of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import cid


def current_files(spark: SparkSession, path: str, method: str = "sha256") -> DataFrame:
    """``path, current_cid`` of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), cid(F.col("content"), method).alias("current_cid"))


def drift(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """``path, cid, current_cid, status``: OK, DRIFTED or MISSING."""
    status = F.when(F.col("current_cid").isNull(), "MISSING").when(F.col("current_cid") == F.col("cid"), "OK").otherwise("DRIFTED")
    return tracked.join(current, "path", "left").select("path", "cid", "current_cid", status.alias("status"))


def snapshot(nodes: DataFrame, name: str, created_at: str) -> DataFrame:
    return nodes.select(F.lit(name).alias("name"), F.lit(created_at).alias("created_at"), F.col("cid").alias("node_cid"), "output_cid")


def verify_snapshot(snap: DataFrame, blobs: DataFrame, method: str = "sha256") -> DataFrame:
    """``name, present, missing, corrupted, ok`` over node and output addresses."""
    each = snap.select("name", F.explode(F.array("node_cid", "output_cid")).alias("cid"))
    state = blobs.select("cid", (cid(F.col("data"), method) == F.col("cid")).alias("valid"))
    found = each.join(state, "cid", "left")
    return found.groupBy("name").agg(F.count_if("valid").alias("present"), F.count_if(F.col("valid").isNull()).alias("missing"), F.count_if(~F.col("valid")).alias("corrupted")).withColumn("ok", (F.col("missing") == 0) & (F.col("corrupted") == 0))


def snapshots(table: DataFrame) -> DataFrame:
    return table.groupBy("name", "created_at").agg(F.count(F.lit(1)).alias("n_nodes")).orderBy("name")
