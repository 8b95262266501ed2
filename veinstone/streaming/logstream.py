"""The log as a stream: heads by path are kept up to date as lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import shared_dir


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``ts, event, detail`` from the log files of a folder."""
    part = F.split("value", r" \| ", 3)
    return spark.readStream.text(folder).where(F.size(part) == 3).select(*[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("ts", "event", "detail"))])


def head_stream(events: DataFrame) -> DataFrame:
    """``path, cid, ts`` of the last put by time, then address; state is one row for each path."""
    both = F.split("detail", " -> ", 2)
    put = events.where("event = 'put'").select(F.get(both, F.lit(0)).alias("path"), F.get(both, F.lit(1)).alias("cid"), "ts")
    return put.groupBy("path").agg(F.max(F.struct("ts", "cid")).alias("last")).select("path", "last.cid", "last.ts")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by kind in tumbling windows; windows close after ``late``."""
    timed = events.select(F.to_timestamp("ts").alias("at"), "event").withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def start(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Into a memory table; what was read is kept in the checkpoint, in the shared folder by default."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint or f"{shared_dir(df.sparkSession)}/stream-{name}").trigger(availableNow=True).start()
