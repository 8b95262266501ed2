"""The append-only log: lines of ``time | event | detail``."""

from __future__ import annotations

import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The events that this package writes.
EVENTS = ["init", "put", "dag:create", "run", "repair", "gc", "export", "import", "merge", "snapshot:create"]


def append(path: str, event: str, detail: str, at: str | None = None) -> None:
    """One line in one write; a line that was left without its end is closed first."""
    line = f"{at or datetime.now(UTC).strftime('%Y-%m-%dT%H:%M:%SZ')} | {event} | {detail}\n"
    with open(path, "ab+") as f:
        if f.tell():
            f.seek(-1, os.SEEK_END)
            if f.read(1) != b"\n":
                line = "\n" + line
        f.write(line.encode())
        f.flush()
        os.fsync(f.fileno())


def parse(lines: DataFrame) -> DataFrame:
    """``seq, ts, event, detail`` of lines(seq, line); null fields where a line is malformed."""
    part = F.split("line", r" \| ", 3)
    return lines.select("seq", *[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("ts", "event", "detail"))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``seq, line`` of a log, which may be read in splits; blank lines are left out.

    ``seq`` ascends with the place in the file: it is the byte at which a line's split starts, and the
    number of lines of the split before it, which is less than the split's bytes.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("start"))
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return lines.select((F.col("start") + row).alias("seq"), F.col("value").alias("line")).where(F.trim("line") != "")


def tail(lines: DataFrame, n: int) -> DataFrame:
    """Of the last n lines those that are well-formed; there may be fewer than n."""
    return parse(lines.orderBy(F.desc("seq")).limit(n)).where("detail IS NOT NULL").orderBy("seq")


def puts(events: DataFrame) -> DataFrame:
    """``path, cid, seq`` of the put events."""
    both = F.split("detail", " -> ", 2)
    return events.where("event = 'put'").select(F.get(both, F.lit(0)).alias("path"), F.get(both, F.lit(1)).alias("cid"), "seq")


def heads(events: DataFrame) -> DataFrame:
    """``path, cid``: the last put of every path."""
    return puts(events).groupBy("path").agg(F.max_by("cid", "seq").alias("cid"))


#: Width in ``seq`` of what is put in order by one task.
CHUNK = 1 << 20


def supersessions(events: DataFrame) -> DataFrame:
    """``path, seq, cid, superseded``: every put and the address that it replaced.

    A path's puts are put in order chunk by chunk, so no path has to fit into a task; what the first
    put of a chunk replaced comes from the last ones of the chunks, one row each.
    """
    each = puts(events).withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    inside = W.partitionBy("path", "chunk").orderBy("seq")
    each = each.withColumns({"before": F.lag("cid").over(inside), "n": F.row_number().over(inside)})
    ends = each.groupBy("path", "chunk").agg(F.max_by("cid", "seq").alias("last"))
    ends = ends.withColumn("entering", F.lag("last").over(W.partitionBy("path").orderBy("chunk"))).drop("last")
    return each.join(ends, ["path", "chunk"]).select("path", "seq", "cid", F.when(F.col("n") == 1, F.col("entering")).otherwise(F.col("before")).alias("superseded"))
