"""The log as a stream of supersessions: each put and the address that it replaced, kept right as lines arrive in any order.

State is held by path, in chunks of ``seq`` as in the batch fold: a map from a chunk to its puts, and one
value with the ends of all chunks.  A batch reads only the chunks that its lines fall into, and emits
what is new or has another predecessor now, the first put of the next chunk included, under a version that
rises by path.  Lines may be late by ``late`` in their own time; later ones are left out, as are those
whose time can't be read.  When the watermark has passed the last line of a chunk a timer drops its puts:
a log's times don't fall, so what still comes stands behind them, and the ends say what it replaces.

The sink is a table of versions, and ``current`` the newest of each put.  Both are exactly once: a query
that starts again from its checkpoint goes on where it was.  A path's state and lines of one batch are
in one task; batches are bounded by the files of a trigger.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources import oplog

LATE = "1 day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "path string, seq long, cid string, superseded string, version long"


class Supersede(StatefulProcessor):
    """Puts of one path, in chunks of ``chunk`` numbers."""

    def __init__(self, chunk: int):
        self.chunk = chunk

    def init(self, handle) -> None:
        self.handle = handle
        self.puts = handle.getMapState("puts", "chunk long", "seqs array<long>, cids array<string>")
        self.ends = handle.getValueState("ends", "version long, chunks array<long>, firsts array<long>, first_cids array<string>, last_cids array<string>, latest array<long>")

    def _load(self) -> tuple[int, dict[int, tuple]]:
        """The version, and of each chunk its first put, the last address and the latest time."""
        if not self.ends.exists():
            return 0, {}
        version, chunks, *columns = self.ends.get()
        return version, dict(zip(chunks, zip(*columns, strict=True), strict=True))

    def _save(self, version: int, ends: dict[int, tuple]) -> None:
        chunks = sorted(ends)
        self.ends.update((version, chunks, *([ends[c][i] for c in chunks] for i in range(4))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived: dict[int, dict[int, str]] = {}
        times: dict[int, int] = {}
        for batch in rows:
            for seq, cid, ms in zip(batch["seq"].tolist(), batch["cid"].tolist(), batch["ms"].tolist(), strict=True):
                chunk = seq // self.chunk
                arrived.setdefault(chunk, {})[seq] = cid
                times[chunk] = max(times.get(chunk, ms), ms)
        version, ends = self._load()
        names, changed = sorted(ends), {}
        for chunk in sorted(arrived):
            held = self.puts.containsKey((chunk,))
            known = dict(zip(*self.puts.getValue((chunk,)), strict=True)) if held else {}
            settled = chunk in ends and not held
            place = bisect_left(names, chunk)
            entering = ends[chunk][2] if settled else ends[names[place - 1]][2] if place else None
            merged = known | arrived[chunk]
            order = sorted(merged)
            was = dict(zip(sorted(known), [entering, *(known[s] for s in sorted(known))], strict=False))
            now = dict(zip(order, [entering, *(merged[s] for s in order)], strict=False))
            fresh = [s for s in order if s == order[0] or s not in known or known[s] != merged[s] or was[s] != now[s]]
            changed |= {s: (merged[s], now[s]) for s in fresh}
            self.puts.updateValue((chunk,), (order, [merged[s] for s in order]))
            if chunk not in ends:
                insort(names, chunk)
            first = ends[chunk][:2] if settled else (order[0], merged[order[0]])
            latest = max(times[chunk], ends[chunk][3]) if chunk in ends else times[chunk]
            ends[chunk] = (*first, merged[order[-1]], latest)
            self.handle.registerTimer(latest)
            after = names[place + 1] if place + 1 < len(names) else None
            if after is not None and after not in arrived:  # its first put replaces what is last here now
                changed[ends[after][0]] = (ends[after][1], merged[order[-1]])
        self._save(version + 1, ends)
        seqs = sorted(changed)
        yield pd.DataFrame({"path": [key[0]] * len(seqs), "seq": seqs, "cid": [changed[s][0] for s in seqs], "superseded": pd.Series([changed[s][1] for s in seqs], dtype=object), "version": version + 1})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Drops the puts of chunks that no line can fall in front of any more."""
        at = expiredTimerInfo.getExpiryTimeInMs()
        for chunk, (*_, latest) in self._load()[1].items():
            if latest <= at and self.puts.containsKey((chunk,)):
                self.puts.removeKey((chunk,))
        return iter(())


def supersession_stream(lines: DataFrame, *, chunk: int | None = None, late: str = LATE) -> DataFrame:
    """``path, seq, cid, superseded, version`` from a stream of lines(seq, line)."""
    events = oplog.parse(lines).withColumn("at", F.try_to_timestamp("ts")).where("at IS NOT NULL")
    both = F.split("detail", " -> ", 2)
    put = events.where("event = 'put'").select(F.get(both, F.lit(0)).alias("path"), F.get(both, F.lit(1)).alias("cid"), "seq", "at", F.unix_millis("at").alias("ms"))
    return put.withWatermark("at", late).groupBy("path").transformWithStateInPandas(Supersede(chunk or oplog.CHUNK), OUTPUT, "Append", "EventTime")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, *, files: int | None = None, chunk: int | None = None, late: str = LATE) -> StreamingQuery:
    """Reads what is new in the folder ``source`` (Parquet, seq and line) into the table ``sink``; ``files`` bounds a batch."""
    reader = spark.readStream.schema("seq long, line string")
    lines = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)  # several states by key need it; a query keeps the setting that it starts with
    try:
        out = supersession_stream(lines, chunk=chunk, late=late).writeStream.format("parquet").outputMode("append")
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    finally:
        spark.conf.set(name, before)


def current(spark: SparkSession, sink: str) -> DataFrame:
    """``path, seq, cid, superseded``: the newest version of every put."""
    newest = F.max(F.struct("version", "cid", "superseded")).alias("x")
    return spark.read.schema(OUTPUT).parquet(sink).groupBy("path", "seq").agg(newest).select("path", "seq", "x.cid", "x.superseded")
