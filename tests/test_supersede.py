"""The stream of supersessions equals the batch fold, whatever the order of lines, also after a restart."""

import random

import pytest

from veinstone.sources import oplog
from veinstone.streaming import supersede

TS = "2026-01-01T00:00:00+00:00"


def log(seed, n=240):
    rng = random.Random(seed)
    lines = []
    for seq in rng.sample(range(3 * n), n):
        path = rng.choice("aaab")
        lines.append((seq, rng.choice([f"{TS} | put | {path} -> {seq}"] * 9 + ["broken", f"{TS} | gc | x"])))
    return lines


def fold(spark, lines):
    events = oplog.parse(spark.createDataFrame(lines, "seq long, line string"))
    return sorted((tuple(r) for r in oplog.supersessions(events).collect()), key=str)


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_lines_out_of_order_and_a_restart(spark, tmp_path, chunk):
    source, sink, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    lines = log(chunk)
    parts = [lines[0::3], lines[1::3], lines[2::3]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "seq long, line string").coalesce(1).write.mode("append").parquet(source)
        if i != 1:  # the second start finds one new file, the third run is another query with the same checkpoint
            supersede.run(spark, source, sink, checkpoint, files=1, chunk=chunk).awaitTermination()
            seen = [r for p in parts[: i + 1] for r in p]
            assert sorted((tuple(r) for r in supersede.current(spark, sink).collect()), key=str) == fold(spark, seen)
    versions = spark.read.parquet(sink)
    assert versions.groupBy("path", "seq", "version").count().where("count > 1").isEmpty()


def test_timers_drop_settled_puts_and_later_lines_know_what_they_replace(spark, tmp_path):
    source, sink, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    at = lambda day: f"2026-01-{day:02}T00:00:00+00:00"
    lines = [(seq, f"{at(1 + seq // 4)} | put | a -> {seq}") for seq in range(80)]
    batches = [lines[:8], lines[8:40], [*lines[44:60], (3, f"{at(1)} | put | a -> too late")], [*lines[40:44], *lines[60:]]]
    for batch in batches:
        spark.createDataFrame(batch, "seq long, line string").coalesce(1).write.mode("append").parquet(source)
        supersede.run(spark, source, sink, checkpoint, chunk=8, late="9 days").awaitTermination()
    assert sorted((tuple(r) for r in supersede.current(spark, sink).collect()), key=str) == fold(spark, lines)
