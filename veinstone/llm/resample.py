"""Importance resampling towards a target: hashed features of all texts, weights by distinct text, Gumbel noise by document.

Identical texts are collapsed first, by grouping the full text with a count that is combined before
the shuffle, so a text that a third of the rows share is one row from there on.  Features are computed
once for each distinct text and written in sparse form; their counts times the copies add up to the
counts of the whole corpus.  Each bucket has a gain, the log of its share in the target over that in
the corpus, and a text's weight is the sum of its gains.  Weights are joined back to the documents by
the digest of the whole text (Spark splits the hot ones), and only then noise is drawn from the id.

Documents are ranked without one task that sees all: a range partitioning by score, the places within
each partition, and the sizes of the partitions in front (one row for each of them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Buckets of the hashed features; their gains are what tasks hold in memory.
BUCKETS = 10_000
LONGEST = 1
SEED = 2024
MIN_WORDS, PERCENT = 20, 10
#: Texts whose features are computed at a time.
SLICE = 500
#: Lower case for A-Z, a blank for all other ASCII than letters and digits; words are what stands between blanks.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def features_of(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of one to ``longest`` words, joined by one space, repeats included."""
    hashes = list(map(crc32, words))
    found = [np.array(hashes, "u4")]
    for size in range(2, longest + 1):  # a run's checksum goes on from the one that is a word shorter
        hashes = [crc32(b" " + word, h) for word, h in zip(words[size - 1 :], hashes, strict=False)]
        found.append(np.array(hashes, "u4"))
    return (np.concatenate(found) % buckets).astype("i4")


def text_key(text: Column) -> Column:
    """The digest of a whole text; null is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``text, copies``: every distinct text once; null is the empty one."""
    return docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``key, copies, n_words, n_features, buckets, counts`` of texts(text, copies): the buckets that a text has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            sizes, totals, found, counts, ends = [], [], [], [], [0]
            for text in batch.column(2):
                words = words_of(text.as_py())
                own = features_of(words, longest, buckets)
                which, often = np.unique(own, return_counts=True)
                sizes.append(len(words))
                totals.append(len(own))
                found.append(which)
                counts.append(often.astype("i4"))
                ends.append(ends[-1] + len(which))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), *lists], ["key", "copies", "n_words", "n_features", "buckets", "counts"])

    rows = texts.select(text_key(F.col("text")).alias("key"), "copies", "text")
    return rows.mapInArrow(run, "key binary, copies long, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_counts(found: DataFrame) -> DataFrame:
    """``bucket, n`` over all texts with their copies."""
    each = found.select("copies", F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum(F.col("copies") * F.col("x.counts")).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths, from ``bucket, n`` of both; ``buckets`` rows come to the driver."""
    pair = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    both = pair.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    all_ = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").na.fill(0, ["s", "t"])
    counts = {row["bucket"]: (row["s"], row["t"]) for row in all_.collect()}
    total_s, total_t = (float(sum(c[side] for c in counts.values())) for side in (0, 1))
    shares = ((t + 1.0) * (total_s + buckets) / ((s + 1.0) * (total_t + buckets)) for s, t in (counts[b] for b in range(buckets)))
    return np.array([math.floor(1000 * math.log(x)) for x in shares], "i8")


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``key, n_words, n_features, weight`` of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, often = (batch.column(i) for i in (3, 4))
            each = np.concatenate([[0], np.cumsum(gain[which.flatten().to_numpy()] * often.flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(which.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(each[ends[1:]] - each[ends[:-1]], pa.int64())], ["key", "n_words", "n_features", "weight"])

    return found.select("key", "n_words", "n_features", "buckets", "counts").mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths from the digest of an id; a null id is drawn for like an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """``scored`` with ``rank`` from 1 on in ``order``."""
    rows = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + within + 1).drop("__part", "__before", "__place")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """For every row of ``docs``: ``id_col, n_features, weight, score, rank`` and ``key``, the digest of its text.

    Of the rows with ``min_words`` words or more the best ``percent`` in a hundred by score are drawn, which
    gives them a rank from 1 on; all others have none.  Equal scores go by id, null ids first, then by
    the digest; repeated rows are drawn one by one.  Null and empty texts have no features and the
    weight 0.  Very long texts are read whole, each within one task; an empty target leaves its counts
    at 0, an empty table gives an empty one.  No other column is read.
    """
    found = written(features(collapsed(docs, text_col), longest, buckets), "features")
    aim = bucket_counts(features(collapsed(target, target_col), longest, buckets))
    by_text = weights(found, gains(bucket_counts(found), aim, buckets))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).join(by_text, "key", "left")
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("key")]
    long_enough = F.col("n_words") >= min_words
    drawn = percent * scored.where(long_enough).count() // 100
    best = ranked(scored.where(long_enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "key")


def sample(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``resample`` has drawn, with all their columns; rows that repeat id and text go together."""
    taken = found.where("rank IS NOT NULL").select(F.col(id_col).alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(taken, docs[id_col].eqNullSafe(taken["__id"]) & (text_key(docs[text_col]) == taken["__key"]), "left_semi")
