"""Documents cleaned in five stages, each written as Parquet and read again by the next.

A stage decides on rows, known by their id and text: a null id is an id like any other, and a row is
never dropped for what another row with its id contains.  Extra columns pass through every stage but
the last, whatever their names; empty tables give empty results; whole texts are read.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import bpe, decontam, langid, linededup, simhash
from veinstone.llm.common import table
from veinstone.llm.queries import rank_file
from veinstone.store import remove, scratch, shared_dir

#: Documents whose best language has a smaller share of the positions are rejected.
MIN_LANGUAGE_SCORE = 0.35
#: What a worker of the last stage remembers: it stays beside what workers of other stages hold.
MAX_PIECES, MAX_STATES = 100_000, 40_000


def _same(docs: DataFrame, rows: DataFrame) -> Column:
    """Whether a row of ``docs`` is the one of ``rows(id, h)``."""
    return docs["doc_id"].eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"]) == rows["h"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null and empty ones among them, and those that no language fits.

    Every row is judged by its own text; repeated rows are judged alike and stay.
    """
    judged = langid.identify(docs, whole=True)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; ``n_chars`` follows the text.

    No row is dropped.  A null text stays null with a null ``n_chars``; rows that repeat an id keep a
    line where its first document has that id.
    """
    row = F.col("row")
    n_chars = lambda c: F.length(row.getField("text")).cast(docs.schema[c].dataType)
    return linededup.cleaned(docs).select(*[(n_chars(c) if c == "n_chars" else row.getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the least id, rows without an id last.

    Of rows that repeat both id and text one stays.  Null and blank texts are in no group and stay.
    """
    found = simhash.near_groups(docs)
    head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    kept = docs.join(gone := found.where(~head).select("id", "h"), _same(docs, gone), "left_anti").select(*docs.columns)
    again = found.where(head & (F.col("rows") > 1)).select("id", "h")
    if again.isEmpty():
        return kept
    once = kept.join(again, _same(kept, again), "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, _same(kept, again), "left_anti").select(*docs.columns).union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of a benchmark item.

    Null and blank texts contain none; repeated rows go or stay together.
    """
    gone = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(gone, _same(docs, gone), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of the ids and of what they decode to; a null text is an empty one.

    One row for every row of ``docs``.
    """
    return bpe.encode_decode(docs, rank_file(), public_tokenizers.PATTERN, with_ids=True, max_pieces=MAX_PIECES, max_states=MAX_STATES)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode)]

#: The network and the similarity search can't be expressed in SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what stages made on the way is deleted as soon as the next table is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if before:
            remove(spark, before)
        before = f"{base}/{i}"
    return docs
