"""Benchmark decontamination: a prefix-filtered set join in built-in expressions only.

A window is ten consecutive words of a benchmark item (all words of a shorter one).  A document
contains a window exactly when it contains all words of the window in order, so by the prefix
principle it must contain the window's rarest word: words are ordered by their count in all
documents, and only that one word of each window is joined.  A joined word fixes where the window
would have to start (positional bound) and the document must reach to its end (length bound);
what is left is verified word by word.

The windows come from the benchmark, whose size doesn't follow the corpus.  Where what is joined has at
most ``BROADCAST_BYTES`` it is broadcast, and documents are never shuffled: one pass counts words, a
second finds hits and word counts, of which only ids, counts and verified hits are shuffled.  Beyond
that size, words travel as (row, position, word), the candidates that the prefixes leave are joined
back to their documents, each of which is shuffled once, and verified there; Spark splits hot words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

WINDOW = 10
BROADCAST_BYTES = 32 << 20
#: What separates words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BETWEEN), ""), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, length: int = WINDOW, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``words, size, items``: every distinct window with the ids of its items."""
    words = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    size = F.least(F.size("all"), F.lit(length))
    return (
        words.select("item", "all", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("all") - size + 1)).alias("start"))
        .select("item", F.expr("slice(all, start, size)").alias("words"), "size")
        .groupBy("words", "size").agg(F.collect_set("item").alias("items"))
    )


def _small(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def prefixes(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> tuple[DataFrame, bool]:
    """``word, offset, words, size, items`` of every window whose words all documents have, by its rarest word; and whether to broadcast it."""
    windows = written(windows_of(benchmark, length), "windows")
    held = F.expr("aggregate(words, 64, (n, w) -> n + octet_length(w) + 16) + aggregate(items, 64, (n, i) -> n + octet_length(cast(i AS string)) + 16)")
    fits = (windows.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES
    vocabulary = windows.select(F.explode("words").alias("word"))
    counts = (
        docs.select(F.explode_outer(words_of(F.col("text"))).alias("word"))
        .join(_small(vocabulary, fits), "word", "left_semi")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    # every occurrence of a word in a window is a candidate anchor; the rarest one, first in ties, is kept
    keyed = (
        windows.withColumn("id", F.monotonically_increasing_id()).select("id", "words", "size", "items", F.posexplode("words").alias("offset", "word"))
        .join(_small(counts, fits), "word", "left")
        .groupBy("id", "words", "size", "items")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("offset"))).alias("rare"))
        .where("rare.n > 0")
        .select(F.col("rare.word").alias("word"), F.col("rare.offset").alias("offset"), "words", "size", "items")
    )
    return written(keyed, "prefixes"), fits


def hits(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """``key, n_words, start, size, items``: every occurrence of a window in ``docs(key, text)``; rows that repeat a key have one text.

    Every row of ``docs`` adds one row with a null start, so none is missing.
    """
    keyed, fits = prefixes(docs, benchmark, length)
    split = docs.select("key", words_of(F.col("text")).alias("all"))
    start = F.col("at") - F.col("offset")
    if not fits:
        n_words = F.size("all")
        # outer, as Spark would otherwise infer a filter on the size and split every text twice
        places = split.select("key", n_words.alias("n_words"), F.posexplode_outer("all").alias("at", "word"))
        likely = places.join(keyed, "word").where((start >= 0) & (start + F.col("size") <= F.col("n_words"))).select("key", start.alias("start"), "size", "words", "items")
        # a key's rows have one text, so candidates are found once for each row and met with each
        likely = likely.distinct()
        there = split.join(likely, "key").where(F.expr("slice(all, start + 1, size)") == F.col("words"))
        none = F.lit(None)
        rows = split.select("key", n_words.alias("n_words"), none.cast("int").alias("start"), none.cast("int").alias("size"), none.cast(keyed.schema["items"].dataType).alias("items"))
        return rows.union(there.select("key", n_words.alias("n_words"), "start", "size", "items"))
    # the row's own entry stands first; outer for the same reason
    entries = F.concat(F.array(F.lit(None).cast("string")), F.col("all"))
    spread = split.select("key", "all", F.posexplode_outer(entries).alias("entry", "word")).withColumn("at", F.col("entry") - 1)
    found = (start >= 0) & (start + F.col("size") <= F.size("all")) & (F.expr("slice(all, at - offset + 1, size)") == F.col("words"))
    return (
        spread.join(_small(keyed, fits), "word", "left")
        .where((F.col("at") < 0) | found)
        .select("key", F.size("all").alias("n_words"), F.when(F.col("at") >= 0, start).alias("start"), "size", "items")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h")).alias("key"), F.col(text_col).alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, h``: the rows of ``docs``, by id and hash of the text (xxhash64), that contain a window."""
    found = hits(_keyed(docs, id_col, text_col), benchmark, length)
    return found.where("start IS NOT NULL").select("key.id", "key.h").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of ``docs``: ``id_col, n_words, n_hit, n_items, items_sha256, contaminated``.

    A row is known by its id and its text, so repeated ids with other texts are judged apart and
    repeated rows alike.  Null and empty texts have no words; items without words have no window;
    a null id is an id like any other.  Very long texts are read whole, within one task each.  No
    other column is read.
    """
    found = hits(_keyed(docs, id_col, text_col), benchmark, length)
    # a document's hits come from one task, so the sets are all but final before the shuffle
    hit = F.col("start").isNotNull()
    per_row = found.groupBy("key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(~hit, 1)).cast("int").alias("rows"),
        F.collect_set(F.when(hit, F.struct("start", "size"))).alias("spans"), F.flatten(F.collect_set(F.when(hit, F.col("items").cast("array<string>")))).alias("items"),
    )
    places = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.size - 1)))))").cast("long")
    items = F.array_sort(F.array_distinct("items"))
    each = per_row.select(F.col("key.id").alias("id"), "n_words", places.alias("n_hit"), items.alias("items"), "rows", F.explode(F.array_repeat(F.lit(1), F.col("rows"))))
    return each.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
