"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, up to ``ORDER`` of them, so it covers every language alike.  It is
counted on all trusted documents: tasks pre-aggregate the n-grams they see, a shuffle sums them by
n-gram.  Continuation counts of the lower orders, the counts of counts that give the three
discounts of each order, context totals and interpolated probabilities are aggregations and joins
over these tables, sharded by n-gram or context; a context has 256 followers at most, so no key is
hot.  The result is a back-off table (n-gram, log probability, log back-off weight).

Scoring joins the n-grams of documents with that table.  Documents are dealt into blocks of
``BLOCK_BYTES``; a block's distinct n-grams are what is joined, each distinct n-gram of the corpus once
and down the orders as it backs off, so hardly more than the texts is shuffled and no task holds the
model.  A table of ``RESIDENT_ROWS`` rows at most is instead held by every worker, which spares the
shuffle of the texts.  Both give the same perplexities.  A pair for every document and n-gram would be
several times the input, as half of all 5-grams of a document are distinct.

A document's perplexity is compared with a quantile, for its language, of trusted documents that the
model was not trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

ORDER = 5
#: Rows of a back-off table that a worker holds (some 130 MB).
RESIDENT_ROWS = 4_000_000
#: Text of a block of documents.
BLOCK_BYTES = 16 << 20
#: n-grams that a worker gathers before it leaves out repeats.
HELD_GRAMS = 4_000_000
#: Share of held-out trusted documents that pass, and the width of the histogram it is read from.
QUANTILE, BIN = 0.98, 0.005
#: What stands before a text.
START = b"\n" * (ORDER - 1)


def grams(text: bytes, order: int) -> np.ndarray:
    """For every byte of ``text`` the number 1 and its last ``order`` bytes, as one whole number."""
    b = np.frombuffer(START + text, "u1").astype("i8")
    n = len(text)
    out = np.ones(n, "i8")
    for i in range(ORDER - order, ORDER):
        out = out << 8 | b[i : i + n]
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """``g, c``: the n-grams of highest order of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_keys, total_counts = np.empty(0, "i8"), np.empty(0, "i8")

        def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype("i8")

        for batch in batches:
            held, size = [], 0
            for t in [*batch.column(0), None]:
                if t is not None and t.is_valid:
                    held.append(grams(t.as_py().encode("utf-8", "replace"), ORDER))
                    size += len(held[-1])
                if held and (t is None or size > 2_000_000):
                    k, c = np.unique(np.concatenate(held), return_counts=True)
                    total_keys, total_counts = merged([total_keys, k], [total_counts, c])
                    held, size = [], 0
            if len(total_keys) > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(total_keys), pa.array(total_counts)], ["g", "c"])
                total_keys, total_counts = np.empty(0, "i8"), np.empty(0, "i8")
        yield pa.RecordBatch.from_arrays([pa.array(total_keys), pa.array(total_counts)], ["g", "c"])

    return texts.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(ns: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams were seen once, twice, three and four times."""
    n1, n2, n3, n4 = (max(1, n) for n in ns)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k) for k, x in enumerate(d, 1))


def _suffix(g: Column, order: int) -> Column:
    """The last ``order`` bytes of an n-gram, marked by a leading one."""
    return g.bitwiseAND((1 << 8 * order) - 1).bitwiseOR(1 << 8 * order)


def backoff_table(texts: DataFrame) -> DataFrame:
    """``g, logp, bow`` of all orders, natural logarithms; ``bow`` is the weight of g as a context."""
    tables = {ORDER: written(count_grams(texts), f"grams{ORDER}")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct bytes before
        tables[k] = written(tables[k + 1].groupBy(_suffix(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"grams{k}")
    lower, out = None, []
    weights: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        t = tables[k]
        ns = t.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(list(ns))
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftright("g", 8)
        by = t.groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), F.sum(off).alias("spare")).withColumn("gamma", F.col("spare") / F.col("total"))
        by = written(by, f"contexts{k}")
        joined = t.withColumn("ctx", context).join(by, "ctx")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            joined = joined.withColumn("s", _suffix(F.col("g"), k - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
            below = F.col("below")
        p = F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total") + F.col("gamma") * below
        lower = written(joined.select("g", p.alias("p")), f"probabilities{k}")
        weights[k] = by
        out.append(lower)
    parts = []
    for k in range(1, ORDER + 1):
        t = out[k - 1].select("g", F.log("p").alias("logp"))
        if k < ORDER:
            t = t.join(weights[k + 1].select(F.col("ctx").alias("g"), F.log("gamma").alias("bow")), "g", "full")
        else:
            t = t.withColumn("bow", F.lit(None).cast("double"))
        parts.append(t.select("g", "logp", "bow"))
    whole = parts[0]
    for t in parts[1:]:
        whole = whole.union(t)
    # the context of the first byte is the empty one, marked 1
    whole = whole.union(weights[1].select(F.col("ctx").alias("g"), F.lit(None).cast("double"), F.log("gamma").alias("bow")))
    return whole.select("g", F.col("logp").cast("float"), F.col("bow").cast("float"))


class Shard:
    """n-grams by open addressing: probing is a few vector operations."""

    def __init__(self, g: np.ndarray, logp: np.ndarray, bow: np.ndarray):
        bits = max(4, int(2 * len(g)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, "i8")
        self.logp, self.bow = np.full(1 << bits, np.nan, "f4"), np.zeros(1 << bits, "f4")
        left, at = np.arange(len(g)), self._home(g)
        while len(left):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]] = g[left[put]]
            self.logp[at[put]], self.bow[at[put]] = logp[left[put]], bow[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _home(self, g: np.ndarray) -> np.ndarray:
        return ((g.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("i8")

    def find(self, g: np.ndarray) -> np.ndarray:
        """Slots; where an n-gram isn't there, an empty slot."""
        at = self._home(g)
        there = self.keys[at]
        todo = np.flatnonzero((there != g) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            todo = todo[(there != g[todo]) & (there != 0)]
        return at


class Model:
    """A written back-off table, held by a worker."""

    def __init__(self, path: str):
        uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
        fs, place = pa.fs.FileSystem.from_uri(uri)
        t = pa.dataset.dataset(place, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table(columns=["g", "logp", "bow"])
        g, logp, bow = (t.column(c).to_numpy() for c in ("g", "logp", "bow"))
        self.whole = Shard(g, logp.astype("f4"), np.nan_to_num(bow.astype("f4"), nan=0.0))

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.whole.find(g)
        return self.whole.logp[at], self.whole.bow[at]

    def log_probabilities(self, text: bytes) -> np.ndarray:
        """Of every byte after those before it."""
        g = grams(text, ORDER)
        out = np.zeros(len(g))
        todo = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            if not k:  # a byte that the model never saw
                out[todo] += -math.log(256)
                break
            now = g[todo] & ((1 << 8 * k) - 1) | 1 << 8 * k
            logp, _ = self.lookup(now)
            hit = ~np.isnan(logp)
            out[todo[hit]] += logp[hit]
            todo, now = todo[~hit], now[~hit]
            if not len(todo):
                break
            out[todo] += self.lookup(now >> 8)[1]
        return out


@lru_cache(maxsize=1)
def _model(path: str) -> Model:
    return Model(path)


def scores(docs: DataFrame, path: str, keep: list[str], *, text_col: str) -> DataFrame:
    """``keep`` and ``nats``, the mean negative log probability of a byte; null without bytes.  Workers hold the table."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            nats: list[float | None] = [None] * len(texts)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 500_000):
                    size += len(texts[hi])
                    hi += 1
                ends = np.cumsum([0, *(len(START) + len(t) for t in texts[lo:hi])])
                # texts one after another, each with its start before it, which isn't counted
                p = model.log_probabilities(b"".join(START + t for t in texts[lo:hi]))
                for i in range(lo, hi):
                    if texts[i]:
                        nats[i] = float(-p[ends[i - lo] + len(START) : ends[i - lo + 1]].mean())
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(nats, pa.float64())], [*keep, "nats"])

    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(run, ", ".join([*kinds, "nats double"]))


def gram_log_probabilities(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """``g, lp`` for wanted(g), n-grams of highest order: down the orders, each with two joins by n-gram."""
    found = None
    todo = wanted.select("g", F.col("g").alias("now"), F.lit(0.0).alias("sum"))
    for k in range(ORDER, 0, -1):
        hit = todo.join(table.select(F.col("g").alias("now"), "logp"), "now", "left")
        hit = written(hit.select("g", "now", "sum", "logp"), f"backed-off{k}")
        done = hit.where("logp IS NOT NULL").select("g", (F.col("sum") + F.col("logp").cast("double")).alias("lp"))
        found = done if found is None else found.union(done)
        left = hit.where("logp IS NULL").withColumn("ctx", F.shiftright("now", 8)).join(table.select(F.col("g").alias("ctx"), "bow"), "ctx", "left")
        below = _suffix(F.col("now"), k - 1) if k > 1 else F.lit(1).cast("long")
        todo = left.select("g", below.alias("now"), (F.col("sum") + F.coalesce(F.col("bow").cast("double"), F.lit(0.0))).alias("sum"))
    return found.union(todo.select("g", F.col("sum") - math.log(256)))


def scores_by_joins(docs: DataFrame, table: DataFrame, keep: list[str], *, text_col: str) -> DataFrame:
    """As ``scores``, without a worker that holds the table."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    block = F.pmod(F.xxhash64(*keep, text_col), F.lit(total // BLOCK_BYTES + 1))
    dealt = docs.select(block.alias("block"), *keep, F.col(text_col).alias("__text"))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at, size, most = None, 0, HELD_GRAMS

        def distinct() -> np.ndarray:
            return np.unique(np.concatenate(held))

        def out() -> pa.RecordBatch:
            g = distinct()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), at), pa.int64()), pa.array(g)], ["block", "g"])

        for batch in batches:
            for b, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and b != at:
                    yield out()
                    held, size, most = [], 0, HELD_GRAMS
                at = b
                if t.is_valid:
                    held.append(np.unique(grams(t.as_py().encode("utf-8", "replace"), ORDER)))
                    size += len(held[-1])
                    if size > most:
                        held = [distinct()]
                        size = len(held[0])
                        most = max(HELD_GRAMS, 2 * size)
        if held:
            yield out()

    pairs = dealt.select("block", "__text").repartition("block").sortWithinPartitions("block").mapInArrow(grams_of, "block long, g long")
    pairs = written(pairs, "block-grams")
    known = gram_log_probabilities(pairs.select("g").distinct(), table)
    answers = pairs.join(known, "g").select("block", "g", "lp")

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        g, lp = found.column("g").to_numpy(), found.column("lp").to_numpy()
        order = np.argsort(g, kind="stable")
        g, lp = g[order], lp[order]
        nats: list[float | None] = []
        for t in texts.column("__text"):
            data = (t.as_py() or "").encode("utf-8", "replace")
            nats.append(float(-lp[np.searchsorted(g, grams(data, ORDER))].mean()) if data else None)
        return pa.Table.from_arrays([*(texts.column(c) for c in keep), pa.array(nats, pa.float64())], [*keep, "nats"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, ", ".join([*kinds, "nats double"]))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For every row of ``docs``: ``id_col, lang, perplexity, threshold, keep``.

    Trusted are documents that ``labels(doc_id, quality, toxic)`` calls good and not toxic; where
    labels contradict each other the worst counts.  Four fifths of them, by their id, train the
    model; the rest give each language's threshold.  A language without such documents takes the
    threshold of all of them, and without any trusted document everything is kept.  Null and empty
    texts have no perplexity and are kept; a null language is 'und'.  Very long texts are read whole,
    each within one task; repeated rows are judged alike, and rows with a null id are not trusted.
    Other columns are not read.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).where("q = 1 AND x = 0").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    # labels grow with the corpus: they are merged, never broadcast, so every size has one plan
    trusted = rows.select("id", "text").where(~fold).join(good.hint("merge"), "id", "left_semi").select("text")
    with scratch(docs.sparkSession):
        model = written(backoff_table(trusted), "model")
        n = model.count()
        if not n:
            return rows.select(F.col("id").alias(id_col), "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
        if n <= RESIDENT_ROWS:
            scored = scores(rows, model.inputFiles()[0].rpartition("/")[0], ["id", "lang"], text_col="text")
        else:
            scored = scores_by_joins(rows, model, ["id", "lang"], text_col="text")
        scored = written(scored, "scores", keep=True)
        return _judged(scored, good, fold, id_col)


def _judged(scored: DataFrame, good: DataFrame, fold: Column, id_col: str) -> DataFrame:
    """Scores against the quantile of each language's held-out trusted documents."""
    held = scored.where(fold & F.col("nats").isNotNull()).join(good, "id", "left_semi").groupBy("lang", F.ceil(F.col("nats") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    held = written(held, "histogram")
    both = held.union(held.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n").alias("n")))
    # the histogram has a few thousand rows whatever the size of the corpus
    found: dict[str | None, list[tuple[int, int]]] = {}
    for r in both.collect():
        found.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    limits = {}
    for lang, bins in found.items():
        total, seen = sum(c for _, c in bins), 0
        for b, c in sorted(bins):
            seen += c
            if seen >= QUANTILE * total:
                limits[lang] = b * BIN
                break
    general = F.lit(limits.pop(None, None)).cast("double")
    limit = general
    for lang, x in sorted(limits.items()):
        limit = F.when(F.col("lang") == lang, F.lit(x)).otherwise(limit)
    keep = F.coalesce(F.col("nats") <= limit, F.lit(True))
    return scored.select(F.col("id").alias(id_col), "lang", F.round(F.exp("nats"), 6).alias("perplexity"), F.round(F.exp(limit), 6).alias("threshold"), keep.alias("keep"))
