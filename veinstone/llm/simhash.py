"""SimHash near-duplicates by a self-join of the binary trie of all fingerprints.

**Fingerprint.**  Every word shingle is hashed by XXH64; a bit of the fingerprint is 1 when it is
set in over half the hashes.

**Trie self-join.**  A sorted array of fingerprints is a binary trie: a node is a range.  Pairs of
nodes are walked down together, all pairs of a level at once; a pair whose paths differ in a bit
has spent one of the Hamming budget and is pruned when the budget is exceeded.

**Distribution.**  The trie is dealt to tasks by its top levels.  For a budget of k the bits are
cut into k + 1 blocks; two fingerprints in reach agree on one block at least, so k + 1 tries, each
with another block at the top, hold every pair under a common node at the depth of the block.
Fingerprints are made distinct first, so copies cost one leaf.  A task returns a spanning forest
of the links it found, never all pairs.

**Near-duplicate groups.**  For a similarity of 0.8 of shingle sets, fingerprints differ in too
many bits for any block to agree.  There the top levels of the trie are replaced by min-hash keys
(a pair of similarity s shares one of n keys with probability 1 - (1 - s)**n) and tries are joined
under each key with the budget that the similarity implies.  What that connects is a loose group;
within each loose group all pairs that share a key are compared exactly, by counting common shingles
over an inverted index, and a spanning forest of the pairs that are near is returned.

**Large buckets.**  A loose group that is too large for a task is dealt by key.  A key that too many
texts share, say by a common passage, is cut by their rarest shingles, a prefix filter that loses no
link.  What is still too large is cut into blocks, and every two rows that aren't connected yet meet in a task.  Blocks are cut by size first: rows whose
sizes alone rule the similarity out need not meet.  Tasks read sorted rows and hold one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .components import components

SEED = 42
#: Node pairs that a trie walk holds at once; beyond it the walk goes on in halves.
FRONTIER = 1 << 18
#: Rows of a bucket that one task compares with each other; a larger bucket is dealt as pairs of blocks.
BLOCK = 10_000
#: Rows of a large bucket, about, that meet all its blocks at first.
PIVOTS = 64
#: Rows that a worker gathers from small buckets before it compares them.
TASK_ROWS = 100_000

_digest = xxhash.xxh64_intdigest


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and ASCII space
    if not words:
        return np.empty(0, "u8")
    if len(words) <= size:
        return np.array([_digest(b" ".join(words), SEED)], "u8")
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1]
    return np.fromiter((_digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)), "u8", len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of ``hashes`` (n, words) as ``words`` numbers; 0 for no rows."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, "i8")
    for lo in range(0, n, 4096):
        part = np.ascontiguousarray(hashes[lo : lo + 4096]).view("u1").reshape(-1, 8 * words)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype="u2")
    return np.packbits(2 * counts > n, bitorder="little").view("u8")


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits of a hash."""
    x = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_join(groups: np.ndarray, values: np.ndarray, budget: int, settled: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with equal group whose values differ in at most ``budget`` bits.

    ``groups`` and ``values`` (unsigned 64-bit) are sorted by group, then value, without repeats.
    ``settled()`` gives a label to every position and how often it changed before; node pairs of
    one label are pruned.
    """
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), "i1"))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, a, b, c, d, spent = stack.pop()
        while len(a):
            if settled is not None:
                label, turns = settled()
                open_ = (label[a] != label[c]) | (turns[a] != turns[b - 1]) | (turns[c] != turns[d - 1])
                a, b, c, d, spent = a[open_], b[open_], c[open_], d[open_], spent[open_]
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack.append((bit, a[half:], b[half:], c[half:], d[half:], spent[half:]))
                a, b, c, d, spent = a[:half], b[:half], c[:half], d[:half], spent[:half]
            single = (b - a == 1) & (d - c == 1)
            if single.any():  # two leaves: the rest of the bits at once
                x, y = a[single], c[single]
                near = (x != y) & (bits_set(values[x] ^ values[y]) <= budget)
                if near.any():
                    yield x[near], y[near]
                keep = ~single
                a, b, c, d, spent = a[keep], b[keep], c[keep], d[keep], spent[keep]
            if not len(a) or bit < 0:
                break
            if bit not in ones:
                ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype="i8")])
                if len(ones) > 8:
                    del ones[next(iter(ones))]
            o = ones.get(bit)
            m, n = b - (o[b] - o[a]), d - (o[d] - o[c])
            same = a == c
            other = ~same
            parts = [(a, m, c, n, spent, slice(None)), (m, b, n, d, spent, slice(None)), (a, m, n, d, spent + 1, slice(None)), (m, b, c, n, spent + 1, other)]
            rows = []
            for p, q, r, s, t, pick in parts:
                p, q, r, s, t = p[pick], q[pick], r[pick], s[pick], t[pick]
                live = (p < q) & (r < s) & (t <= budget) & ~((p == r) & (q - p == 1))
                rows.append((p[live], q[live], r[live], s[live], t[live]))
            a, b, c, d, spent = (np.concatenate(x) for x in zip(*rows, strict=True))
            bit -= 1


class Forest:
    """Union-find over positions; ``link`` says whether the pair was still apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def fingerprints(docs: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` (64 bits as a signed long) of every row, over whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [int(majority(shingle_hashes(t.as_py(), size).reshape(-1, 1)).view("i8")[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(rotation that brings the block to the top, its width) of budget + 1 blocks of 64 bits."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _links(rows: DataFrame, weight: Column, band: Column, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b``: links that connect the classes that pairs within a bucket of ``rows(bucket, class, ...)`` connect.

    ``find`` gives such links for rows whose ``task`` takes the place of the bucket.  A bucket whose
    weights sum to one at most is a task.  A larger one is cut into blocks, by ``band`` and then by a hash;
    rows two or more bands apart need not meet.  First every block meets itself and a few pivots, which
    connects most of a bucket of copies.  Of the largest component that comes out no two rows have to
    meet any more; every block of it meets the blocks of the rest, and those meet each other.  So a
    bucket of copies costs its blocks; only one in which nothing is connected costs their pairs.
    """
    columns = [c for c in rows.columns if c != "bucket"]
    large = written(rows.groupBy("bucket").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("size")).where("w > 1").select("bucket", "size"), "large-buckets")
    if large.isEmpty():
        return find(rows.withColumnRenamed("bucket", "task"))
    block = F.pmod(F.xxhash64("class"), F.col("own")).cast("int")
    marked = rows.withColumns({"band": band, "weight": weight})
    big = written(marked.join(large, "bucket"), "large-rows")
    blocks = big.groupBy("bucket", "band").agg(F.ceil(F.sum("weight")).cast("int").alias("own"))
    placed = big.join(blocks, ["bucket", "band"]).withColumn("at", block)
    alone = placed.select(*columns, F.xxhash64("bucket", "band", "at").alias("task"))
    pivots = placed.where(F.pmod(F.xxhash64("class", F.lit("pivot")), F.col("size")) < PIVOTS).drop("own", "size", "weight")
    others = blocks.select("bucket", F.col("band").alias("to"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("k"))
    beside = pivots.join(others, "bucket").where("abs(band - to) <= 1 AND NOT (band = to AND at = k)").select(*columns, F.xxhash64("bucket", "to", "k").alias("task"))
    whole = rows.join(large, "bucket", "left_anti").select(*columns, F.col("bucket").alias("task"))
    first = written(find(whole.unionByName(alone).unionByName(beside)), "first-links")

    joined = big.join(components(first).withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    main = joined.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    joined = written(joined.join(main, "bucket").withColumn("rest", F.col("root") != F.col("main")), "joined-rows")
    if joined.where("rest").isEmpty():
        return first
    sums = lambda x: F.coalesce(F.ceil(F.sum(F.when(x, F.col("weight")))), F.lit(0)).cast("int")
    cut = written(joined.groupBy("bucket", "band").agg(sums(F.col("rest")).alias("r0"), sums(~F.col("rest")).alias("m0")), "blocks")
    near = cut
    for d, name in ((-1, "below"), (1, "above")):
        moved = cut.select("bucket", (F.col("band") - d).alias("band"), F.col("r0").alias(f"r_{name}"), F.col("m0").alias(f"m_{name}"))
        near = near.join(moved, ["bucket", "band"], "left")
    near = near.fillna(0).withColumnsRenamed({"r0": "r_same", "m0": "m_same"})
    dealt = joined.join(near, ["bucket", "band"]).withColumn("own", F.when(F.col("rest"), F.col("r_same")).otherwise(F.col("m_same"))).withColumn("at", block)
    each = lambda n, cell: f"transform(if({n} > 0, sequence(0, {n} - 1), array()), k -> xxhash64(bucket, {cell}))"
    of_rest = ", ".join([
        each("m_below", "'m', band, at, band - 1, k"), each("m_same", "'m', band, at, band, k"), each("m_above", "'m', band, at, band + 1, k"),
        each("r_below", "'r', band - 1, k, band, at"), each("r_same", "'r', band, least(k, at), band, greatest(k, at)"), each("r_above", "'r', band, at, band + 1, k"),
    ])
    of_main = ", ".join([each("r_below", "'m', band - 1, k, band, at"), each("r_same", "'m', band, k, band, at"), each("r_above", "'m', band + 1, k, band, at")])
    return first.union(find(dealt.select(*columns, F.explode(F.expr(f"if(rest, concat({of_rest}), concat({of_main}))")).alias("task"))))


def _by_task(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole tasks, of so many rows where one task isn't larger; the last column is the task, sorted."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:  # up to where the last task that is held ends
            tasks, last = batch.column(batch.num_columns - 1).to_numpy(), held[-1].column(batch.num_columns - 1)[-1].as_py()
            cut = int(np.searchsorted(tasks != last, True)) if tasks[-1] != last else len(tasks)
            if cut < len(tasks):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def links(fps: DataFrame, budget: int) -> DataFrame:
    """``a, b``: spanning links of the pairs of distinct ``fps(fp)`` within the budget."""
    turned = []
    for i, (turn, width) in enumerate(_blocks(budget)):
        v = F.expr(f"(shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn}))") if turn else F.col("fp")
        turned.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(v, 64 - width).alias("top"), v.alias("value")))

    turns = np.array([t for t, _ in _blocks(budget)], "u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(batches, TASK_ROWS):
            block, value, group = (t.column(c).to_numpy() for c in ("block", "value", "task"))
            value = value.view("u8")
            order = np.lexsort((value, group))
            block, group, value = block[order], group[order], value[order]
            forest, a, b = Forest(len(value)), [], []
            for x, y in trie_join(group, value, budget):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if forest.link(i, j):
                        a.append(i)
                        b.append(j)

            def back(at: list[int], value: np.ndarray = value, block: np.ndarray = block) -> pa.Array:
                at = np.array(at, "i8")
                v, t = value[at], turns[block[at]]
                return pa.array(np.where(t == 0, v, v >> t | v << ((64 - t) & np.uint64(63))).view("i8"))

            yield pa.RecordBatch.from_arrays([back(a), back(b)], ["a", "b"])

    if budget == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = fps.select(F.col("fp").alias("class"), F.explode(F.array(*turned)).alias("x")).select("class", "x.block", "x.value", F.xxhash64("x.block", "x.top").alias("bucket"))
    find = lambda dealt: dealt.select("block", "value", "task").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")
    return _links(rows, F.lit(1 / BLOCK), F.lit(0), find)


def simhash_components(docs: DataFrame, size: int = 3, budget: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row.

    Fingerprints that differ in at most ``budget`` bits are linked; component_id is the smallest
    id that can be reached.  Null, empty and blank texts have fingerprint zero, linked like any
    other.  Repeated rows and ids share a component; a null id has the smallest id of its
    component, null if there is none.  No other column is read.
    """
    with scratch(docs.sparkSession):
        fps = written(fingerprints(docs, size, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "id"), "fingerprints", keep=True)
        kinds = written(fps.groupBy("fp").agg(F.min("id").alias("first")), "kinds")
        linked = written(components(links(kinds, budget)), "linked")
        heads = linked.join(kinds, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("head"))
        heads = linked.join(heads, "root").select("node", "head")
        of = written(kinds.join(heads, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("head", "first").alias("component_id")), "components", keep=True)
    return fps.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicate groups by similarity of shingle sets

KEYS, WIDTH = 8, 4
#: Shingles of a loose group that one task compares.
BLOCK_SHINGLES = 4_000_000
#: Pairs that a task looks at before it brings its labels up to date.
STEP = 1 << 14
#: Rows of an id table that are broadcast at most.
BROADCAST_ROWS = 100_000


def _tally(n: int) -> np.ndarray:
    """Probabilities that so many of ``n`` fair bits are set."""
    return np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n


def _differ(common: int, a: int, b: int) -> float:
    """Probability that a fingerprint bit differs between two sets with ``common`` shingles, and ``a`` and ``b`` of their own."""
    over = lambda own: np.array([_tally(own)[2 * (i + np.arange(own + 1)) > common + own].sum() for i in range(common + 1)])
    x, y = over(a), over(b)
    return float((_tally(common) * (x * (1 - y) + y * (1 - x))).sum())


@lru_cache
def bits_for(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits of a pair of that Jaccard similarity at least, and so many standard deviations more.

    Many shingles make a bit differ with probability acos(cosine) / pi.  Few shingles make it
    differ more often; the worst sets of up to 32 are tried.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for n in range(1, 33):
        for m in range(n, int(n / similarity) + 1):
            common = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if common <= n:
                p = max(p, _differ(common, n - common, m - common))
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """``id, h, n, fp (WIDTH longs), keys (KEYS longs)`` over the set of shingles of every whole text; rows(id, h, text)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, keys = [], [], []
            for t in batch.column(2):
                h = np.unique(shingle_hashes(t.as_py(), size))
                n.append(len(h))
                wide = np.stack([h, *(_mixed(h, 100 + i) for i in range(1, WIDTH))], 1)
                fps.append(majority(wide).view("i8").tolist())
                keys.append([int(_mixed(h, 1 + i).min().view("i8")) if len(h) else 0 for i in range(KEYS)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(fps, longs), pa.array(keys, longs)], ["id", "h", "n", "fp", "keys"])

    return rows.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, n long, fp array<long>, keys array<long>")


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes``, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _labels(forest: Forest) -> np.ndarray:
    up = np.array(forest.up, "i8")
    while (up != up[up]).any():
        up = up[up]
    return up


def _band(similarity: float) -> Column:
    """Sets of that similarity are of the same or of neighbouring bands."""
    return F.floor(F.log("n") / (math.log(1 / similarity) + 1e-6)).cast("int")


def _loose_links(group: np.ndarray, ids: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning links (a > b) between classes of one bucket whose sizes and fingerprints allow the similarity."""
    budget, wide_budget = bits_for(similarity, 64, 4), bits_for(similarity, 64 * WIDTH, 5)
    names, at = np.unique(ids, return_inverse=True)
    order = np.lexsort((ids, fp[:, 0], group))
    order = order[np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (at[order][1:] != at[order][:-1])])]
    group, at, n, fp = group[order], at[order], n[order], fp[order]
    forest = Forest(len(names))
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (fp[1:, 0] != fp[:-1, 0])])
    first, leaf_of = np.flatnonzero(new), np.cumsum(new) - 1  # leaves of the trie
    sizes = np.diff(np.append(first, len(at)))
    label = np.arange(len(names))
    out: list[tuple[int, int]] = []
    seen: tuple = (None, None, None)

    def settled() -> tuple[np.ndarray, np.ndarray]:
        nonlocal seen
        if seen[0] is not label:
            same = label[at]
            whole = np.logical_and.reduceat(same == same[first[leaf_of]], first)
            same = np.where(whole, same[first], -1 - np.arange(len(first)))  # a leaf with open rows is its own
            seen = (label, same, np.concatenate([[0], np.cumsum(same[1:] != same[:-1])]))
        return seen[1:]

    def take(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label
        for lo in range(0, len(x), STEP):
            p, q = x[lo : lo + STEP], y[lo : lo + STEP]
            fits = (label[at[p]] != label[at[q]]) & (np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-9)
            p, q = p[fits], q[fits]
            fits = bits_set(fp[p] ^ fp[q]).sum(1, dtype="i8") <= wide_budget
            before = len(out)
            for i, j in zip(at[p[fits]].tolist(), at[q[fits]].tolist(), strict=True):
                if forest.link(i, j):
                    out.append((max(i, j), min(i, j)))
            if len(out) > before:
                label = _labels(forest)

    def rows_of(x: np.ndarray, y: np.ndarray) -> None:
        """Take all rows of leaves x with all rows of leaves y."""
        x, y = np.repeat(first[x], sizes[x]) + _counted(sizes[x]), np.repeat(y, sizes[x])
        edges = np.searchsorted(np.cumsum(sizes[y]), np.arange(0, sizes[y].sum() + FRONTIER, FRONTIER), "right")
        for lo, hi in zip(edges, np.append(edges[1:], len(y)), strict=True):
            p, q = x[lo:hi], y[lo:hi]
            take(np.repeat(p, sizes[q]), np.repeat(first[q], sizes[q]) + _counted(sizes[q]))

    rest = np.flatnonzero(~new)
    take(first[leaf_of[rest]], rest)
    for leaf in np.flatnonzero(sizes > 1):
        if len(np.unique(label[at[first[leaf] : first[leaf] + sizes[leaf]]])) > 1:
            rows_of(np.array([leaf]), np.array([leaf]))
    for allowed in sorted({min(budget, b) for b in (2, 6, 12, 18, budget)}):  # near pairs settle most of what is dense
        for x, y in trie_join(group[first], fp[first, 0], allowed, settled):
            rows_of(x, y)
    return [(int(names[i]), int(names[j])) for i, j in out]


def _at_rows(docs: DataFrame, wanted: DataFrame) -> Column:
    """Whether a row of ``docs(id, h, text)`` is the one of ``wanted(w_id, w_h)``."""
    return (docs["h"] == wanted["w_h"]) & docs["id"].eqNullSafe(wanted["w_id"])


def _by_rare_shingles(rows: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``rows(bucket, class, n, id, h, ...)`` where large buckets are cut by shingles, if that lessens the pairs.

    Within a bucket, shingles are ordered by how many of its classes have them.  Sets of that similarity
    have one of the first ``n - ceil(similarity * n) + 1`` in common, so no link is lost, and what only
    shares a common passage is parted.  Shingles of a single class are counted, not dealt.  A bucket of
    near copies, which shares nearly all shingles, is left as it is.
    """
    large = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "hot-keys")
    if large.isEmpty():
        return rows
    hot = written(rows.join(large.select("bucket"), "bucket", "left_semi"), "hot-rows")
    wanted = hot.select("bucket", "class", "n", F.col("id").alias("w_id"), F.col("h").alias("w_h"))
    texts = docs.join(wanted, _at_rows(docs, wanted)).groupBy("bucket", "class", "n").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.unique(shingle_hashes(batch.column(3)[i].as_py(), size)).view("i8")
                same = [pa.array(np.full(len(h), batch.column(c)[i].as_py()), pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h)], ["bucket", "class", "n", "shingle"])

    has = written(texts.mapInArrow(run, "bucket long, class long, n long, shingle long"), "hot-shingles")
    counts = has.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = has.join(counts, ["bucket", "shingle"]).groupBy("bucket", "class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("by"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("by"))
    dealt = shared.select("bucket", "class", F.explode(F.slice("by", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("bucket", "class", "x.shingle")
    dealt = written(dealt, "rare-shingles")
    pairs = dealt.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("bucket").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    less = large.join(pairs, "bucket", "left").where(F.coalesce("pairs", F.lit(0.0)) < F.col("m").cast("double") * F.col("m")).select("bucket")
    less = written(less, "cut-buckets")
    cut = dealt.join(less, "bucket", "left_semi").join(hot, ["bucket", "class"]).withColumn("bucket", F.xxhash64("bucket", "shingle")).select(*rows.columns)
    return rows.join(less, "bucket", "left_anti").select(*rows.columns).unionByName(cut)


def _candidates(classes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``a, b``: spanning links, bucket by bucket, of classes(class, n, fp, keys, id, h) that share a key and may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(batches, TASK_ROWS):
            group, ids, n = (t.column(c).to_numpy() for c in ("task", "class", "n"))
            fp = np.stack([t.column(f"f{i}").to_numpy().view("u8") for i in range(WIDTH)], 1)
            found = _loose_links(group, ids, n, fp, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    keyed = classes.select("class", "n", "id", "h", *[F.col("fp")[i].alias(f"f{i}") for i in range(WIDTH)], F.posexplode("keys").alias("i", "key"))
    rows = _by_rare_shingles(keyed.withColumn("bucket", F.xxhash64("i", "key")).drop("i", "key"), docs, size, similarity)
    find = lambda dealt: dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")
    return _links(rows.drop("id", "h"), F.lit(1 / BLOCK), _band(similarity), find)


def spanning_links(sets: list[np.ndarray], similarity: float, keys: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all of the sets (sorted, without repeats) that pairs of at least that Jaccard
    similarity and with one of their ``keys`` (set, key) in common connect.

    A search from set to set: an inverted index counts what the set at hand has in common with
    every set that isn't reached yet, exactly; what is near is reached and searched from later.
    The index is made anew as sets are reached, so groups of near sets cost little.
    """
    sizes = np.array([len(s) for s in sets], "i8")
    owner, value = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, token, df = np.unique(value, return_inverse=True, return_counts=True)
    shared = df[token] > 1
    owner, token = owner[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    tokens = np.split(token, np.searchsorted(owner, np.arange(1, len(sets))))
    count = int(token.max()) + 1 if len(token) else 0
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edges = np.searchsorted(token, np.arange(count + 1))
    open_, out = np.ones(len(sets), bool), []
    left = indexed = len(sets)
    for seed in range(len(sets)):
        stack = [seed] if open_[seed] else []
        if stack:
            open_[seed] = False
            left -= 1
        while stack:
            x = stack.pop()
            if not left:
                continue
            if 2 * left < indexed:
                live = open_[owner]
                token, owner, indexed = token[live], owner[live], left
                edges = np.searchsorted(token, np.arange(count + 1))
            t = tokens[x]
            a, k = edges[t], edges[t + 1] - edges[t]
            common = np.bincount(owner[np.repeat(a, k) + _counted(k)], minlength=len(sets)) if k.any() else np.zeros(len(sets), "i8")
            found = np.flatnonzero(open_ & (common > 0) & (common * (1 + similarity) >= similarity * (sizes + sizes[x]) - 1e-9))
            found = found[(keys[found] == keys[x]).any(1)]
            open_[found] = False
            left -= len(found)
            out += [(x, int(y)) for y in found]
            stack += found.tolist()
    return out


def _no_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those whose class and task repeat: rows may share id and text."""
    last = None
    for batch in batches:
        if batch.num_rows:
            at = np.stack([batch.column(c).to_numpy() for c in ("class", "task")])
            new = np.concatenate([[last is None or (at[:, 0] != last).any()], (at[:, 1:] != at[:, :-1]).any(0)])
            last = at[:, -1].copy()
            yield batch if new.all() else batch.filter(pa.array(new))


def _verified(members: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """``a, b``: spanning links of the pairs within each bucket that have that similarity and share a key.

    members(bucket, class, n, keys, id, h): classes and, for each, a row of ``rows(id, h, text)`` that has its text.
    A bucket that is too large for a task is dealt by key first, as only pairs that share one are links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_task(_no_repeats(batches), 1):
            task, ids = t.column("task").to_numpy(), t.column("class").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            a, b = [], []
            texts = t.column("text")
            keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, KEYS)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = spanning_links([np.unique(shingle_hashes(texts[i].as_py(), size)) for i in range(lo, hi)], similarity, keys[lo:hi])
                a += [int(ids[lo + x]) for x, _ in found]
                b += [int(ids[lo + y]) for _, y in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    weight = F.greatest(F.lit(1 / BLOCK), F.col("n") / F.lit(float(BLOCK_SHINGLES)))
    large = written(members.groupBy("bucket").agg(F.sum(weight).alias("w")).where("w > 1").select("bucket"), "large-groups")
    if not large.isEmpty():
        by_key = members.join(large, "bucket", "left_semi").select("*", F.posexplode("keys").alias("i", "key")).withColumn("bucket", F.xxhash64("bucket", "i", "key"))
        members = members.join(large, "bucket", "left_anti").unionByName(by_key.drop("i", "key"))

    def find(dealt: DataFrame) -> DataFrame:
        dealt = written(dealt, "dealt")
        wanted = dealt.select("class", "keys", F.col("id").alias("w_id"), F.col("h").alias("w_h"), "task")
        if dealt.count() <= BROADCAST_ROWS:  # the texts of the others then aren't shuffled at all
            wanted = F.broadcast(wanted)
        texts = rows.join(wanted, _at_rows(rows, wanted))
        return texts.select("keys", "text", "class", "task").repartition("task").sortWithinPartitions("task", "class").mapInArrow(run, "a long, b long")

    return _links(members, weight, _band(similarity), find)


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, h, head_id, head_h, rows``: what isn't the first of its group, or is there more than once.

    A row is known by its id and ``h``, the hash of its text (xxhash64); ``rows`` is how many rows
    share both.  A group is connected by pairs of texts whose sets of ``size``-word shingles have
    that Jaccard similarity at least; texts with the same shingles are one class.  The first of a
    group, ``head``, has the least id, rows without an id come last, and among equals the least
    hash.  Null and blank texts have no shingle and are in no group.  No other column is read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        made = sketches(rows, size).where("n > 0")
        made = written(made.withColumn("class", F.xxhash64("n", "fp", "keys")), "sketches")
        rank = F.struct(F.col("id").isNull().alias("last"), "id", "h")
        classes = made.groupBy("class").agg(F.min(rank).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
        classes = written(classes, "classes")
        placed = classes.select("class", "n", "fp", "keys", "first.id", "first.h")
        loose = components(_candidates(placed, rows, size, similarity))
        members = loose.join(placed, F.col("node") == F.col("class")).select(F.col("root").alias("bucket"), "class", "n", "keys", "id", "h")
        linked = components(_verified(members, rows, size, similarity))
        of = written(classes.select("class", "first").join(linked, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("group"), "first"), "groups")
        of = of.join(of.groupBy("group").agg(F.min("first").alias("head")), "group").select("class", "head")
        each = made.groupBy("class", "id", "h").agg(F.count(F.lit(1)).alias("rows")).join(of, "class")
        out = each.select("id", "h", F.col("head.id").alias("head_id"), F.col("head.h").alias("head_h"), "rows")
        return written(out.where("rows > 1 OR NOT (id <=> head_id AND h = head_h)"), "near-groups", keep=True)
