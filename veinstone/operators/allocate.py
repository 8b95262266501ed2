"""Budgeted allocation of effort: which nodes of a tree get which tier.

What a tier is worth to a node depends on its potential and depth alone, so the search for the
multipliers runs on a histogram of (potential, depth), the number of nodes for each distinct pair.  It
stays a table at every size: a job sums it up under all prices that the next halvings can come to,
and only these sums reach the driver.  Gains are added as whole numbers, so that no order of the
tasks changes a sum.  The tiers themselves are one projection over the nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TIERS
from ..store import scratch, written

STEPS, GRID = 20, 10
#: Largest price of cost, of depth and of a node in the deep tier.
TOP_COST, TOP_DEPTH, TOP_TIER3 = 10.0, 1.0, 10.0
#: Halvings of a price that a job looks ahead; it tries ``2 ** AHEAD - 1`` prices, for a pair of prices the square.
AHEAD = 5


@dataclass
class Constraints:
    max_cost: float = 50.0
    max_depth: int = 20
    max_tier3: int = 5


@dataclass
class Calibration:
    lambda_cost: float = 0.0
    lambda_depth: float = 0.0
    lambda_tier3: float = 0.0
    total_gain: float = 0.0
    total_cost: float = 0.0
    tier3: int = 0
    iterations: int = 0
    heterogeneous: bool = False
    feasible: bool = True
    skip_all: bool = field(default=False, repr=False)


def net(tier: str, potential: Column, depth: Column, l_cost: Column, l_depth: Column, l_tier3: Column) -> Column:
    cost, share = TIERS[tier]
    out = potential * share - l_cost * cost - l_depth * depth
    return out - l_tier3 if tier == "deep" else out - F.lit(0.0)


def tier_of(potential: Column, depth: Column, l_cost: Column, l_depth: Column, l_tier3: Column) -> Column:
    """The tier with the largest net gain above 0; of equal ones the cheaper."""
    names = list(TIERS)[1:]
    gains = [net(t, potential, depth, l_cost, l_depth, l_tier3) for t in names]
    best = F.greatest(F.lit(0.0), *gains)
    out = F.when(best <= 0, "skip")
    for t, g in zip(names, gains, strict=True):
        out = out.when(g == best, t)
    return out


def _lookup(tier: Column, which: int) -> Column:
    out = F.lit(0.0)
    for t, pair in TIERS.items():
        out = F.when(tier == t, F.lit(pair[which])).otherwise(out)
    return out


def tier_cost(tier: Column) -> Column:
    return _lookup(tier, 0)


def tier_gain(tier: Column) -> Column:
    return _lookup(tier, 1)


def solve(tree: DataFrame, l_cost: float, l_depth: float, l_tier3: float) -> DataFrame:
    """``tree(cid, info_potential, depth)`` with ``tier, gain, cost`` under fixed multipliers."""
    t = tier_of(F.col("info_potential"), F.col("depth"), F.lit(l_cost), F.lit(l_depth), F.lit(l_tier3))
    return tree.withColumn("tier", t).withColumns({"gain": F.col("info_potential") * tier_gain(F.col("tier")), "cost": tier_cost(F.col("tier"))})


def heterogeneous(tree: DataFrame) -> DataFrame:
    """One row ``heterogeneous``: finite positive half-lives, two at least, vary by over a half."""
    h = F.col("half_life_secs")
    fine = F.when((h > 0) & (h != float("inf")) & ~F.isnan(h), h)
    return tree.agg(F.coalesce((F.count(fine) >= 2) & (F.stddev_pop(fine) / F.avg(fine) > 0.5), F.lit(False)).alias("heterogeneous"))


_COST, _SHARE = (np.array([TIERS[t][i] for t in TIERS]) for i in (0, 1))
#: Prices of cost, of depth and of a node in the deep tier.
Prices = tuple[float, float, float]


def tiers_of(p: np.ndarray, depth: np.ndarray, prices: Prices) -> tuple[np.ndarray, np.ndarray]:
    """Places of the best tiers, the first of equal ones, and their net gains; arrays may be broadcast."""
    l_cost, l_depth, l_tier3 = prices
    gains = np.stack([np.broadcast_to(p * share - l_cost * cost - l_depth * depth, np.broadcast_shapes(np.shape(p), np.shape(l_cost), np.shape(l_depth))) for cost, share in zip(_COST, _SHARE, strict=True)])
    gains[3] -= l_tier3
    gains[0] = 0
    return gains.argmax(0), gains.max(0)


def sums_by_price(hist: DataFrame, prices: list[Prices]) -> DataFrame:
    """``price, gain, cost, tier3`` for each of ``prices`` (of cost, depth and deep nodes) over hist(p, depth, n).

    Tasks sum up their pairs for every price, so what is shuffled is a row for each task and price.  A
    gain is cut into a whole part and two of 20 bits, whose sums are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(prices), 5), "i8")
        for batch in batches:
            p, depth, n = (c.to_numpy() for c in batch.columns)
            for i, x in enumerate(prices):
                tier, _ = tiers_of(p, depth, x)
                gain = p * _SHARE[tier]
                whole = np.floor(gain)
                bits = np.rint((gain - whole) * 2.0**40).astype("i8")
                parts = whole.astype("i8"), bits >> 20, bits & 0xFFFFF, _COST[tier].astype("i8"), (tier == 3).astype("i8")
                total[i] += [int((x * n).sum()) for x in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(prices)), pa.int32()), *map(pa.array, total.T)], ["price", "whole", "high", "low", "cost", "tier3"])

    each = hist.select(F.col("p").cast("double"), F.col("depth").cast("double"), F.col("n").cast("long"))
    sums = each.mapInArrow(run, "price int, whole long, high long, low long, cost long, tier3 long").groupBy("price").agg(*[F.sum(c).alias(c) for c in ("whole", "high", "low", "cost", "tier3")])
    gain = F.col("whole") + (F.col("high") * float(1 << 20) + F.col("low")) / float(1 << 40)
    return sums.select("price", gain.alias("gain"), F.col("cost").cast("double").alias("cost"), "tier3")


def depth_prices(tops: DataFrame, pairs: list[tuple[float, float]]) -> list[tuple[float, bool]]:
    """For each pair of prices (of cost and deep nodes) the least price of depth under which no row of tops(p, depth) is used, and whether it is one.

    Each depth has its own least price, which tasks find for all pairs at once; the largest of them holds for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, deep = np.array(pairs).T
        most, kept = np.full(len(pairs), TOP_DEPTH / 2**STEPS), np.ones(len(pairs), bool)
        for batch in batches:
            for p, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                used = lambda at: tiers_of(p, depth, (cost, at, deep))[1] > 0  # noqa: B023, E731
                fails, held = np.zeros(len(pairs)), np.full(len(pairs), TOP_DEPTH)
                for _ in range(STEPS):
                    trial = fails + (held - fails) / 2
                    is_used = used(trial)
                    fails, held = np.where(is_used, trial, fails), np.where(is_used, held, trial)
                most, kept = np.maximum(most, held), kept & ~used(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array(most), pa.array(kept)], ["pair", "price", "kept"])

    found = tops.select(F.col("p").cast("double"), F.col("depth").cast("double")).mapInArrow(run, "pair int, price double, kept boolean")
    rows = found.groupBy("pair").agg(F.max("price").alias("price"), F.bool_and("kept").alias("kept")).collect()
    return [(r["price"], r["kept"]) for r in sorted(rows, key=lambda r: r["pair"])] or [(TOP_DEPTH / 2**STEPS, True)] * len(pairs)


def pairs_of(tree: DataFrame) -> DataFrame:
    """The histogram ``p, depth, n`` of a tree."""
    return tree.groupBy(F.col("info_potential").cast("double").alias("p"), "depth").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Halving:
    """The search for the least price below ``top`` that holds: ``STEPS`` halvings, ``held`` is ``top`` where none does."""

    top: float
    fails: float = 0.0
    held: float = field(init=False)
    steps: int = 0

    def __post_init__(self) -> None:
        self.held = self.top

    def ahead(self) -> list[float]:
        """All prices that the next ``AHEAD`` halvings can try."""
        ranges, found = [(self.fails, self.held)], []
        for _ in range(min(AHEAD, STEPS - self.steps)):
            middles = [low + (high - low) / 2 for low, high in ranges]
            found += middles
            ranges = [r for (low, high), m in zip(ranges, middles, strict=True) for r in ((low, m), (m, high))]
        return found

    def go(self, holds: Callable[[float], bool]) -> None:
        """The next ``AHEAD`` halvings."""
        for _ in range(min(AHEAD, STEPS - self.steps)):
            trial = self.fails + (self.held - self.fails) / 2
            if holds(trial):
                self.held = trial
            else:
                self.fails = trial
            self.steps += 1


def search(hist: DataFrame, tops: DataFrame, limits: Constraints) -> Calibration:
    """The best prices that keep the limits: each price is the least that keeps its own, given those outside it.

    For a price of cost, the deep price is the least that keeps the number of deep nodes, and for
    both the depth price is the least that keeps the depth.  Of the trials for the cost price that
    keep the cost, the one with the largest gain is taken.  Whether a depth is used depends on its largest
    potential alone, so ``tops`` has a row for each depth beyond the limit.  ``iterations`` counts the
    trials of all three prices that lead to the result.
    """
    found, too_deep = Calibration(skip_all=True), not tops.isEmpty()

    def below(pairs: list[tuple[float, float]]) -> list[tuple[float, bool]]:
        return depth_prices(tops, pairs) if too_deep and pairs else [(TOP_DEPTH / 2**STEPS, True)] * len(pairs)

    def summed(prices: list[Prices]) -> list[tuple[float, float, int]]:
        rows = sorted(sums_by_price(hist, prices).collect(), key=lambda r: r["price"])
        return [(r["gain"], r["cost"], r["tier3"]) for r in rows] or [(0.0, 0.0, 0)] * len(prices)

    def inner(costs: list[float]) -> tuple[dict[float, tuple[float, float, bool]], dict[float, int]]:
        """For each price of cost the other two, and whether the depth is kept; and the trials of them."""
        deep, known = {c: Halving(TOP_TIER3) for c in costs}, {}
        while any(x.steps < STEPS for x in deep.values()):
            pairs = [(c, t) for c, x in deep.items() for t in x.ahead()]
            known |= dict(zip(pairs, below(pairs), strict=True))
            counts = dict(zip(pairs, summed([(c, known[c, t][0], t) for c, t in pairs]), strict=True))
            for c, x in deep.items():
                x.go(lambda t: counts[c, t][2] <= limits.max_tier3)  # noqa: B023
        last = [(c, x.held) for c, x in deep.items() if (c, x.held) not in known]
        known |= dict(zip(last, below(last), strict=True))
        return {c: (known[c, x.held][0], x.held, known[c, x.held][1]) for c, x in deep.items()}, {c: x.steps * STEPS for c, x in deep.items()}

    outer = Halving(TOP_COST)
    while outer.steps < STEPS:
        costs = outer.ahead()
        others, trials = inner(costs)
        sums = dict(zip(costs, summed([(c, *others[c][:2]) for c in costs]), strict=True))

        def keeps_cost(c: float) -> bool:
            nonlocal found
            (d, t, shallow), (gain, cost, deep) = others[c], sums[c]  # noqa: B023
            found.iterations += trials[c]  # noqa: B023
            if cost <= limits.max_cost and gain > found.total_gain:
                found = replace(found, lambda_cost=c, lambda_depth=d, lambda_tier3=t, total_gain=gain, total_cost=cost, tier3=deep, feasible=deep <= limits.max_tier3 and shallow, skip_all=False)
            return cost <= limits.max_cost

        outer.go(keeps_cost)
    return found


def lambda_grid(tree: DataFrame, limits: Constraints) -> DataFrame:
    """Gain, cost and deep nodes under each of 11**3 prices.  Feasible rows only; depth isn't limited."""
    steps = [(i, j, k) for i in range(GRID + 1) for j in range(GRID + 1) for k in range(GRID + 1)]
    prices = [(TOP_COST * i / GRID, TOP_DEPTH * k / GRID, TOP_TIER3 * j / GRID) for i, j, k in steps]
    names = tree.sparkSession.createDataFrame([(at, *s, c, t, d) for at, (s, (c, d, t)) in enumerate(zip(steps, prices, strict=True))], "price int, i int, j int, k int, lambda_cost double, lambda_tier3 double, lambda_depth double")
    found = sums_by_price(pairs_of(tree), prices).where((F.col("cost") <= limits.max_cost) & (F.col("tier3") <= limits.max_tier3))
    return found.join(F.broadcast(names), "price").drop("price")


def grid_search(tree: DataFrame, limits: Constraints) -> Calibration:
    """The first of the best feasible prices of the grid."""
    best = lambda_grid(tree, limits).orderBy(F.desc("gain"), "i", "j", "k").first()
    if best is None:
        return Calibration(iterations=(GRID + 1) ** 3, heterogeneous=True, skip_all=True)
    return Calibration(best["lambda_cost"], best["lambda_depth"], best["lambda_tier3"], max(best["gain"], 0.0), best["cost"], best["tier3"], (GRID + 1) ** 3, True)


def optimise(tree: DataFrame, limits: Constraints | None = None) -> tuple[Calibration, DataFrame]:
    """The prices, and the tree with its tiers: a grid where half-lives vary, else bisection."""
    limits = limits or Constraints()
    if heterogeneous(tree).first()["heterogeneous"]:
        found = grid_search(tree, limits)
    else:
        with scratch(tree.sparkSession):
            hist = written(pairs_of(tree), "histogram")
            tops = written(hist.where(F.col("depth") > limits.max_depth).groupBy("depth").agg(F.max("p").alias("p")), "depths")
            found = search(hist, tops, limits)
    if found.skip_all:
        tiers = tree.withColumns({"tier": F.lit("skip"), "gain": F.lit(0.0), "cost": F.lit(0.0)})
    else:
        tiers = solve(tree, found.lambda_cost, found.lambda_depth, found.lambda_tier3)
    return found, tiers


def traverse(tiers: DataFrame, edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, cid, depth, tier, gain, cost, pruned``: the walk down that the tiers allow.

    Nodes without a tier are skipped; a skipped or missing node is pruned with what hangs below.
    """
    stored = nodes.select("cid", F.lit(True).alias("stored")).dropDuplicates(["cid"])
    known = tiers.select("cid", "tier", "info_potential")
    down = edges.select(F.col("parent_cid").alias("cid"), F.col("child_cid").alias("next"))
    front = roots.select(F.col("cid").alias("root"), "cid", F.lit(0).alias("depth")).distinct()
    visited, depth = None, 0
    while True:
        level = front.join(known, "cid", "left").join(stored, "cid", "left")
        t = F.coalesce("tier", F.lit("skip"))
        pruned = (t == "skip") | F.col("stored").isNull()
        gain = F.when(~pruned, F.col("info_potential") * tier_gain(t)).otherwise(0.0)
        level = written(level.select("root", "cid", "depth", t.alias("tier"), gain.alias("gain"), F.when(~pruned, tier_cost(t)).otherwise(0.0).alias("cost"), pruned.alias("pruned")), "hits")
        if level.isEmpty():
            return level if visited is None else visited
        visited = level if visited is None else visited.union(level)
        depth += 1
        front = level.where("NOT pruned").join(down, "cid").select("root", F.col("next").alias("cid"), F.lit(depth).alias("depth")).distinct().join(visited.select("root", "cid"), ["root", "cid"], "left_anti")


def traversal_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("root").agg(F.sum("gain").alias("total_gain"), F.sum("cost").alias("total_cost"), F.count_if("pruned").alias("pruned_count"))


def potentials(tree: DataFrame, dag_nodes: DataFrame, mean_scores: DataFrame) -> DataFrame:
    """The tree with ``info_potential`` from saturations and scores."""
    from ..functions.nodes import potential

    return (
        tree.join(dag_nodes.select("cid", "saturation"), "cid", "left").join(mean_scores.withColumnRenamed("node_cid", "cid"), "cid", "left")
        .withColumn("info_potential", potential(F.col("saturation"), F.col("mean_score"))).drop("saturation", "mean_score")
    )


def inspect(calibrations: DataFrame, address: str) -> DataFrame:
    return calibrations.where(F.col("cid") == address)


def history(calibrations: DataFrame, root: str) -> DataFrame:
    return calibrations.where(F.col("root_cid") == root).orderBy("ts")
