"""Walks by levels and along chains against a plain breadth-first search."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from veinstone.operators import graph


def plain(starts, edges, most=None):
    out_of = defaultdict(set)
    for a, b in edges:
        out_of[a].add(b)
    found = set()
    for start in set(starts):
        depth, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            if most is not None and depth[at] == most:
                continue
            for b in out_of[at]:
                if b not in depth:
                    depth[b] = depth[at] + 1
                    queue.append(b)
        found |= {(start, node, d) for node, d in depth.items()}
    return found


def walked(spark, starts, edges, most=None):
    rows = graph.walk(spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame(edges, "src string, dst string"), most).collect()
    assert len(rows) == len({(r["start"], r["cid"]) for r in rows})
    return {(r["start"], r["cid"], r["depth"]) for r in rows}


def ladder(n):
    """Two rails with rungs both ways up, so that every node has two parents."""
    return [(f"{a}{i:03}", f"{b}{i + 1:03}") for i in range(n) for a in "ab" for b in "ab"]


def shapes():
    rng = random.Random(21)
    name = lambda i: f"n{i:03}"
    dag = [(name(i), name(j)) for i in range(120) for j in rng.sample(range(i + 1, min(i + 9, 125)), min(3, 124 - i)) if rng.random() < 0.6]
    cyclic = dag + [(name(90), name(3)), (name(40), name(40)), (name(100), name(99)), (name(99), name(100))]
    ring = [(name(i), name((i + 1) % 30)) for i in range(30)]
    forks = [(name(i), name(i + 1)) for i in range(60)] + [(f"x{i}", name(i)) for i in range(60)] + [(name(10), name(50)), (name(2), "x59"), ("x59", "y"), ("y", name(1))]
    return {"dag": (dag, [name(0), name(0), name(7), name(60), "absent"]), "cyclic": (cyclic + cyclic[:5], [name(0), name(95)]), "ring": (ring, [name(4)]), "ladder": (ladder(40), ["a000", "b003"]), "forks": (forks, ["x0", "x3", "x59", name(59)])}


@pytest.mark.parametrize("shape, near, most", [*((s, 1, None) for s in ("cyclic", "ring", "ladder", "forks")), ("dag", 4, None), ("forks", 2, 7), ("cyclic", 4, 2)])
def test_walk_equals_breadth_first_search(spark, monkeypatch, shape, near, most):
    monkeypatch.setattr(graph, "NEAR", near)
    edges, starts = shapes()[shape]
    assert walked(spark, starts, edges, most) == plain(starts, edges, most)


def test_chains_are_paths_that_cover_all_nodes(spark):
    edges, _ = shapes()["cyclic"]
    labels, _ = graph.chains(spark.createDataFrame(edges, "src string, dst string"))
    rows = [tuple(r) for r in labels.collect()]
    assert sorted(r[0] for r in rows) == sorted({x for e in edges for x in e})
    by, there = defaultdict(dict), set(edges)
    for cid, chain, place in rows:
        assert place not in by[chain]
        by[chain][place] = cid
    for chain, places in by.items():
        assert places[0] == chain and sorted(places) == list(range(len(places)))
        assert all((places[i + 1], places[i]) in there for i in range(len(places) - 1))


def test_a_path_of_10000_nodes_takes_logarithmic_rounds(spark):
    edges = spark.range(10_000).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"))
    labels, rounds = graph.chains(edges)
    assert rounds <= 15 and labels.agg(F.max("place")).first()[0] == 10_000
    found = graph.walk(spark.createDataFrame([("n00000",), ("n09990",)], "start string"), edges)
    got = {r["start"]: (r["n"], r["deepest"], r["sum"]) for r in found.groupBy("start").agg(F.count("cid").alias("n"), F.max("depth").alias("deepest"), F.sum(F.col("depth") + F.substring("cid", 2, 5).cast("int")).alias("sum")).collect()}
    assert got["n09990"] == (11, 10, sum(range(9990, 10_001)) + sum(range(11)))
    assert got["n00000"] == (10_001, 10_000, 2 * sum(range(10_001)))


def test_many_roots_take_the_rounds_of_one(spark, monkeypatch):
    """All roots go along in one frontier, so jobs don't follow their number."""
    edges = spark.createDataFrame([(f"n{i:04}", f"n{i // 3:04}") for i in range(1, 1200)] + [(f"n{i:04}", f"n{i - 7:04}") for i in range(7, 1200, 11)], "src string, dst string")
    tables, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what, **more: (tables.append(what), real(df, what, **more))[1])
    rounds, found = [], {}
    for starts in (["n1199"], [f"n{i:04}" for i in range(200, 1200)]):
        tables.clear()
        found = graph.walk(spark.createDataFrame([(s,) for s in starts], "start string"), edges)
        rounds.append(len(tables))
    assert rounds[1] < 2 * rounds[0] and found.select("start").distinct().count() == 1000
