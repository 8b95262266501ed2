"""Stores, nodes, graphs, audits, allocation, services: the scenarios of the data model."""

import io
import json
import math
import os
import random
import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinstone import cli, versions
from veinstone import store as store_module
from veinstone.functions import address
from veinstone.functions import nodes as N
from veinstone.operators import allocate, blobs, graph, projection, scores, symbols
from veinstone.operators.allocate import Constraints
from veinstone.service import InvalidParams, Service, decay_params, descriptors, saturation_param
from veinstone.sources import oplog
from veinstone.streaming import logstream
from veinstone.versions import Versions
from veinstone.workspace import Dag, NotFound, Store, Workspace

TS = "2026-01-01T00:00:00+00:00"


@pytest.fixture
def store(spark, tmp_path):
    return Store.init(spark, f"{tmp_path}/cas")


@pytest.fixture
def work(spark, tmp_path):
    return Workspace.init(spark, f"{tmp_path}/home")


def test_blake3_vectors():
    assert address.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert address.blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    data = bytes(i % 251 for i in range(2049))
    assert address.blake3(data)[:16] == "5f4d72f40d7a5f82"
    assert address.blake3(data[:1025])[:16] == "d00278ae47eb27b3"


def test_blake3_column(spark):
    df = spark.createDataFrame([("x",), (None,)], "s string").select(address.cid(F.col("s"), "blake3").alias("c"))
    assert {r["c"] for r in df.collect()} == {address.blake3(b"x"), None}


def test_store(store, tmp_path, spark):
    a = store.put(b"hello world")
    assert len(a) == 64 and store.get(a) == b"hello world" and store.put("hello world") == a and store.list() == [a]
    assert store.verify(a) and store.exists(a) and store.blob_size(a) == 11 and store.total_size() == 11
    with pytest.raises(NotFound):
        store.get("0" * 64)
    (tmp_path / "f").write_bytes(b"file")
    b = store.put_file(f"{tmp_path}/f")
    assert b == address.hash_file(f"{tmp_path}/f") and sorted([a, b]) == store.list()
    assert store.delete(a) and not store.delete(a) and store.list() == [b]
    new = store.put_df(spark.createDataFrame([("file",), ("x",), ("x",), (None,)], "s string"), "s")
    assert [r["cid"] for r in new.collect()] == [address.hash_bytes(b"x")]
    store._append(spark.createDataFrame([("f" * 64, bytearray(b"bad"), 3)], "cid string, data binary, size long"))
    assert not store.verify("f" * 64)


def test_store_must_be_initialised(spark, tmp_path):
    with pytest.raises(NotFound):
        Store(spark, f"{tmp_path}/none")


def test_nodes_are_what_parses(spark):
    good = {"kind": "memory", "parents": ["p"], "output_cid": "o", "agent": "a", "timestamp": TS, "meta": [["k", "1"], ["k", "2"]], "more": 1}
    rows = [json.dumps(good), json.dumps(good | {"agent": 5}), json.dumps(good | {"kind": "other"}), json.dumps({k: v for k, v in good.items() if k != "meta"}), "text", "", None, "{", "5", json.dumps(good | {"parents": [None]})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", N.parse(F.col("s").cast("binary")).alias("n")).union(spark.sql("select 99, null") .select(F.lit(99), N.parse(F.unhex(F.lit("ff00"))).alias("n")))
    got = {r["i"]: r["n"] for r in df.collect()}
    assert got[0]["meta"] == [["k", "1"], ["k", "2"]] and all(got[i] is None for i in got if i != 0)
    first = spark.createDataFrame([([["k", "1"], ["k", "2"]],)], "m array<array<string>>").select(N.meta_get(F.col("m"), "k"), N.meta_get(F.col("m"), "z")).first()
    assert tuple(first) == ("1", None)


def test_default_kinds_leave_no_trace(store):
    dag = Dag(store)
    plain = dag.build("reasoning", ["p0", "p1"], "o", "a", timestamp=TS)
    assert dag.build("reasoning", ["p0", "p1"], "o", "a", timestamp=TS, parent_kinds=["derives", "unknown"]) == plain
    mixed = dag.build("reasoning", ["p0", "p1"], "o", "a", timestamp=TS, parent_kinds=["grounds", "derives"])
    assert mixed != plain
    cid = dag.put_node(mixed)
    edges = {(r["parent_cid"], r["ordinal"], r["edge_kind"]) for r in graph.edges_of(dag.nodes()).collect()}
    assert edges == {("p0", 0, "grounds"), ("p1", 1, "derives")} and dag.get_node(cid)["parents"] == ["p0", "p1"]
    with pytest.raises(ValueError, match="one length"):
        dag.build("reasoning", ["p"], "o", "a", parent_kinds=["derives", "derives"])
    with pytest.raises(ValueError, match="kind"):
        dag.build("nonsense", [], "o", "a")


def test_saturation_and_decay(spark):
    df = spark.createDataFrame([(None,), ("0",), ("1",), ("0.75",), ("2",), ("-0.5",), ("x",), ("NaN",)], "s string")
    m = F.when(F.col("s").isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("saturation"), "s")))
    s = N.saturation(m)
    got = [tuple(r) for r in df.select(s, N.is_claim(s), N.is_query(s)).collect()]
    assert got == [(None, False, True), (0, False, True), (1, True, False), (0.75, False, False), (1, True, False), (0, False, True), (None, False, True), (None, False, True)]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (0.75,), (3.0,)], "x double").select(N.saturation_text(F.col("x"))).collect()] == ["1", "0.75", "1"]
    cases = [(2.0, 60.0, 0.1, 60.0, 1.0), (2.0, 60.0, 1.5, 60.0, 1.5), (2.0, None, 3.0, 9.0, 3.0), (2.0, float("inf"), 0.0, 9.0, 2.0), (2.0, -1.0, 0.0, 9.0, 2.0), (1.0, 60.0, 0.0, -60.0, 2.0)]
    rows = spark.createDataFrame(cases, "a double, h double, f double, t double, w double").select(N.decay(F.col("a"), F.col("h"), F.col("f"), F.col("t")).alias("x"), "w").collect()
    assert all(abs(r["x"] - r["w"]) < 1e-12 for r in rows)


def chain(work, n):
    out = []
    for i in range(n):
        out.append(work.dag.store(f"content {i}", "memory", out[-1:] and [out[-1][0]], "human", timestamp=f"2026-01-0{i + 1}")[:2])
    return [x[0] for x in out]


def test_lineage_bundle_and_merge(work, spark, tmp_path):
    c = chain(work, 4)
    for bound, n in ((0, 1), (1, 2), (2, 3), (None, 4), (9, 4)):
        assert work.dag.lineage(c[3], bound).count() == n
    assert [r["cid"] for r in work.dag.lineage(c[2]).collect()] == c[2::-1]
    other = Workspace.init(spark, f"{tmp_path}/other")
    text = work.dag.export(c[1])
    assert other.dag.import_bundle(text) == 4 and other.dag.import_bundle(text) == 0 and other.dag.lineage(c[1]).count() == 2
    broken = json.loads(text)
    broken["entries"][0]["output_bytes"] = "AAAA"
    with pytest.raises(Exception, match="match"):
        Workspace.init(spark, f"{tmp_path}/third").dag.import_bundle(json.dumps(broken))
    m = work.merge("both", [c[0], c[3]], "human")
    assert work.dag.lineage(m, 1).count() == 3
    with pytest.raises(ValueError):
        work.merge("one", [c[0]], "human")
    dangling = work.dag.put_node(work.dag.build("memory", ["0" * 64, c[0]], "f" * 64, "a"))
    assert work.dag.lineage(dangling).count() == 2
    with pytest.raises(Exception, match="missing output"):
        work.dag.export(dangling)


def test_walk_on_random_graphs(spark):
    rng = random.Random(11)
    for _ in range(3):
        n = 25
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(45)]
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
        want = set()
        for s in range(0, n, 4):
            seen, front, depth = {f"n{s}": 0}, [f"n{s}"], 0
            while front:
                depth += 1
                front = [y for x in front for y in near.get(x, ()) if y not in seen and not seen.update({y: depth})]
            want |= {(f"n{s}", k, v) for k, v in seen.items()}
        got = graph.walk(spark.createDataFrame([(f"n{s}",) for s in range(0, n, 4)], "start string"), spark.createDataFrame(edges, "src string, dst string"))
        assert {tuple(r) for r in got.collect()} == want


def test_edge_differences(spark):
    schema = "parent_cid string, child_cid string, ordinal int, edge_kind string"
    expected = spark.createDataFrame([("a", "c", 0, "grounds"), ("b", "c", 1, "derives"), ("d", "e", 0, "derives")], schema)
    actual = spark.createDataFrame([("a", "c", 0, "derives"), ("b", "c", 1, "derives"), ("x", "y", 0, "derives")], schema)
    assert {tuple(r) for r in projection.diff_edges(expected, actual).collect()} == {("d", "e", "missing"), ("x", "y", "extra"), ("a", "c", "mismatched")}
    assert projection.diff_edges(expected, expected).isEmpty()


def test_repeated_parents_keep_the_first(spark):
    nodes = spark.createDataFrame([("c", ["p", "q", "p"], ["grounds", "derives", "proposes"])], "cid string, parents array<string>, parent_kinds array<string>")
    assert {tuple(r) for r in graph.edges_of(nodes).collect()} == {("p", "c", 0, "grounds"), ("q", "c", 1, "derives")}


def test_projection_cycle(work):
    c = chain(work, 2)
    assert work.repair(dry_run=True) == {"synced": 2, "skipped": 0, "errors": 0}
    assert work.repair()["synced"] == 2 and work.repair() == {"synced": 0, "skipped": 2, "errors": 0}
    assert work.verify_projection()[1] == 0
    first = work.rebuild_projection()
    assert work.rebuild_projection() == {"purged": first["written"], "written": first["written"]} and first["written"] == 1
    extra = work.rows("dag_edges", [("x", "y", 0, "derives")])
    work.versions.commit({"dag_edges": work.table("dag_edges").unionByName(extra)}, "spoil")
    assert work.verify_projection()[1] == 1
    assert projection.below_saturation(work.table("dag_nodes"), 0.5).isEmpty() and projection.open_queries(work.table("dag_nodes")).count() == 2
    assert {r["cid"] for r in graph.roots(work.table("dag_nodes"), work.table("dag_edges")).collect()} == {c[0]}
    with pytest.raises(ValueError, match="duplicate"):
        projection.insert(work.table("dag_nodes"), work.table("dag_nodes").limit(1), ["cid"])


def test_garbage_snapshots_drift_and_search(work, tmp_path):
    work.store.put("nobody refers to me")
    c = chain(work, 1)
    assert work.cas_stats() == {"total": 3, "bytes": work.store.total_size(), "nodes": 1, "content": 1, "orphan": 1}
    assert work.snapshot("v1") == 1 and work.verify_snapshot("v1") == {"name": "v1", "present": 2, "missing": 0, "corrupted": 0, "ok": True}
    assert work.gc()["orphans"] == 1 and work.gc(delete=True)["orphans"] == 1 and work.gc()["orphans"] == 0
    assert work.verify_snapshot("v1")["ok"]
    file = tmp_path / "a.md"
    file.write_text("original")
    cid = work.track(str(file))
    assert [r["status"] for r in work.drift()] == ["OK"] and not work.dag.check_drift(str(file), cid)
    file.write_text("modified")
    assert [r["status"] for r in work.drift()] == ["DRIFTED"] and work.dag.check_drift(str(file), cid)
    file.unlink()
    assert [r["status"] for r in work.drift()] == ["MISSING"]
    work.untrack(str(file))
    assert work.drift() == []
    work.store.put("one\nthe quick brown fox jumps over the lazy dog\nthree")
    work.store.put(b"\xff\xfequick brown")
    assert [(r["line_no"], r["line"]) for r in graph.search_lines(work.store.df(), "Quick Brown").collect()] == [(2, "the quick brown fox jumps over the lazy dog")]
    text = "\n".join(r["line"] for r in graph.dot(work.dag.nodes(), graph.edges_of(work.dag.nodes())).collect())
    assert "rankdir=BT" in text and c[0][:12] in text
    assert work.status()["tables"]["dag_nodes"] == 0


def tree_chain(spark, n, p=1.0):
    return spark.createDataFrame([(f"{i:064x}", i, p, None) for i in range(n)], "cid string, depth int, info_potential double, half_life_secs double")


def totals(df):
    r = df.agg(F.sum("gain"), F.sum("cost"), F.count_if(F.col("tier") == "deep"), F.count_if(F.col("tier") == "skip")).first()
    return tuple(r)


def test_allocation_under_fixed_prices(spark):
    assert totals(allocate.solve(tree_chain(spark, 3), 0.0, 0.0, 0.0)) == (3.0, 12.0, 3, 0)
    assert totals(allocate.solve(tree_chain(spark, 3), 100.0, 0.0, 0.0))[1:] == (0.0, 0, 3)
    assert totals(allocate.solve(tree_chain(spark, 10), 0.01, 0.0, 0.0))[1] >= totals(allocate.solve(tree_chain(spark, 10), 5.0, 0.0, 0.0))[1]
    assert allocate.solve(tree_chain(spark, 5), 0.0, 5.0, 0.0).where("depth >= 3 AND tier <> 'skip'").isEmpty()


def test_allocation_by_bisection(spark):
    found, tiers = allocate.optimise(tree_chain(spark, 5), Constraints(100, 10, 5))
    assert tiers.count() == 5 and found.total_gain > 0 and found.iterations == 8000
    _, tight = allocate.optimise(tree_chain(spark, 5), Constraints(2, 10, 0))
    assert totals(tight)[1] <= 2.01 and totals(tight)[3] >= 1
    loose, tiers = allocate.optimise(tree_chain(spark, 5), Constraints(1000, 100, 100))
    assert totals(tiers)[2] == 5 and loose.feasible
    a, b = (allocate.optimise(tree_chain(spark, 5), Constraints(10, 5, 2)) for _ in range(2))
    assert a[0] == b[0] and totals(a[1]) == totals(b[1])
    gain, cost, deep, _ = totals(a[1])
    assert abs(gain - a[0].total_gain) < 1e-9 and cost == a[0].total_cost and deep == a[0].tier3
    diamond = spark.createDataFrame([("a", 0, 1.0, None), ("b", 1, 0.8, None), ("c", 1, 0.6, None), ("d", 2, 0.9, None)], tree_chain(spark, 1).schema)
    assert allocate.optimise(diamond)[1].count() == 4


def test_allocation_by_search_equals_plain_trials(spark, monkeypatch):
    """Every price is the least on its grid of halvings that keeps its limit, by trying on all nodes, however far jobs look ahead."""
    monkeypatch.setattr(allocate, "STEPS", 4)
    rows = [(f"{i}", i % 6, ((i * 7919) % 100) / (40 if i % 6 > 3 else 10), None) for i in range(60)]
    tree = spark.createDataFrame(rows, tree_chain(spark, 1).schema)
    limits = Constraints(60, 3, 7)

    def tried(top, holds):
        grid = [top * i / 16 for i in range(1, 16)]
        return next((x for x in grid if holds(x)), top)

    def plain(c, d, t):
        gain = cost = deep = depth = 0
        for _, at, p, _ in rows:
            worth = [0, 0.3 * p - c - d * at, 0.7 * p - 2 * c - d * at, p - 4 * c - d * at - t]
            tier = worth.index(max(worth))
            gain, cost, deep, depth = gain + p * (0, 0.3, 0.7, 1)[tier], cost + (0, 1, 2, 4)[tier], deep + (tier == 3), max(depth, at if tier else 0)
        return gain, cost, deep, depth

    def prices(c):
        of = lambda t: tried(1.0, lambda d: plain(c, d, t)[3] <= 3)
        t = tried(10.0, lambda t: plain(c, of(t), t)[2] <= 7)
        return c, of(t), t

    c, d, t = prices(tried(10.0, lambda c: plain(*prices(c))[1] <= 60))
    gain, cost, deep, depth = plain(c, d, t)
    for ahead in (1, 3):
        monkeypatch.setattr(allocate, "AHEAD", ahead)
        found, tiers = allocate.optimise(tree, limits)
        assert (found.lambda_cost, found.lambda_depth, found.lambda_tier3) == (c, d, t) and found.feasible
        assert abs(found.total_gain - gain) < 1e-9 and (found.total_cost, found.tier3) == (cost, deep) and depth <= 3 and found.iterations == 4**3
        assert abs(totals(tiers)[0] - gain) < 1e-9 and totals(tiers)[1:3] == (cost, deep)


def test_gains_are_summed_alike_however_they_are_dealt(spark):
    rng = random.Random(3)
    rows = [(rng.random() * 10 ** rng.randint(-6, 3), rng.randrange(9), rng.randrange(1, 10**6)) for _ in range(500)]
    prices = [(0.01, 0.001, 0.05), (0.3, 0.0, 0.0), (0.0, 0.0, 9.0)]
    tables = [spark.createDataFrame(rng.sample(rows, len(rows)), "p double, depth int, n long").repartition(n) for n in (1, 3, 7)]
    sums = [sorted(map(tuple, allocate.sums_by_price(t, prices).collect())) for t in tables]
    assert sums[0] == sums[1] == sums[2]
    for (_, gain, _, _), x in zip(sums[0], prices, strict=True):
        p, depth, n = (np.array(c) for c in zip(*rows, strict=True))
        want = math.fsum(p * np.array([0, 0.3, 0.7, 1.0])[allocate.tiers_of(p, depth, x)[0]] * n)
        assert abs(gain - want) <= 1e-12 * want + 1e-3


def test_allocation_by_grid(spark):
    rows = [(f"{i}", i % 3, 0.5 + 0.1 * (i % 5), float(10 ** (i % 4))) for i in range(20)]
    tree = spark.createDataFrame(rows, tree_chain(spark, 1).schema)
    assert allocate.heterogeneous(tree).first()[0] and not allocate.heterogeneous(tree_chain(spark, 5)).first()[0]
    found, tiers = allocate.optimise(tree, Constraints(30, 9, 4))
    p, depth, best = np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), (-1.0,)
    for i in range(11):
        for j in range(11):
            for k in range(11):
                tier, _ = allocate.tiers_of(p, depth, (10.0 * i / 10, k / 10, 10.0 * j / 10))
                g, c, deep = (p * np.array([0, 0.3, 0.7, 1.0])[tier]).sum(), np.array([0, 1, 2, 4])[tier].sum(), (tier == 3).sum()
                if c <= 30 and deep <= 4 and g > best[0] + 1e-12:
                    best = (g, c, i, j, k)
    assert abs(found.total_gain - best[0]) < 1e-9 and found.heterogeneous and found.iterations == 1331
    assert totals(tiers)[1] == found.total_cost


def test_calibrate_and_traverse(work):
    root, _ = work.create("root", "memory", [], "human")
    kids = [work.create(f"kid {i}", "memory", [root], "human", saturation=s)[0] for i, s in enumerate((1.0, 0.0))]
    node, result = work.calibrate(root, Constraints(6, 10, 1))
    assert set(result["allocated_tiers"]) == {root, *kids} and result["allocated_tiers"][kids[0]] == "skip"
    hits = {r["cid"]: r for r in work.traverse(root, node).collect()}
    assert hits[kids[0]]["pruned"] and not hits[root]["pruned"]
    assert allocate.history(work.table("calibrations"), root).count() == 1 and allocate.inspect(work.table("calibrations"), node).count() == 1


def test_symbols():
    names = {(s[0], s[1]) for s in symbols.rust_symbols("fn hello() {}\nstruct Foo { x: i32 }\nimpl Foo { fn method(&self) {} }\nenum Color { A }\n")}
    assert {("hello", "function"), ("Foo", "struct"), ("Foo", "impl"), ("method", "function"), ("Color", "enum")} == names
    broken = list(symbols.python_symbols("class A:\n    def f(self):\n        pass\n\ndef g(:\n"))
    assert [(s[0], s[1]) for s in broken] == [("A", "class"), ("f", "method")]
    assert list(symbols.symbols(None, "rust")) == [] and list(symbols.symbols("x", None)) == [] and list(symbols.rust_symbols("fn")) == []


def test_scan(work, tmp_path):
    src = tmp_path / "src"
    (src / "target").mkdir(parents=True)
    (src / ".git").mkdir()
    (src / "example.py").write_text("class UserProfile:\n    def __init__(self):\n        pass\n    def greet(self):\n        pass\n\ndef process_data():\n    pass\n")
    (src / "target" / "x.py").write_text("def no(): pass\n")
    (src / ".git" / "y.py").write_text("def no(): pass\n")
    assert work.scan(str(src)) == 4 and work.scan(str(src)) == 4
    found = work.table("cdom_symbols")
    assert found.count() == 4 and projection.search_symbols(found, "User").first()["kind"] == "class"
    assert projection.symbols_by_kind(found, "method").count() == 2 and projection.symbols_in_file(found, f"{src}/example.py").count() == 4


def test_scores(work, spark):
    work.score("n", "a", "s", "Correctness", 0.5)
    for bad in (("nonsense", 0.5), ("style", 1.5), ("style", float("nan"))):
        with pytest.raises(Exception):
            work.score("n", "a", "s", *bad)
    rows = spark.createDataFrame([("n", "a", "build", 0, "", TS), ("n", "a", "test", 1, "\n".join("abcdefg"), TS), ("n", "a", "lint", 1, "w", TS), ("n", "a", "else", 0, "", TS)], "node_cid string, agent string, step string, exit_code int, stderr string, created_at string")
    got = {r["dimension"]: (round(r["value"], 3), r["evidence"]) for r in scores.auto_scores(rows).collect()}
    assert got == {"correctness": (1.0, "build passed"), "completeness": (0.0, "a; b; c; d; e"), "style": (0.3, "w")}


def test_parameters():
    assert saturation_param({}) is None and saturation_param({"saturation": None}) is None and saturation_param({"saturation": 0.5}) == 0.5
    for bad in (-0.1, 1.1, 2, "0.5", True, float("nan")):
        with pytest.raises(InvalidParams):
            saturation_param({"saturation": bad})
    assert decay_params({}) is None and decay_params({"activation": 2}) is None and decay_params({"half_life_secs": 60}) == (1.0, 60.0, 0.0)
    assert decay_params({"half_life_secs": 120, "activation": 2.5, "activation_floor": 0.1}) == (2.5, 120.0, 0.1)
    for bad in ({"half_life_secs": 0}, {"half_life_secs": -1}, {"half_life_secs": "60"}, {"half_life_secs": True}, {"half_life_secs": 60, "activation": -0.5}, {"half_life_secs": 60, "activation": 0.5, "activation_floor": 0.6}):
        with pytest.raises(InvalidParams):
            decay_params(bad)


def test_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    with open(path, "w") as f:
        f.write("2026-01-01T00:00:00Z | put | a.md -> aaaa")
    oplog.append(path, "put", "b.md -> bbbb")
    oplog.append(path, "put", "a.md -> cc | cc")
    text = open(path).read()
    assert text.count("\n") == 3 and text.endswith("\n") and "\n\n" not in text
    with open(path, "a") as f:
        f.write("broken\n\n")
    lines = oplog.read(spark, f"file://{path}")
    assert [r["detail"] for r in oplog.tail(lines, 2).collect()] == ["a.md -> cc | cc"]
    assert {tuple(r) for r in oplog.heads(oplog.parse(lines)).collect()} == {("a.md", "cc | cc"), ("b.md", "bbbb")}


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("2026-01-01T00:00:00Z | put | a -> 1\n2026-01-01T00:10:00Z | put | a -> 2\nbroken\n2026-01-01T01:00:00Z | gc | 0\n")
    q = logstream.start(logstream.head_stream(logstream.lines(spark, f"{tmp_path}/in")), "heads", checkpoint=f"file://{tmp_path}/c1")
    q.awaitTermination(60)
    assert [tuple(r)[:2] for r in spark.table("heads").collect()] == [("a", "2")]
    q = logstream.start(logstream.event_counts(logstream.lines(spark, f"{tmp_path}/in")), "counts", checkpoint=f"file://{tmp_path}/c2")
    q.awaitTermination(60)
    assert {(r["event"], r["n"]) for r in spark.table("counts").collect()} == {("put", 2), ("gc", 1)}


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    one = v.commit({"t": spark.range(3), "u": spark.range(1)}, "first")
    two = v.commit({"t": spark.range(1, 4)}, "second")
    assert v.head() == two and [x["message"] for x in v.log()] == ["second", "first"] and v.table("u", two).count() == 1
    assert {tuple(r) for r in v.diff("t", one, two).collect()} == {(0, "-"), (3, "+")}
    v.branch("side", one)
    three = v.commit({"t": spark.range(9)}, "aside", "side")
    assert v.branches() == ["main", "side"] and v.table("t", branch="side").count() == 9 and v.head() == two and v.manifest(three)["parent"] == one
    assert v.sql("SELECT count(*) AS n FROM t WHERE id >= :low", args={"low": 2}).first()["n"] == 2 and v.sql("SELECT count(*) AS n FROM t", one).first()["n"] == 3
    with pytest.raises(ValueError):
        v.manifest(77)


def test_service(work):
    s = Service(work)
    assert len(descriptors()) == 19 and s.handle({"id": 1, "method": "initialize"})["result"]["protocolVersion"] == "2024-11-05"
    call = lambda name, **p: json.loads(s.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": p}})["result"]["content"][0]["text"])
    cid = call("put", content="hello")["cid"]
    assert call("get", cid=cid) == {"content": "hello"} and call("verify", cid=cid) == {"valid": True}
    node = call("dag_link", content="x", kind="memory", agent="a", parents=["p", 5], edge_kind="grounds", saturation=0.5, half_life_secs=60, activation=2.0, schema_cid="s")
    assert call("decay_status", cid=node["node_cid"], elapsed_secs=60)["decayed_activation"] == 1.0
    assert call("get_reasoning", cid=node["node_cid"])["content"] == "x" and call("get_reasoning", cid=cid) == {"content": "hello"}
    child = call("store_reasoning", content="y", agent="a", parents=[node["node_cid"]])["node_cid"]
    assert [n["cid"] for n in call("dag_lineage", cid=child)["lineage"]] == [child, node["node_cid"]]
    assert call("schema_stats", schema_cid="s") == {"total_nodes": 1, "unique_outputs": 1, "dedup_ratio": "1.00"} and call("schema_stats", schema_cid="t")["dedup_ratio"] == "N/A"
    assert len(call("dag_ls", limit=1)["nodes"]) == 1 and call("search", query="HELL")["results"][0]["cid"] == cid and call("status")["dag_nodes"] == 2
    assert call("score", node_cid=child, agent="a", scorer="s", dimension="style", value=0.4) == {"recorded": True}
    assert call("soft_link", from_cid="a", to_cid="b", relation="r")["created"] and call("soft_link_query", cid="a", direction="from")["links"][0]["to_cid"] == "b"
    assert call("create_subtask", title="t", created_by="h")["task_id"] and call("calibrate", root_cid=node["node_cid"])["node_cid"]
    assert s.handle({"id": 2, "method": "nope"})["error"]["code"] == -32601 and s.handle({"id": 2, "method": "tools/call", "params": {"name": "get", "arguments": {}}})["error"]["code"] == -32603
    out = io.StringIO()
    s.serve(io.StringIO('{"jsonrpc":"2.0","id":7,"method":"tools/list"}\n\nnot json\n'), out)
    first, second = map(json.loads, out.getvalue().splitlines())
    assert len(first["result"]["tools"]) == 19 and second["error"]["code"] == -32700


def test_command_line(spark, tmp_path):
    home = f"{tmp_path}/cli"

    def run(*args):
        return cli.run(cli.parser().parse_args(["--home", home, *args]), spark)

    assert run("init")[1] == 0
    (tmp_path / "a.txt").write_text("hello from a file")
    cid = run("put", f"{tmp_path}/a.txt")[0]["cid"]
    assert run("get", cid) == ("hello from a file", 0) and run("verify", cid) == ({"valid": True}, 0)
    a = run("dag", "create", "--content", "root")[0]["node_cid"]
    b = run("dag", "create", "--content", "kid", "--parents", a, "--edge-kind", "grounds")[0]["node_cid"]
    assert len(run("dag", "lineage", "--cid", b)[0]) == 2 and len(run("dag", "ls")[0]) == 2 and run("dag", "show", "--cid", b)[0]["parents"] == [a]
    assert run("sql", "SELECT count(*) AS n FROM dag_nodes")[0] == [{"n": 2}] and run("verify-projection")[1] == 0
    task = run("task", "create", "--title", "do it")[0]["id"]
    run("task", "assign", "--id", task, "--to", "claude")
    run("agent", "register", "--name", "claude")
    assert run("task", "ls")[0][0]["status"] == "assigned" and run("agent", "ls")[0][0]["name"] == "claude"
    (tmp_path / "answer").write_text("the answer")
    run("run", task, "--agent", "claude", "--result", f"{tmp_path}/answer")
    assert run("task", "show", "--id", task)[0][0]["status"] == "done"
    run("scores", "add", "--node", b, "--agent", "x", "--dimension", "style", "--value", "0.9")
    assert run("scores", "show", "--node", b)[0][0]["icon"] == "PASS" and run("scores", "route", "--dimension", "style")[0][0]["agent"] == "x"
    run("link", "create", "--a", a, "--b", b)
    assert len(run("link", "ls", "--a", b)[0]) == 1 and "->" in run("dot")[0] and len(run("log")[0]) >= 4
    out = f"{tmp_path}/bundle.json"
    run("export", b, "--out", out)
    assert run("import", out)[0] == {"new_blobs": 0} and run("history")[0][-1]["message"] == "init" and run("cas-stats")[0]["nodes"] == 3
    assert run("snapshot", "create", "--name", "s1")[0]["nodes"] == 3 and run("snapshot", "verify", "--name", "s1")[1] == 0 and len(run("snapshot", "ls")[0]) == 1
    assert {r["change"] for r in run("diff", "soft_links", "--old", "1")[0]} == {"+"} and run("calibrate", "run", "--root", a)[0]["iterations"] == 8000
    with pytest.raises(ValueError):
        run("dag", "nonsense")
    assert SimpleNamespace(**vars(cli.parser().parse_args(["search", "x"]))).limit == 20


def test_blake3_of_many_contents_at_once(monkeypatch):
    """Trees of every shape, alone and together, in few and in many lanes."""
    data = [bytes(i % 251 for i in range(n)) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 4096, 5121, 7000, 31744)]
    alone = [address.blake3(d) for d in data]
    assert alone[6][:16] == "d00278ae47eb27b3"  # the vector of the specification for 1025 bytes
    assert address.blake3_many(data) == alone
    monkeypatch.setattr(address, "LANES", 3)
    assert address.blake3_many(data) == alone and address.blake3_many([]) == []


def test_python_symbols_around_damage():
    found = list(symbols.python_symbols("def a():\n    pass\n\ndef broken(:\n    x = 1\n\n@deco\nclass C:\n    def m(self):\n        print 'old'\n        def inner(): pass\n    def n(self):\n        return 1\n\nx = (\n\nimport os\n"))
    assert found == [("a", "function", 1, 2, None), ("C", "class", 8, 13, None), ("m", "method", 9, 11, "C"), ("inner", "method", 11, 11, "m"), ("n", "method", 12, 13, "C"), ("import os", "import", 17, 17, None)]
    assert list(symbols.python_symbols("(" * 50 + "\n" + "x y\n" * 300 + "def last(): pass\n")) == [("last", "function", 302, 302, None)]


def test_statements_that_change_tables(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    v.commit({"t": spark.createDataFrame([(1, "a,b", 1.0), (2, None, 2.0), (3, "c", None)], "id long, name string, x double")}, "first")
    two = v.execute(["UPDATE t SET name = concat(coalesce(name, 'where'), ', x = 1'), x = CASE WHEN x > 1 THEN 9 ELSE 0 END WHERE x >= 1", "INSERT INTO t VALUES (4, 'it''s', 5), (5, 'b', NULL);", "DELETE FROM t WHERE x > 4 AND id > 2"])
    rows = {tuple(r) for r in v.table("t", two).collect()}
    assert rows == {(1, "a,b, x = 1", 0.0), (2, "where, x = 1", 9.0), (3, "c", None), (5, "b", None)}
    v.execute("INSERT INTO t (x, id) SELECT 1, id + 10 FROM t WHERE id < 2")
    assert {tuple(r) for r in v.table("t").where("id > 5").collect()} == {(11, None, 1.0)} and v.table("t", 1).count() == 3
    v.execute("DELETE FROM t")
    assert v.table("t").isEmpty()
    head = v.head()
    for bad in ("DROP TABLE t", "DELETE FROM u", "UPDATE t SET nope = 1", "INSERT INTO t (nope) VALUES (1)", ["DELETE FROM t", "UPDATE t SET x"]):
        with pytest.raises(ValueError):
            v.execute(bad)
    assert v.head() == head


def test_versions_append_and_conflict(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MAX_FOLDERS", 3)
    v = Versions(spark, f"file://{tmp_path}/v")
    v.commit({"t": spark.range(1)}, "first")
    for i in range(1, 6):
        v.commit({}, "more", append={"t": spark.range(i, i + 1)})
    assert sorted(r["id"] for r in v.table("t").collect()) == list(range(6)) and len(v.manifest(v.head())["tables"]["t"]) <= 3
    assert v.table("t", 2).count() == 2
    seen = v._pointer
    monkeypatch.setattr(v, "_pointer", lambda b: (seen(b)[0] - 1, seen(b)[1]))  # as if another commit came between
    with pytest.raises(versions.Conflict):
        v.commit({"t": spark.range(9)}, "late")
    monkeypatch.setattr(v, "_pointer", seen)
    assert v.table("t").count() == 6


def test_store_deletes_by_partition(work, spark):
    cids = [work.store.put(f"content {i}") for i in range(12)]
    gone = spark.createDataFrame([(c,) for c in cids[:5]], "cid string")
    work.store.remove(gone)
    assert sorted(work.store.list()) == sorted(cids[5:]) and not work.store.exists(cids[0]) and work.store.get(cids[7]) == b"content 7"
    assert work.store.add(blobs.blobs_of(spark.createDataFrame([("content 0",), ("content 7",)], "x string"), F.col("x"))).count() == 1
    assert work.store.exists(cids[0])


def test_scratch_deletes_what_was_made_in_it(spark):
    place = store_module.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    with store_module.scratch(spark):
        with store_module.scratch(spark):
            store_module.written(spark.range(3), "a")
            kept = store_module.written(spark.range(4), "b", keep=True)
        assert len(set(os.listdir(place)) - before) == 1 and kept.count() == 4
    assert set(os.listdir(place)) == before


def test_scratches_of_two_threads_are_apart(spark):
    """One opens first and closes while the other still reads."""
    opened, closed, failed = [threading.Event(), threading.Event()], threading.Event(), []

    def first():
        with store_module.scratch(spark):
            store_module.written(spark.range(3), "first")
            opened[0].set()
            opened[1].wait(60)
        closed.set()

    def second():
        try:
            opened[0].wait(60)
            with store_module.scratch(spark):
                table = store_module.written(spark.range(5), "second")
                opened[1].set()
                closed.wait(60)
                assert table.count() == 5
        except Exception as e:
            failed.append(e)
            opened[1].set()

    place = store_module.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed and set(os.listdir(place)) == before


def test_results_belong_to_an_owner_that_can_be_closed(spark):
    place = store_module.shared_dir(spark).removeprefix("file://")
    before, owner = set(os.listdir(place)), store_module.Owner(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    with owner.collecting():
        found = graph.walk(spark.createDataFrame([(0,)], "start int"), edges)
    assert found.count() == 10 and set(os.listdir(place)) > before
    owner.close()
    assert set(os.listdir(place)) == before
    with owner.collecting():
        store_module.written(spark.range(1), "again")
    owner.close()
    assert set(os.listdir(place)) == before


def test_supersessions_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(oplog, "CHUNK", 7)
    rng = random.Random(2)
    lines = [(i, f"{TS} | put | {rng.choice('aab')} -> {i}") for i in range(0, 120, 3)]
    want, last = [], {}
    for i, line in lines:
        path = line.split(" | ")[2][0]
        want.append((path, i, str(i), last.get(path)))
        last[path] = str(i)
    events = oplog.parse(spark.createDataFrame(lines, "seq long, line string"))
    assert sorted(map(tuple, oplog.supersessions(events).collect())) == sorted(want)


def test_log_is_read_in_splits(spark, tmp_path):
    lines = [f"{TS} | put | path{i} -> {i}" for i in range(5000)]
    (tmp_path / "log").write_text("\n".join(lines) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = oplog.read(spark, f"{tmp_path}/log")
        assert found.rdd.getNumPartitions() > 4
        assert [r["line"] for r in found.orderBy("seq").collect()] == lines
        assert [r["detail"] for r in oplog.tail(found, 2).collect()] == ["path4998 -> 4998", "path4999 -> 4999"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
