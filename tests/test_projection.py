"""Nodes are parsed once, and edges are made and verified where their nodes are."""

import random
import re

import pytest

import __spark_entry__ as entry
from veinstone.operators import graph, projection
from veinstone.plans import adapters as A

DATA = "/root/testdata/sf0.001"
NODES = "cid string, parents array<string>, parent_kinds array<string>, output_cid string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_a_blob_is_parsed_once(spark):
    blobs = A.order_node_blobs(spark, DATA)
    assert parses(graph.nodes_of(blobs)) == 1
    assert parses(graph.edges_of(graph.nodes_of(blobs))) == 1


@pytest.mark.parametrize("name, times", [("projection_rebuild", 1), ("projection_verify", 2), ("edges_from_nodes", 1)])
def test_queries_parse_no_more_than_they_must(spark, name, times):
    assert parses(entry.queries()[name](spark, DATA)) == times


def test_edges_from_nodes_shuffles_the_given_tables_only(spark):
    assert plan(entry.queries()["edges_from_nodes"](spark, DATA)).count("Exchange ") == 2


def test_links_of_nodes_with_repeated_parents_and_none(spark):
    rows = [("c", ["p", "q", "p", "q", "a"], ["grounds", "x", "proposes", None, None], "o"), ("d", [], None, "o"), ("e", ["p"], None, None), ("f", None, None, "o"), ("g", ["q", "q"], None, "o"), ("g", ["q", "q"], None, "o")]
    nodes = spark.createDataFrame(rows, NODES)
    once = [("a", "c", 4, "derives"), ("p", "c", 0, "grounds"), ("p", "e", 0, "derives"), ("q", "c", 1, "derives"), ("q", "g", 0, "derives")]
    assert sorted(map(tuple, graph.edges_of(nodes).collect())) == once
    got = sorted((tuple(r) for r in graph.links_of(nodes, "output_cid").collect()), key=str)
    assert got == sorted([(*e, None if e[1] == "e" else "o") for e in [*once, once[-1]]], key=str)


def test_verify_hands_columns_of_the_node_on(spark):
    nodes = spark.createDataFrame([("c", ["p", "q", "r"], None, "o")], NODES)
    table = spark.createDataFrame([("q", "c", 1, "grounds"), ("r", "c", 2, "derives"), ("x", "c", 0, "derives")], "parent_cid string, child_cid string, ordinal int, edge_kind string")
    assert {tuple(r) for r in projection.verify(nodes, table, "output_cid").collect()} == {("p", "c", "missing", "o"), ("q", "c", "mismatched", "o"), ("x", "c", "extra", None)}
    assert projection.verify(nodes, table).columns == ["parent_cid", "child_cid", "status"]


def test_projection_verify_shuffles_nodes_once_and_no_edges(spark):
    df = entry.queries()["projection_verify"](spark, DATA)
    df.collect()
    made = [line for line in plan(df).split("== Initial Plan ==")[0].splitlines() if "ReusedExchange" not in line]
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", "\n".join(made))
    assert keys.count("cid") == 1 and set(keys) <= {"cid", "l_orderkey", "o_orderkey"}


EDGES = "parent_cid string, child_cid string, ordinal int, edge_kind string"


def by_join(nodes, table):
    """What ``verify`` says, by all edges and with the node's output."""
    e = graph.links_of(nodes, "output_cid").selectExpr("parent_cid", "child_cid", "struct(ordinal, edge_kind) AS e", "output_cid")
    found = e.join(table.selectExpr("parent_cid", "child_cid", "struct(ordinal, edge_kind) AS a"), ["parent_cid", "child_cid"], "full")
    return found.selectExpr("parent_cid", "child_cid", "CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'extra' WHEN a <> e THEN 'mismatched' END AS status", "output_cid").where("status IS NOT NULL")


def same(nodes, table):
    got, want = (sorted(map(tuple, x.collect()), key=str) for x in (projection.verify(nodes, table, "output_cid"), by_join(nodes, table)))
    assert got == want
    return got


@pytest.mark.parametrize("seed", range(3))
def test_verify_equals_the_join_of_all_edges(spark, seed):
    """Repeated parents, nodes and edges, nulls, children that are no nodes, nodes without edges."""
    rng = random.Random(seed)
    kinds = ["derives", "grounds", "proposes", "other", None]
    rows = [(f"c{i}", [rng.choice(["p", "q", "r", "s", "t", "u"]) for _ in range(rng.randrange(5))], rng.choice([None, [rng.choice(kinds) for _ in range(rng.randrange(6))]]), rng.choice(["o", None])) for i in range(60)]
    rows += [*rows[:9], rows[0], (None, ["p", "p", "q"], None, "o"), (None, ["p"], None, "o"), ("n", [None, "p", None], None, "o"), ("m", None, None, "o")]
    nodes = spark.createDataFrame(rows, NODES)
    edges = [tuple(r) for r in graph.edges_of(nodes).collect()]
    edges = [(p, c, i + (rng.random() < 0.2), k if rng.random() < 0.8 else rng.choice(kinds)) for p, c, i, k in edges if rng.random() < 0.8]
    edges += rng.choices(edges, k=20) + [(p, c, rng.choice([0, None]), "derives") for c in ("c1", "c2", "c59", "x", "m", "n", None) for p in ("p", "z", "z", None)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, EDGES)
    assert {r[2] for r in same(nodes, table)} == {"missing", "extra", "mismatched"}
    same(nodes, table.limit(0))
    same(nodes.limit(0), table)


def test_verify_a_node_with_many_parents(spark):
    n = 100_000
    nodes = spark.range(1).selectExpr("'c' AS cid", f"transform(sequence(1, {n}), i -> concat('p', i)) AS parents", "cast(NULL AS array<string>) AS parent_kinds")
    table = spark.range(1, n + 2).selectExpr("concat('p', id) AS parent_cid", "'c' AS child_cid", "cast(id - 1 AS int) AS ordinal", "if(id = 7, 'grounds', 'derives') AS edge_kind").where("id <> 5")
    assert {tuple(r) for r in projection.verify(nodes, table).collect()} == {("p5", "c", "missing"), ("p7", "c", "mismatched"), (f"p{n + 1}", "c", "extra")}


def test_texts_that_are_no_nodes(spark):
    good = '{"kind":"task","parents":["p"],"output_cid":"o","agent":"a","timestamp":"t","meta":[]}'
    bad = [good.replace('"a"', "1"), good.replace('"o"', "null"), good.replace("task", "other"), good.replace('["p"]', "[null]"), good.replace('"meta":[]', '"agent":"b","meta":[]'), good[:-1], "", "[]", "1", "null"]
    rows = [(str(i), bytearray(t.encode())) for i, t in enumerate([good, *bad])] + [("x", bytearray(b"\xff" + good.encode())), ("y", None)]
    got = graph.nodes_of(spark.createDataFrame(rows, "cid string, data binary")).collect()
    assert [(r["cid"], r["kind"], r["parents"], r["agent"]) for r in got] == [("0", "task", ["p"], "a")]
