"""The provenance graph: ancestry, neighbours, trees, text of the graph, bundles.

Walks take a few levels as one plan of joins, in which paths that meet are merged level by level, so that
diamonds don't multiply.  Deeper ones go along chains: disjoint paths that cover the graph, labelled in
logarithmic rounds by doubling pointers, where a range of places answers what is reached.  Cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.nodes import edge_kind, parse
from ..store import scratch, written

SEARCH_LIMIT = 20
# The colours of node kinds in graph text.
COLOURS = {"memory": "#E8F5E9", "code": "#E3F2FD", "reasoning": "#FFF3E0", "task": "#F3E5F5", "cdom": "#E0F7FA", "score": "#FBE9E7", "context": "#F1F8E9"}


def nodes_of(blobs: DataFrame) -> DataFrame:
    """``cid`` and the node fields of every blob that is a node."""
    one = F.explode(F.array(parse(F.col("data"))))  # a filter isn't moved below it, where it would parse again
    return blobs.select("cid", one.alias("node")).where("node IS NOT NULL").select("cid", "node.*")


def places(parents: Column) -> Column:
    """``ordinal, parent_cid`` of every parent; of a repeated one the first place counts."""
    link = lambda p, i: F.struct(i.alias("ordinal"), p.alias("parent_cid"))
    # Repeated parents stand side by side when sorted; the sorted array is bound to a name, so that it is sorted once.
    placed = F.array(F.array_sort(F.transform(parents, lambda p, i: F.struct(p.alias("parent_cid"), i.alias("ordinal")))))
    first = F.get(F.transform(placed, lambda s: F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["parent_cid"].eqNullSafe(x["parent_cid"]))), F.lit(0))
    return F.when(F.size(F.array_distinct(parents)) == F.size(parents), F.transform(parents, link)).otherwise(F.transform(first, lambda x: link(x["parent_cid"], x["ordinal"])))


def links_of(nodes: DataFrame, *more: str) -> DataFrame:
    """``parent_cid, child_cid, ordinal, edge_kind`` and columns ``more`` of the node, row by row of ``nodes``; of a repeated parent the first place counts."""
    links = nodes.select(F.col("cid").alias("child_cid"), F.explode(places(F.col("parents"))).alias("x"), "parent_kinds", *more)
    return links.select("x.parent_cid", "child_cid", "x.ordinal", edge_kind(F.get("parent_kinds", F.col("x.ordinal"))).alias("edge_kind"), *more)


def gathered(nodes: DataFrame, *more: str) -> DataFrame:
    """``cid, node``: nodes shuffled by address.  ``parents``, ``parent_kinds`` and ``more`` are one value, of which nothing is pruned, so that all who read it share the shuffle."""
    return nodes.select("cid", F.struct("parents", "parent_kinds", *more).alias("node")).repartition("cid")


def edges_of(nodes: DataFrame) -> DataFrame:
    """``parent_cid, child_cid, ordinal, edge_kind``, each edge once: an address stands for one node, however often it is there."""
    return links_of(nodes.select("cid", "parents", "parent_kinds").repartition("cid").dropDuplicates(["cid"]))


#: Levels that a walk takes one by one; what goes on beyond them goes along chains.
NEAR = 4


def walk(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, cid, depth``: what can be reached from ``starts(start)`` over edges(src, dst).

    depth is the least number of steps; a start is reached at 0; nulls are no nodes.  The first ``NEAR`` levels are one plan,
    in which the shuffled edges are used again for every level.  Where the last of them isn't empty, the
    rest goes along chains, in rounds that follow the chains a path changes between, not its length.
    """
    # stated for both, as Spark would otherwise infer it for some levels only and shuffle the edges twice
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    levels = [starts.select("start", F.col("start").alias("cid")).where("start IS NOT NULL")]
    for depth in range(1, 1 + (NEAR if max_depth is None else min(NEAR, max_depth))):
        # a merge join, so that one shuffle of the edges serves every level; paths can't meet in the first
        step = levels[-1].hint("merge").join(edges, F.col("cid") == F.col("src")).select("start", F.col("dst").alias("cid"))
        levels.append(step if depth == 1 else step.distinct())
    near = _nearest(reduce(DataFrame.union, [level.withColumn("depth", F.lit(depth)) for depth, level in enumerate(levels)]))
    if max_depth is not None and max_depth <= NEAR:
        return near
    near = written(near, "near")
    with scratch(starts.sparkSession):
        front = near.where(F.col("depth") == NEAR)
        if front.isEmpty():
            return near
        return written(_nearest(near.union(along_chains(front, written(edges.distinct(), "edges"), max_depth))), "reached", keep=True)


def _nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("start", "cid").agg(F.min("depth").alias("depth"))


def chains(edges: DataFrame) -> tuple[DataFrame, int]:
    """``cid, chain, place`` of every node of edges(src, dst), and in how many rounds they were found.

    Chains are paths of edges that share no node and cover all: a node goes on to its smallest target, if
    it is that target's smallest source among those that do.  ``chain`` is the node where the path ends,
    ``place`` the steps to it.  Pointers are doubled, so rounds are the logarithm of the longest chain.
    Nodes on a cycle never find an end; each is a chain by itself.
    """
    goes_on = edges.groupBy("src").agg(F.min("dst").alias("dst")).groupBy("dst").agg(F.min("src").alias("src"))
    links = written(goes_on.select(F.col("src").alias("cid"), F.col("dst").alias("up"), F.lit(1).cast("long").alias("place")), "links")
    most, rounds, open_ = links.count().bit_length() + 1, 0, True
    while open_ and rounds < most:
        ahead = links.select(F.col("cid").alias("up"), F.col("up").alias("further"), F.col("place").alias("more"))
        jumped = links.join(ahead, "up", "left")
        known = F.col("further").isNotNull()
        links = written(jumped.select("cid", F.coalesce("further", "up").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), known.alias("moved")), "links")
        open_, links, rounds = not links.where("moved").isEmpty(), links.drop("moved"), rounds + 1
    if open_:  # what still moves after so many rounds goes round
        ends = links.select(F.col("cid").alias("up"))
        links = links.join(ends, "up", "left_anti")
    nodes = edges.select(F.col("src").alias("cid")).union(edges.select("dst")).distinct()
    return nodes.join(links, "cid", "left").select("cid", F.coalesce("up", "cid").alias("chain"), F.coalesce("place", F.lit(0)).cast("long").alias("place")), rounds


def along_chains(front: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, cid, depth``: what is reached from front(start, cid, depth) over distinct edges(src, dst), with the least depth in some row.

    Who enters a chain at a place reaches all places below it, so an entry is a place and the depth at the
    chain's end, and a range join with the edges that leave the chain finds all next entries at once.
    An entry is dropped if another one of the same start and chain is as far up and no deeper.
    """
    labels = written(chains(edges)[0], "labels")
    of = lambda c: labels.select(F.col("cid").alias(c), F.col("chain").alias(f"{c}_chain"), F.col("place").alias(f"{c}_place"))
    both = edges.join(of("src"), "src").join(of("dst"), "dst")
    link = (F.col("src_chain") == F.col("dst_chain")) & (F.col("src_place") == F.col("dst_place") + 1)
    leaving = written(both.where(~link).select(F.col("src_chain").alias("chain"), "src_place", "dst_chain", "dst_place"), "leaving")
    entered = front.join(labels, "cid").select("start", "chain", "place", (F.col("depth") + F.col("place")).alias("end"))
    known, new = None, entered
    while True:
        rows = new.select("*", F.lit(True).alias("new"))
        if known is not None:
            rows = rows.union(known.select("*", F.lit(False)))
        before = F.min("end").over(W.partitionBy("start", "chain").orderBy(F.desc("place"), "end", "new").rowsBetween(W.unboundedPreceding, -1))
        new = written(rows.withColumn("best", before).where("new AND (best IS NULL OR end < best)").drop("new", "best"), "entries")
        if new.isEmpty():
            break
        known = new if known is None else written(known.union(new), "known")
        step = new.join(leaving, "chain").where(F.col("src_place") <= F.col("place"))
        depth = F.col("end") - F.col("src_place") + 1
        if max_depth is not None:
            step = step.where(depth <= max_depth)
        new = step.select("start", F.col("dst_chain").alias("chain"), F.col("dst_place").alias("place"), (depth + F.col("dst_place")).alias("end"))
    found = known.join(labels.select("chain", "cid", F.col("place").alias("at")), "chain").where(F.col("at") <= F.col("place"))
    found = found.select("start", "cid", (F.col("end") - F.col("at")).cast("int").alias("depth"))
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def lineage(nodes: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Ancestors of ``starts(start)``, themselves included: ``start, depth`` and the node columns.

    Addresses without a node are skipped, and nothing is found behind them.
    """
    up = nodes.select(F.col("cid").alias("src"), F.explode(F.array_distinct("parents")).alias("dst"))
    return walk(starts, up, max_depth).join(nodes, "cid")


def children_of(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """``parent_cid, child_cid, ordinal, kind, agent, created_at`` for ``of(cid)``."""
    return edges.join(of.select(F.col("cid").alias("parent_cid")), "parent_cid", "left_semi").join(nodes.select(F.col("cid").alias("child_cid"), "kind", "agent", "created_at"), "child_cid").select("parent_cid", "child_cid", "ordinal", "kind", "agent", "created_at")


def parents_of(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    return edges.join(of.select(F.col("cid").alias("child_cid")), "child_cid", "left_semi").join(nodes.select(F.col("cid").alias("parent_cid"), "kind", "agent", "created_at"), "parent_cid").select("child_cid", "parent_cid", "ordinal", "kind", "agent", "created_at")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge from a parent, whether that parent is stored or not."""
    return nodes.join(edges.select(F.col("child_cid").alias("cid")).distinct(), "cid", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("parent_cid").alias("cid")).distinct(), "cid", "left_anti")


def schema_stats(nodes: DataFrame) -> DataFrame:
    """``schema_cid, total_nodes, unique_outputs, dedup_ratio``; the ratio is text."""
    return (
        nodes.where("schema_cid IS NOT NULL").groupBy("schema_cid").agg(F.count(F.lit(1)).alias("total_nodes"), F.countDistinct("output_cid").alias("unique_outputs"))
        .withColumn("dedup_ratio", F.when(F.col("unique_outputs") > 0, F.format_string("%.2f", F.col("total_nodes") / F.col("unique_outputs"))).otherwise("N/A"))
    )


def list_nodes(nodes: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes by address; a limit counts after the filter."""
    found = (nodes.where(F.col("kind") == kind) if kind else nodes).select("cid", "kind", "agent", "timestamp", "output_cid", F.size("parents").alias("n_parents")).orderBy("cid")
    return found.limit(limit) if limit else found


def search(blobs: DataFrame, query: str, limit: int | None = SEARCH_LIMIT, snippet: int = 200) -> DataFrame:
    """``cid, snippet`` of blobs whose text contains ``query`` in any case, by address."""
    text = F.col("data").cast("string")
    found = blobs.where(F.is_valid_utf8(text) & F.contains(F.lower(text), F.lower(F.lit(query)))).select("cid", F.left(text, F.lit(snippet)).alias("snippet")).orderBy("cid")
    return found.limit(limit) if limit else found


def search_lines(blobs: DataFrame, query: str, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """``cid, line_no, line``: the lines that contain ``query``, of the first ``limit`` blobs."""
    text = F.col("data").cast("string")
    hits = blobs.where(F.is_valid_utf8(text) & F.contains(F.lower(text), F.lower(F.lit(query)))).select("cid", text.alias("text"))
    if limit:
        hits = hits.orderBy("cid").limit(limit)
    lines = hits.select("cid", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return lines.where(F.contains(F.lower("line"), F.lower(F.lit(query)))).select("cid", (F.col("at") + 1).alias("line_no"), "line")


def reasoning(nodes: DataFrame, blobs: DataFrame, of: DataFrame) -> DataFrame:
    """Content behind ``of(cid)``: a node's output, or the blob itself where it is no node."""
    texts = blobs.select(F.col("cid").alias("content_cid"), F.col("data").cast("string").alias("content"))
    target = of.join(nodes.select("cid", "agent", "kind", "timestamp", "schema_cid", "output_cid"), "cid", "left").withColumn("content_cid", F.coalesce("output_cid", "cid"))
    return target.join(texts, "content_cid", "left").select("cid", "agent", "kind", "timestamp", "content", "schema_cid")


def dot(nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``seq, line``: text of the graph, lines in order; it is a table, to be written by partition."""
    colour = F.lit("#FFFFFF")
    for kind, c in COLOURS.items():
        colour = F.when(F.col("kind") == kind, F.lit(c)).otherwise(colour)
    short = lambda c: F.left(F.col(c), F.lit(12))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", "digraph provenance {"), (0, "1", "  rankdir=BT;"), (0, "2", '  node [shape=box, style=filled, fontname="monospace"];'), (9, "", "}")], "part int, k string, line string")
    body = nodes.select(F.lit(1).alias("part"), F.col("cid").alias("k"), F.format_string('  "%s" [label="%s\\n%s\\n%s", fillcolor="%s"];', short("cid"), short("cid"), "kind", "agent", colour).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.concat("child_cid", F.lpad("ordinal", 9, "0")).alias("k"), F.format_string('  "%s" -> "%s";', short("child_cid"), short("parent_cid")).alias("line"))
    out = head.union(body).union(arrows)
    if links is not None:
        out = out.union(links.select(F.lit(3), F.concat("from_cid", "to_cid", "relation"), F.format_string('  "%s" -> "%s" [style=dashed, label="%s", color="gray"];', short("from_cid"), short("to_cid"), "relation")))
    return out.orderBy("part", "k").select("part", "k", "line")


def bundles(nodes: DataFrame, blobs: DataFrame, starts: DataFrame) -> DataFrame:
    """``node_cid, node_bytes, output_cid, output_bytes`` of the lineages of ``starts(start)``, each node
    once, base64 without line breaks.  Fails where an output is missing."""
    found = lineage(nodes, starts).select(F.col("cid").alias("node_cid"), "output_cid").distinct()
    plain = lambda c: F.translate(F.base64(c), "\r\n", "")
    of = lambda c, d: blobs.select(F.col("cid").alias(c), F.col("data").alias(d))
    joined = found.join(of("node_cid", "a"), "node_cid").join(of("output_cid", "b"), "output_cid", "left")
    checked = F.when(F.assert_true(F.col("b").isNotNull(), F.concat(F.lit("missing output "), "output_cid")).isNull(), plain(F.col("b")))
    return joined.select("node_cid", plain(F.col("a")).alias("node_bytes"), "output_cid", checked.alias("output_bytes"))


def bundle(nodes: DataFrame, blobs: DataFrame, root: str) -> DataFrame:
    """The bundle of one node."""
    return bundles(nodes, blobs, nodes.sparkSession.createDataFrame([(root,)], "start string"))


def unbundle(entries: DataFrame, method: str = "sha256") -> DataFrame:
    """Blobs of a bundle; fails where content doesn't have its address."""
    from ..functions.address import cid

    both = entries.select(F.col("output_cid").alias("cid"), F.unbase64("output_bytes").alias("data")).union(entries.select("node_cid", F.unbase64("node_bytes")))
    right = F.assert_true(cid(F.col("data"), method) == F.col("cid"), F.concat(F.lit("content doesn't match "), "cid"))
    return both.dropDuplicates(["cid"]).select("cid", F.when(right.isNull(), F.col("data")).alias("data"), F.octet_length("data").cast("long").alias("size"))


def spanning_tree(nodes: DataFrame, edges: DataFrame, roots_: DataFrame) -> DataFrame:
    """``root, cid, parent_cid, depth``: descendants of ``roots_(cid)`` over edges to stored nodes.

    A node that several parents reach hangs at the least depth under the smallest parent.
    """
    down = edges.join(nodes.select(F.col("cid").alias("child_cid")), "child_cid", "left_semi").select(F.col("parent_cid").alias("src"), F.col("child_cid").alias("dst"))
    starts = roots_.join(nodes, "cid", "left_semi").select(F.col("cid").alias("start"))
    reached = written(walk(starts, down), "reached")
    above = reached.select(F.col("start").alias("root"), F.col("cid").alias("src"), (F.col("depth") + 1).alias("depth"))
    up = above.join(down, "src").groupBy("root", F.col("dst").alias("cid"), "depth").agg(F.min("src").alias("parent_cid"))
    return reached.withColumnRenamed("start", "root").join(up, ["root", "cid", "depth"], "left").select("root", "cid", "parent_cid", "depth")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: of every key the first row in a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Replace-into: of every key the last row, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order, *[F.col(c) for c in rest if c not in order and not isinstance(rows.schema[c].dataType, MapType)]))
    return rows.groupBy(*keys).agg(last.alias("__last")).select(*keys, *[F.col("__last")[c].alias(c) for c in rest]).select(*rows.columns)

