"""The projection: tables derived from the nodes, their audit, upserts and standard reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nodes import edge_kind, is_claim, is_query, saturation
from .graph import edges_of, keep_first, keep_last, places

EDGE_KEY = ["parent_cid", "child_cid"]


def dag_nodes_of(nodes: DataFrame) -> DataFrame:
    """Rows of ``dag_nodes``; saturation comes from the node itself."""
    return nodes.select("cid", "kind", "agent", F.col("timestamp").alias("created_at"), "output_cid", F.lit("").alias("meta"), F.coalesce("schema_cid", F.lit("")).alias("schema_cid"), saturation(F.col("meta")).alias("saturation"))


def diff_edges(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``parent_cid, child_cid, status`` of edges that are missing, extra or mismatched."""
    e = expected.select(*EDGE_KEY, F.struct("ordinal", "edge_kind").alias("e"))
    a = actual.select(*EDGE_KEY, F.struct("ordinal", "edge_kind").alias("a"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("a") != F.col("e"), "mismatched")
    # The child comes first: addresses differ in their first bytes, which is what a sort looks at first.
    return e.join(a, EDGE_KEY[::-1], "full").select(*EDGE_KEY, status.alias("status")).where("status IS NOT NULL")


def _said(status: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["parent_cid"].alias("parent_cid"), F.lit(status).alias("status"))


def _differences(parents: Column, kinds: Column, told: Column) -> Column:
    """``parent_cid, status`` where a node's parents differ from the edges that a table has for it.

    Where no parent is repeated and each edge told of has its parent's place, places say which belong together; else both are sorted.
    """
    placed = F.coalesce(F.size(F.array_distinct(parents)) == F.size(parents), F.lit(False)) & F.forall(told, lambda x: F.coalesce(F.get(parents, x["ordinal"]) == x["parent_cid"], F.lit(False)))
    untold = F.array_except(F.transform(parents, lambda _, i: i), F.transform(told, lambda x: x["ordinal"]))
    changed = F.filter(told, lambda x: ~edge_kind(F.get(kinds, x["ordinal"])).eqNullSafe(x["edge_kind"]))
    missing = F.transform(F.transform(untold, lambda i: F.struct(F.get(parents, i).alias("parent_cid"))), _said("missing"))
    return F.when(placed, F.concat(missing, F.transform(changed, _said("mismatched")))).otherwise(_differences_by_sorting(parents, kinds, told))


def _differences_by_sorting(parents: Column, kinds: Column, told: Column) -> Column:
    """The same for any edges; a node may have many."""
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluated once, however often f asks for it
    row = lambda side, x, kind: F.struct(x["parent_cid"].alias("parent_cid"), F.lit(side).alias("side"), F.struct(x["ordinal"].alias("ordinal"), kind.alias("edge_kind")).alias("at"))
    own = F.transform(places(parents), lambda x: row(0, x, edge_kind(F.get(kinds, x["ordinal"]))))
    told = F.transform(told, lambda x: row(1, x, x["edge_kind"]))
    both = F.sort_array(F.concat(F.coalesce(own, F.array()), F.coalesce(told, F.array())))

    def one(g: Column) -> Column:
        """The node's own edge is the first of those from one parent, and the only one of its side."""
        e = F.get(g, F.lit(0))
        changed = F.filter(F.slice(g, 2, F.size(g)), lambda x: x["at"] != e["at"])
        return F.when(e["side"] == 1, F.transform(g, _said("extra"))).when(F.size(g) == 1, F.transform(g, _said("missing"))).otherwise(F.transform(changed, _said("mismatched")))

    def by_parent(s: Column) -> Column:
        # A null equals no other.
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~F.coalesce(F.get(s, i - 1)["parent_cid"] == x["parent_cid"], F.lit(False)), i)), lambda i: i.isNotNull())
        return bind(starts, lambda b: F.transform(b, lambda k, j: one(F.slice(s, k + 1, F.coalesce(F.get(b, j + 1), F.size(s)) - k))))

    return F.flatten(bind(both, by_parent))


def verify(nodes: DataFrame, dag_edges: DataFrame, *more: str) -> DataFrame:
    """``parent_cid, child_cid, status`` of edges of ``nodes``, row by row, against a table of edges; columns ``more`` of the node go along, null for extra edges.

    Nodes meet the table's edges by child, and what is exploded are differences: edges with their addresses are a multiple of
    the nodes and aren't shuffled.  The edges that a table has for one child are one value, as a node's parents are.
    """
    told = dag_edges.groupBy("child_cid").agg(F.collect_list(F.struct("parent_cid", "ordinal", "edge_kind")).alias("__told"))
    # Of rows with one address the first tells of extra edges; the join sorts by address as well.
    first = F.row_number().over(W.partitionBy("child_cid").orderBy("child_cid")) == 1
    own = nodes.select(F.col("cid").alias("child_cid"), F.col("parents").alias("__parents"), F.col("parent_kinds").alias("__kinds"), *more).withColumn("__first", first)
    found = own.join(told, "child_cid", "full").select("child_cid", F.explode(_differences(F.col("__parents"), F.col("__kinds"), F.coalesce("__told", F.array()))).alias("__x"), "__first", *more)
    found = found.where("__x.status <> 'extra' OR coalesce(__first, true)")
    return found.select("__x.parent_cid", "child_cid", "__x.status", *[F.when(F.col("__x.status") != "extra", F.col(m)).alias(m) for m in more])


def rebuild(nodes: DataFrame, dag_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges anew, and one row of ``purged, written``."""
    fresh = edges_of(nodes)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return fresh, count(dag_edges, "purged").crossJoin(F.broadcast(count(fresh, "written")))


def repair(nodes: DataFrame, dag_nodes: DataFrame) -> DataFrame:
    """Rows that ``dag_nodes`` lacks."""
    return dag_nodes_of(nodes.join(dag_nodes.select("cid"), "cid", "left_anti"))


def fresh(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, to be appended; fails where a key is repeated or is there already."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    twice = again.union(rows.select(*keys).join(table.select(*keys), keys, "left_semi")).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    return rows


def insert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append; fails on a repeated key."""
    return table.unionByName(fresh(table, rows, keys))


def ignored(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What of ``rows`` is new, to be appended; of new rows with one key the first in ``order``."""
    return keep_first(rows.join(table.select(*keys), keys, "left_anti"), keys, order).select(*table.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Append what is new; of new rows with one key the first in ``order``."""
    return table.unionByName(ignored(table, rows, keys, order))


def replace_into(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``rows`` take the place of rows with their key; the last in ``order`` wins."""
    fresh = keep_last(rows, keys, order)
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def normalised_edges(rows: DataFrame) -> DataFrame:
    return rows.withColumn("edge_kind", edge_kind(F.col("edge_kind")))


def sync_symbols(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Symbols of the files in ``rows`` are replaced."""
    return table.join(rows.select("file_path").distinct(), "file_path", "left_anti").unionByName(rows)


# Reports


def list_dag_nodes(dag_nodes: DataFrame) -> DataFrame:
    return dag_nodes.orderBy("created_at", "cid")


def dag_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE_KEY, "ordinal", "edge_kind").orderBy("child_cid", "ordinal", "parent_cid")


def tracked_cid(context_files: DataFrame, path: str) -> DataFrame:
    """``cid`` that is tracked for a path; an empty one is null."""
    return context_files.where(F.col("path") == path).select(F.nullif("cid", F.lit("")).alias("cid"))


def search_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Names like ``%query%``; ``%`` and ``_`` in it stay wildcards, and case counts."""
    return symbols.where(F.col("name").like(f"%{query}%")).orderBy("file_path", "start_line")


def symbols_by_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.col("kind") == kind).orderBy("file_path", "start_line")


def symbols_in_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("start_line")


def counts_by(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def soft_links(links: DataFrame, address: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Links from, to or around an address; an unknown direction is both."""
    at = {"from": F.col("from_cid") == address, "to": F.col("to_cid") == address}
    found = links.where(at.get(direction, at["from"] | at["to"]))
    return (found.where(F.col("relation") == relation) if relation else found).orderBy("created_at", "from_cid", "to_cid")


def open_queries(dag_nodes: DataFrame) -> DataFrame:
    return dag_nodes.where(is_query(F.col("saturation"))).orderBy(F.desc("created_at"), "cid")


def settled_claims(dag_nodes: DataFrame) -> DataFrame:
    return dag_nodes.where(is_claim(F.col("saturation"))).orderBy(F.desc("created_at"), "cid")


def below_saturation(dag_nodes: DataFrame, threshold: float) -> DataFrame:
    return dag_nodes.where(F.col("saturation") < F.lit(threshold).cast("float")).orderBy("saturation", F.desc("created_at"), "cid")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n`` for every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
