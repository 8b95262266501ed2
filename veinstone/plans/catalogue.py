"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nodes as N
from ..operators import allocate, audit, bloom, digests, graph, ngrams, projection, rollups, scores, symbols, tasks
from ..operators import blobs as B
from ..schema import DIMENSIONS
from ..sources import files, oplog
from ..store import folder, written
from ..streaming import supersede
from ..versions import changed, diff
from . import adapters as A
from .adapters import t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Contents


@query("SELECT sha256(text) AS cid, count(*) AS puts, min(strlen(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_dedup(spark: SparkSession, d: str) -> DataFrame:
    texts = t(spark, d, "documents").select(F.col("text").cast("binary").alias("data")).where("data IS NOT NULL")
    return texts.groupBy(F.sha2("data", 256).alias("cid")).agg(F.count(F.lit(1)).alias("puts"), F.min(F.octet_length("data")).cast("long").alias("size"))


@query(A.BLOBS_SQL + "SELECT cid, size FROM blobs")
def blob_list(spark, d):
    """Addresses as they are listed, with the sizes."""
    blobs = A.all_blobs(spark, d)
    return B.listing(blobs).join(B.blob_sizes(blobs), "cid")


@query(A.BLOBS_SQL + "SELECT sum(size)::BIGINT AS total_size FROM blobs")
def blob_total_size(spark, d):
    return B.total_size(A.all_blobs(spark, d))


@query("SELECT sha256(text) AS cid, doc_id % 7 <> 0 AS valid FROM documents WHERE text IS NOT NULL")
def blob_verify(spark, d):
    """Every seventh stored content was changed after it was put."""
    return B.verify(A.damaged_blobs(spark, d))


@query("SELECT sha256(text) AS cid, octet_length(encode(text))::BIGINT AS size FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL)")
def blob_get(spark, d):
    """The content of one address, and its size."""
    docs = t(spark, d, "documents")
    address = docs.where("text IS NOT NULL").agg(F.min_by(F.sha2("text", 256), "doc_id")).first()[0]
    return B.blob_sizes(B.get(B.blobs_of(docs, F.col("text")), address or ""))


@query("SELECT DISTINCT sha256(x) AS cid, strlen(x) AS size FROM (SELECT text AS x FROM conversations UNION ALL SELECT html FROM pages) WHERE sha256(x) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)")
def blob_put_new(spark, d):
    puts = B.blobs_of(t(spark, d, "conversations").select("text").union(t(spark, d, "pages").select("html")), F.col("text"))
    return B.new_blobs(puts, B.blobs_of(t(spark, d, "documents"), F.col("text"))).select("cid", "size")


@query(A.BLOBS_SQL + "SELECT cid FROM blobs WHERE cid NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)")
def blob_delete(spark, d):
    return B.delete(A.all_blobs(spark, d), B.blobs_of(t(spark, d, "documents"), F.col("text"))).select("cid")


@query("SELECT doc_id // 100 AS part, sum(octet_length(encode(text)) + 1)::BIGINT AS length, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS cid FROM documents WHERE text IS NOT NULL GROUP BY 1")
def file_addresses(spark, d):
    """Addresses of files, one for each hundred documents, that tasks stream."""
    place = folder(spark, "files")
    docs = t(spark, d, "documents").where("text IS NOT NULL").select(F.floor(F.col("doc_id") / 100).alias("part"), "doc_id", "text")
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(place)
    listed = files.listing(spark, place)
    found = files.addresses(listed).join(listed, "path")
    return found.select(F.regexp_extract("path", r"part=(-?\d+)", 1).cast("long").alias("part"), "length", "cid")


@query("SELECT sha256(html) AS cid, sha256(html) IN (SELECT sha256(text) FROM conversations) AS stored FROM pages")
def blob_exists(spark, d):
    return B.exists(t(spark, d, "pages").select(F.sha2("html", 256).alias("cid")), B.blobs_of(t(spark, d, "conversations"), F.col("text")))


# Nodes and edges


@query(A.NODES_SQL + "SELECT conv_id, turn, cid FROM n")
def merkle_nodes(spark, d):
    return A.conversation_nodes(spark, d).select("conv_id", "turn", "cid")


@query(A.NODES_SQL + "SELECT conv_id, arg_max(cid, turn) AS head, count(*) AS length FROM n GROUP BY 1")
def merkle_heads(spark, d):
    return A.conversation_nodes(spark, d).groupBy("conv_id").agg(F.max_by("cid", "turn").alias("head"), F.count(F.lit(1)).alias("length"))


@query(A.NODES_SQL + "SELECT DISTINCT cid, json_extract_string(json, '$.kind') AS kind, json_extract_string(json, '$.agent') AS agent, json_extract_string(json, '$.output_cid') AS output_cid, json_array_length(json, '$.parents')::INT AS n_parents FROM n")
def nodes_parsed(spark, d):
    """Of all blobs those that are nodes, by parsing them."""
    return A.nodes(spark, d).select("cid", "kind", "agent", "output_cid", F.size("parents").alias("n_parents"))


@query(A.ORDER_EDGES_SQL + "SELECT output_cid, ps[ordinal + 1] AS parent_cid, ordinal::INT AS ordinal, CASE WHEN ordinal = 0 THEN 'derives' ELSE 'grounds' END AS edge_kind FROM i")
def edges_from_nodes(spark, d):
    nodes = graph.nodes_of(A.order_node_blobs(spark, d))
    return graph.links_of(nodes, "output_cid").select("output_cid", "parent_cid", "ordinal", "edge_kind")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 WHEN 3 THEN 1.0 END::DOUBLE AS saturation, doc_id % 6 IN (1, 3) AS claim, doc_id % 6 IN (0, 4, 5) AS query, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id % 5 END AS schema_cid, CASE WHEN doc_id % 2 = 0 THEN ['derives', 'grounds'] ELSE ['derives', 'derives'] END AS kinds, round(CASE WHEN doc_id % 4 = 0 THEN greatest(0.8 * exp(-7200.0 * ln(2.0) / 3600), 0.1) ELSE 1.0 END, 9) AS activation FROM documents")
def node_semantics(spark, d):
    """What nodes say in their own bytes: saturation in the metadata, schema, kinds of parents, decay."""
    blobs = A.claim_node_blobs(spark, d)
    nodes = graph.nodes_of(blobs).join(blobs.select("cid", "doc_id"), "cid")
    sat = N.saturation(F.col("meta"))
    kinds = F.transform("parents", lambda _, i: N.edge_kind(F.get("parent_kinds", i)))
    faded = N.decayed_activation(F.col("activation"), F.col("decay_config"), F.lit(7200.0))
    return nodes.select("doc_id", sat.cast("double").alias("saturation"), N.is_claim(sat).alias("claim"), N.is_query(sat).alias("query"), "schema_cid", kinds.alias("kinds"), F.round(faded, 9).alias("activation"))


_LINE_ORDER = ["l_linenumber", "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS n FROM lineitem) WHERE n = 1")
def edges_insert_ignore(spark, d):
    return graph.keep_first(t(spark, d, "lineitem"), ["l_partkey", "l_orderkey"], _LINE_ORDER).select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_partkey, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey FROM lineitem GROUP BY 1")
def replace_into_last(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.keep_last(rows, ["l_partkey"], ["seq"]).select("l_partkey", "l_orderkey")


_WALK_SQL = A.STAR_SQL + ", w AS (SELECT cid AS start, cid, 0 AS depth FROM nodes WHERE kind = 'orders' UNION SELECT w.start, e.parent_cid, w.depth + 1 FROM w JOIN edges e ON e.child_cid = w.cid{bound}) SELECT start, cid, min(depth)::INT AS depth FROM w GROUP BY 1, 2"


def _ancestors(spark, d, bound=None):
    nodes = A.star_nodes(spark, d)
    up = A.star_edges(spark, d, once=False).select(F.col("child_cid").alias("src"), F.col("parent_cid").alias("dst"))
    return graph.walk(nodes.where("kind = 'orders'").select(F.col("cid").alias("start")), up, bound)


@query(_WALK_SQL.format(bound=""))
def lineage(spark, d):
    return _ancestors(spark, d)


@query(_WALK_SQL.format(bound=" WHERE w.depth < 2"))
def lineage_bounded(spark, d):
    return _ancestors(spark, d, 2)


@query(A.NODES_SQL + ", h AS (SELECT conv_id, max(turn) AS last FROM n GROUP BY 1) SELECT DISTINCT z.cid AS start, n.cid, (h.last - n.turn)::INT AS depth FROM n JOIN h USING (conv_id) JOIN n z ON z.conv_id = n.conv_id AND z.turn = h.last")
def lineage_of_heads(spark, d):
    heads = A.conversation_nodes(spark, d).groupBy("conv_id").agg(F.max_by("cid", "turn").alias("start"))
    return graph.lineage(A.nodes(spark, d), heads.select("start")).select("start", "cid", "depth")


@query(A.STAR_SQL + "SELECT parent_cid, child_cid, ordinal, kind, agent FROM edges JOIN nodes ON nodes.cid = child_cid")
def children(spark, d):
    nodes = A.star_nodes(spark, d)
    return graph.children_of(A.star_edges(spark, d), nodes, nodes).select("parent_cid", "child_cid", "ordinal", "kind", "agent")


@query(A.STAR_SQL + "SELECT child_cid, parent_cid, ordinal, kind, agent FROM edges JOIN nodes ON nodes.cid = parent_cid")
def parents(spark, d):
    nodes = A.star_nodes(spark, d)
    return graph.parents_of(A.star_edges(spark, d), nodes, nodes).select("child_cid", "parent_cid", "ordinal", "kind", "agent")


@query(A.STAR_SQL + "SELECT cid, kind FROM nodes WHERE cid NOT IN (SELECT child_cid FROM edges)")
def roots(spark, d):
    return graph.roots(A.star_nodes(spark, d), A.star_edges(spark, d, once=False)).select("cid", "kind")


@query(A.STAR_SQL + "SELECT cid, kind FROM nodes WHERE cid NOT IN (SELECT parent_cid FROM edges)")
def leaves(spark, d):
    return graph.leaves(A.star_nodes(spark, d), A.star_edges(spark, d, once=False)).select("cid", "kind")


@query(A.STAR_SQL + "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def counts_by_kind(spark, d):
    return projection.counts_by(A.star_nodes(spark, d), "kind")


@query("SELECT source AS agent, count(*) AS n FROM documents GROUP BY 1")
def counts_by_agent(spark, d):
    return projection.counts_by(A.document_nodes(spark, d), "agent")


@query(A.NODES_SQL + "SELECT cid FROM n UNION SELECT json_extract_string(json, '$.output_cid') FROM n UNION SELECT unnest(from_json(json_extract(json, '$.parents'), '[\"VARCHAR\"]')) FROM n")
def referenced(spark, d):
    return B.referenced(A.nodes(spark, d))


_ORPHANS = A.BLOBS_SQL + ", refs AS (SELECT cid FROM n UNION SELECT json_extract_string(json, '$.output_cid') FROM n) "


@query(_ORPHANS + "SELECT cid, size FROM blobs WHERE cid NOT IN (SELECT cid FROM refs)")
def gc_orphans(spark, d):
    blobs = A.all_blobs(spark, d)
    return B.orphans(blobs, graph.nodes_of(blobs)).select("cid", "size")


@query(_ORPHANS + "SELECT cid, size FROM blobs WHERE cid NOT IN (SELECT cid FROM refs)")
def gc_orphans_by_filter(spark, d):
    """The same with the filters of two halves of the nodes, which are merged; only what may be referred to is joined."""
    blobs = written(A.all_blobs(spark, d), "blobs")
    nodes = graph.nodes_of(blobs)
    halves = [nodes.where(F.pmod(F.xxhash64("cid"), F.lit(2)) == i) for i in (0, 1)]
    words = bloom.merged([bloom.build(B.referenced(h), "cid") for h in halves])
    return bloom.orphans(blobs, nodes, words).select("cid", "size")


@query(_ORPHANS + "SELECT count(*) AS orphans, coalesce(sum(size), 0)::BIGINT AS orphan_bytes FROM blobs WHERE cid NOT IN (SELECT cid FROM refs)")
def gc_report(spark, d):
    blobs = A.all_blobs(spark, d)
    return B.gc_report(blobs, graph.nodes_of(blobs))


@query(_ORPHANS + "SELECT count(*) AS total, sum(size)::BIGINT AS bytes, count(*) FILTER (cid IN (SELECT cid FROM n)) AS nodes, count(*) FILTER (cid NOT IN (SELECT cid FROM n) AND cid IN (SELECT cid FROM refs)) AS content, count(*) FILTER (cid NOT IN (SELECT cid FROM refs)) AS orphan FROM blobs")
def cas_stats(spark, d):
    blobs = A.all_blobs(spark, d)
    return B.cas_stats(blobs, graph.nodes_of(blobs))


@query("SELECT lang AS schema_cid, count(*) AS total_nodes, count(DISTINCT sha256(text)) AS unique_outputs, printf('%.2f', count(*)::DOUBLE / count(DISTINCT sha256(text))) AS dedup_ratio FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def schema_stats(spark, d):
    return graph.schema_stats(A.document_nodes(spark, d))


@query(A.NODES_SQL + "SELECT DISTINCT cid, json_extract_string(json, '$.kind') AS kind FROM n WHERE json_extract_string(json, '$.kind') = 'reasoning' ORDER BY cid LIMIT 50")
def dag_ls(spark, d):
    return graph.list_nodes(A.nodes(spark, d), "reasoning", 50).select("cid", "kind")


# Projection


def _diff_sql(actual: str) -> str:
    """Edges of one table only, or with other values in both: counted, not joined."""
    return (
        A.EDGES_SQL + f", a AS ({actual}), b AS (SELECT *, 1 AS side FROM edges UNION ALL SELECT *, 2 FROM a) "
        "SELECT parent_cid, child_cid, CASE WHEN max(side) = 1 THEN 'missing' WHEN min(side) = 2 THEN 'extra' ELSE 'mismatched' END AS status "
        "FROM b GROUP BY 1, 2 HAVING min(side) = max(side) OR count(DISTINCT (ordinal, edge_kind)) > 1"
    )


_K = "(split_part({p}, ':', 2)::BIGINT * 7 + split_part({c}, ':', 2)::BIGINT) % 10".format(p="parent_cid", c="child_cid")


@query(_diff_sql(f"SELECT parent_cid, child_cid, ordinal, CASE WHEN {_K} = 1 THEN 'proposes' ELSE edge_kind END AS edge_kind FROM edges WHERE {_K} <> 0 UNION ALL SELECT 'x' || parent_cid, child_cid, ordinal, edge_kind FROM edges WHERE {_K} = 2"))
def projection_diff(spark, d):
    """A projection that lost, changed and gained edges, against what the nodes say."""
    e = A.star_edges(spark, d)
    number = lambda c: F.split_part(c, F.lit(":"), F.lit(2)).cast("long")
    k = (number(F.col("parent_cid")) * 7 + number(F.col("child_cid"))) % 10
    changed = e.where(k != 0).withColumn("edge_kind", F.when(k == 1, "proposes").otherwise(F.col("edge_kind")))
    return projection.diff_edges(e, changed.union(e.where(k == 2).withColumn("parent_cid", F.concat(F.lit("x"), "parent_cid"))))


_CHANGED = f"SELECT parent_cid, child_cid, ordinal, CASE WHEN {_K} = 1 AND ordinal = 0 THEN 'proposes' ELSE edge_kind END AS edge_kind FROM edges WHERE {_K} <> 0 OR ordinal = 1"


@query(_diff_sql(_CHANGED))
def projection_diff_by_digest(spark, d):
    """Edges of orders and above were lost and changed; only the key ranges with other digests are joined."""
    e = A.star_edges(spark, d)
    number = lambda c: F.split_part(c, F.lit(":"), F.lit(2)).cast("long")
    k = (number(F.col("parent_cid")) * 7 + number(F.col("child_cid"))) % 10
    changed = e.where((k != 0) | (F.col("ordinal") == 1)).withColumn("edge_kind", F.when((k == 1) & (F.col("ordinal") == 0), "proposes").otherwise(F.col("edge_kind")))
    return digests.diff_edges(e, changed)


@query(_diff_sql("SELECT CASE WHEN length(child_cid) % 3 = 1 THEN 'x' ELSE '' END || parent_cid AS parent_cid, child_cid, ordinal, CASE WHEN length(parent_cid) % 3 = 0 THEN 'proposes' ELSE edge_kind END AS edge_kind FROM edges"))
def projection_audit(spark, d):
    e = A.star_edges(spark, d)
    a = e.select(F.concat(F.when(F.length("child_cid") % 3 == 1, "x").otherwise(""), "parent_cid").alias("parent_cid"), "child_cid", "ordinal", F.when(F.length("parent_cid") % 3 == 0, "proposes").otherwise(F.col("edge_kind")).alias("edge_kind"))
    return projection.diff_edges(e, a)


@query(A.ORDER_EDGES_SQL + "SELECT output_cid, ps[ordinal + 1] AS parent_cid, CASE WHEN ordinal = 0 THEN 'missing' ELSE 'mismatched' END AS status FROM i WHERE ordinal < 2")
def projection_verify(spark, d):
    """Edges of stored nodes against a table without their first ones, with the second ones changed."""
    # One shuffle serves the nodes and the table that is made from them.
    stored = graph.gathered(graph.nodes_of(A.order_node_blobs(spark, d)), "output_cid")
    kept = graph.links_of(stored.dropDuplicates(["cid"]).select("cid", "node.*")).where("ordinal > 0").withColumn("edge_kind", F.when(F.col("ordinal") == 1, "proposes").otherwise(F.col("edge_kind")))
    return projection.verify(stored.select("cid", "node.*"), kept, "output_cid").select("output_cid", "parent_cid", "status")


@query(A.EDGES_SQL + "SELECT parent_cid, child_cid, ordinal, CASE WHEN parent_cid LIKE 'c:%' THEN 'proposes' ELSE edge_kind END AS edge_kind FROM edges")
def sync_edges(spark, d):
    """Edges of nodes that are projected again: what is there stays as it is, what is new is added once."""
    e = A.star_edges(spark, d)
    stored = e.where("parent_cid LIKE 'c:%'").withColumn("edge_kind", F.lit("proposes"))
    return projection.insert_ignore(stored, e.union(e), projection.EDGE_KEY, ["ordinal"])


@query(A.EDGES_SQL + "SELECT parent_cid, child_cid, ordinal, edge_kind FROM edges")
def dag_edges(spark, d):
    return projection.dag_edges(A.star_edges(spark, d))


@query("SELECT 'doc:' || doc_id AS cid, lang AS kind, source AS agent, lpad(doc_id::VARCHAR, 12, '0') AS created_at FROM documents")
def dag_nodes(spark, d):
    return projection.list_dag_nodes(A.document_nodes(spark, d)).select("cid", "kind", "agent", "created_at")


@query("SELECT (SELECT count(*) FROM orders) AS purged, (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) AS written")
def projection_rebuild(spark, d):
    nodes = graph.nodes_of(A.order_node_blobs(spark, d))
    return projection.rebuild(nodes, t(spark, d, "orders"))[1]


@query(A.NODES_SQL + "SELECT DISTINCT cid, json_extract_string(json, '$.kind') AS kind, json_extract_string(json, '$.agent') AS agent FROM n WHERE turn > 0 AND cid NOT IN (SELECT cid FROM n WHERE turn = 0)")
def repair_missing(spark, d):
    """Nodes that a projection with the first turns only lacks."""
    first = A.conversation_nodes(spark, d).where("turn = 0").select("cid")
    return projection.repair(A.nodes(spark, d), first).select("cid", "kind", "agent")


_COUNTED = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _COUNTED))
def stats(spark, d):
    """Nine tables, as many as the projection has."""
    return projection.stats({n: t(spark, d, n) for n in _COUNTED})


_LINKS_SQL = "WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY 1), l AS (SELECT 'doc:' || first AS from_cid, 'doc:' || doc_id AS to_cid, 'duplicates' AS relation FROM documents JOIN f USING (text) WHERE doc_id <> first)\n"


def _links(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").where("doc_id <> first").select(F.concat(F.lit("doc:"), "first").alias("from_cid"), F.concat(F.lit("doc:"), "doc_id").alias("to_cid"), F.lit("duplicates").alias("relation"), F.lit(A.TS).alias("created_at"))


@query(_LINKS_SQL + "SELECT * FROM l")
def soft_links(spark, d):
    return _links(spark, d).select("from_cid", "to_cid", "relation")


for _direction, _where in (("from", "from_cid = (SELECT min(from_cid) FROM l)"), ("to", "to_cid = (SELECT min(to_cid) FROM l)"), ("both", "from_cid = (SELECT min(from_cid) FROM l) OR to_cid = (SELECT min(from_cid) FROM l)")):

    def _one(spark, d, direction=_direction):
        links = _links(spark, d)
        at = links.agg(F.min("to_cid" if direction == "to" else "from_cid")).first()[0]
        return projection.soft_links(links, at or "", direction, "duplicates").select("from_cid", "to_cid", "relation")

    _one.__name__ = f"soft_links_{_direction}"
    query(_LINKS_SQL + f"SELECT * FROM l WHERE {_where}")(_one)


# Search


@query(A.BLOBS_SQL + "SELECT cid, left(data, 200) AS snippet FROM blobs WHERE contains(lower(data), 'thou') ORDER BY cid LIMIT 20")
def search(spark, d):
    return graph.search(A.all_blobs(spark, d), "Thou")


@query("WITH b AS (SELECT DISTINCT text FROM documents), s AS (SELECT sha256(text) AS cid, string_split(text, chr(10)) AS ls FROM b WHERE contains(lower(text), 'rights reserved')), u AS (SELECT cid, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM s) SELECT cid, line_no::INT AS line_no, line FROM u WHERE contains(lower(line), 'rights reserved')")
def search_lines(spark, d):
    return graph.search_lines(B.blobs_of(t(spark, d, "documents"), F.col("text")), "Rights Reserved", None)


def _indexed(spark, blobs):
    blobs, path = written(blobs, "blobs"), folder(spark, "trigrams")
    ngrams.build(blobs, path)
    return blobs, path


@query(A.BLOBS_SQL + "SELECT cid, left(data, 200) AS snippet FROM blobs WHERE contains(lower(data), 'thou')")
def search_indexed(spark, d):
    """All blobs with a text, by an index of all blobs."""
    return ngrams.search(*_indexed(spark, A.all_blobs(spark, d)), "Thou", None)


@query(ORACLES["search_lines"])
def search_lines_indexed(spark, d):
    return ngrams.search_lines(*_indexed(spark, B.blobs_of(t(spark, d, "documents"), F.col("text"))), "Rights Reserved", None)


@query(A.NODES_SQL + "SELECT DISTINCT n.cid, c.text AS content FROM n JOIN conversations c USING (conv_id, turn)")
def reasoning_text(spark, d):
    blobs = A.all_blobs(spark, d)
    nodes = graph.nodes_of(blobs)
    return graph.reasoning(nodes, blobs, nodes.select("cid")).select("cid", "content")


@query(A.NODES_SQL + "SELECT DISTINCT n.cid AS node_cid, to_base64(encode(json)) AS node_bytes, sha256(text) AS output_cid, to_base64(encode(text)) AS output_bytes FROM n JOIN conversations c USING (conv_id, turn)")
def export_bundle(spark, d):
    """Bundle entries of the lineages of all heads, which are all nodes."""
    blobs = A.all_blobs(spark, d)
    heads = A.conversation_nodes(spark, d).groupBy("conv_id").agg(F.max_by("cid", "turn").alias("start"))
    return graph.bundles(graph.nodes_of(blobs), blobs, heads.select("start"))


@query(A.BLOBS_SQL + "SELECT DISTINCT x.cid, strlen(x.data) AS size FROM blobs x WHERE x.cid IN (SELECT cid FROM n UNION SELECT sha256(text) FROM conversations)")
def import_bundle(spark, d):
    return graph.unbundle(export_bundle(spark, d)).select("cid", "size")


@query(A.STAR_SQL + "SELECT '  \"' || left(child_cid, 12) || '\" -> \"' || left(parent_cid, 12) || '\";' AS line FROM edges")
def dot_edges(spark, d):
    return graph.dot(A.star_nodes(spark, d), A.star_edges(spark, d)).where("part = 2").select("line")


# Scores


_SCORE_ID = "sha256(concat_ws(chr(31), {node}, {agent}, {scorer}, {dimension}, ({value})::FLOAT::VARCHAR, {evidence}, lpad({at}::VARCHAR, 12, '0')))"


@query(f"SELECT {_SCORE_ID.format(node="'doc:' || doc_id", agent='source', scorer="'label'", dimension="'correctness'", value='quality', evidence="'q' || quality", at='doc_id')} AS id, 'doc:' || doc_id AS node_cid, source AS agent, 'correctness' AS dimension, quality::DOUBLE AS value FROM labels JOIN documents USING (doc_id)")
def score_records(spark, d):
    """Scores as they are stored: checked, and named by a digest."""
    both = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    rows = both.select(F.concat(F.lit("doc:"), "doc_id").alias("node_cid"), F.col("source").alias("agent"), F.lit("label").alias("scorer"), F.lit("Correctness").alias("dimension"), F.col("quality").alias("value"), F.concat(F.lit("q"), "quality").alias("evidence"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at"))
    return scores.record(rows).select("id", "node_cid", "agent", "dimension", F.col("value").cast("double").alias("value"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'correctness' WHEN 'view' THEN 'completeness' ELSE 'style' END AS dimension, CASE WHEN event_id % 2 = 0 THEN 1.0 WHEN event_type = 'error' THEN 0.3::FLOAT::DOUBLE ELSE 0.0 END::DOUBLE AS value, CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'click' THEN 'build' WHEN 'view' THEN 'test' ELSE 'lint' END || ' passed' ELSE '1; 2; 3; 4; 5' END AS evidence FROM events WHERE event_type IN ('click', 'view', 'error')")
def auto_scores(spark, d):
    """Scores from what builds, tests and lint runs returned."""
    kind = F.col("event_type")
    step = F.when(kind == "click", "build").when(kind == "view", "test").when(kind == "error", "lint").otherwise("deploy")
    e = t(spark, d, "events").select(F.col("event_id").cast("string").alias("node_cid"), F.lit("a").alias("agent"), step.alias("step"), (F.col("event_id") % 2).alias("exit_code"), F.lit("1\n2\n3\n4\n5\n6").alias("stderr"), F.lit(A.TS).alias("created_at"))
    return scores.auto_scores(e).select(F.col("node_cid").cast("long").alias("event_id"), "dimension", F.col("value").cast("double").alias("value"), "evidence")


@query(A.SCORES_SQL + "SELECT agent, dimension, round(avg(value), 3) AS avg_score, count(*) AS n FROM s GROUP BY 1, 2")
def score_profile(spark, d):
    return scores.profile(A.document_scores(spark, d))


@query(A.SCORES_SQL + ", p AS (SELECT agent, dimension, round(avg(value), 3) AS avg_score FROM s GROUP BY 1, 2) SELECT dimension, agent, avg_score FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY avg_score DESC, agent) AS k FROM p) WHERE k = 1")
def best_agent(spark, d):
    return scores.best_agents(A.document_scores(spark, d))


@query(A.SCORES_SQL + "SELECT agent, round(avg(value) FILTER (dimension = 'correctness'), 3) AS correctness, NULL::DOUBLE AS efficiency, round(avg(value) FILTER (dimension = 'style'), 3) AS style, NULL::DOUBLE AS completeness, NULL::DOUBLE AS decay_adjusted_activation, count(*) AS total FROM s GROUP BY 1")
def agent_pivot(spark, d):
    return scores.agent_profile(A.document_scores(spark, d))


def _kept_up(spark, scores, by):
    """Rollups after three appends of different sizes."""
    path = folder(spark, "rollups")
    for low, high in ((0, 1), (1, 4), (4, 16)):
        rollups.append(path, scores.where(F.pmod(F.xxhash64(by), F.lit(16)).between(low, high - 1)))
    return rollups.read(spark, path)


@query(ORACLES["score_profile"])
def rollup_profile(spark, d):
    scored = A.document_scores(spark, d).withColumn("at", F.lit(None).cast("double"))
    return rollups.profile(_kept_up(spark, scored, "node_cid")).drop("recent")


@query(ORACLES["best_agent"])
def rollup_routes(spark, d):
    scored = A.document_scores(spark, d).withColumn("at", F.lit(None).cast("double"))
    return rollups.best_agents(_kept_up(spark, scored, "node_cid"))


@query(A.EVENT_SCORES_SQL + f", w AS (SELECT *, pow(2.0, (sec - max(sec) OVER ()) / {rollups.HALF_LIFE}) AS weight FROM s) SELECT agent, " + ", ".join(f"round(avg(value) FILTER (dimension = '{x}'), 3) AS {x}" for x in DIMENSIONS) + ", count(*) AS total, round(sum(value * weight) / sum(weight), 6) AS recent FROM w GROUP BY 1")
def rollup_agents(spark, d):
    """Profiles of all dimensions from rollups of events, with the mean in which recent scores count more."""
    return rollups.agent_profile(_kept_up(spark, A.event_scores(spark, d), "event_id"))


@query(A.SCORES_SQL + "SELECT dimension, value, CASE WHEN value >= 0.8 THEN 'PASS' WHEN value >= 0.3 THEN 'WARN' ELSE 'FAIL' END AS icon FROM s WHERE node_cid = 'doc:4'")
def scores_for_node(spark, d):
    found = scores.for_node(A.document_scores(spark, d), "doc:4")
    return found.select("dimension", F.col("value").cast("double").alias("value"), scores.icon(F.col("value")).alias("icon"))


@query(A.SCORES_SQL.replace("WITH s", A.DOC_NODES_SQL.strip() + ", s") + ", m AS (SELECT node_cid, avg(value) AS mean FROM s GROUP BY 1) SELECT cid, round(greatest(coalesce(1 - saturation::DOUBLE, 1 - mean, 1.0), 0.0), 9) AS info_potential FROM d LEFT JOIN m ON node_cid = cid")
def info_potential(spark, d):
    nodes = A.document_nodes(spark, d)
    tree = allocate.potentials(nodes.select("cid"), nodes, scores.mean_scores(A.document_scores(spark, d)))
    return tree.select("cid", F.round("info_potential", 9).alias("info_potential"))


@query(A.DOC_NODES_SQL + "SELECT kind, count(*) FILTER (coalesce(saturation >= 1, false)) AS claims, count(*) FILTER (saturation IS NULL OR saturation = 0) AS queries, count(*) AS n FROM d GROUP BY 1")
def saturation_classes(spark, d):
    s = F.col("saturation")
    return A.document_nodes(spark, d).groupBy("kind").agg(F.count_if(N.is_claim(s)).alias("claims"), F.count_if(N.is_query(s)).alias("queries"), F.count(F.lit(1)).alias("n"))


@query(A.DOC_NODES_SQL + "SELECT cid FROM d WHERE saturation IS NULL OR saturation = 0")
def open_queries(spark, d):
    return projection.open_queries(A.document_nodes(spark, d)).select("cid")


@query(A.DOC_NODES_SQL + "SELECT cid FROM d WHERE saturation >= 1")
def settled_claims(spark, d):
    return projection.settled_claims(A.document_nodes(spark, d)).select("cid")


@query(A.DOC_NODES_SQL + "SELECT cid, saturation::DOUBLE AS saturation FROM d WHERE saturation < 0.5::FLOAT")
def below_saturation(spark, d):
    return projection.below_saturation(A.document_nodes(spark, d), 0.5).select("cid", F.col("saturation").cast("double").alias("saturation"))


_DECAY_LIFE = "CASE WHEN event_type = 'click' THEN 3600.0 WHEN event_type = 'view' THEN 86400.0 WHEN event_type <> 'error' THEN 604800.0 END"


@query(f"WITH e AS (SELECT event_id, value, {_DECAY_LIFE} AS h, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 1000000.0 AS s FROM events) SELECT event_id, round(CASE WHEN h IS NULL THEN value ELSE greatest(value * exp(-s * ln(2.0) / h), 0.1) END, 9) AS activation FROM e")
def decay(spark, d):
    e = t(spark, d, "events")
    elapsed = (F.unix_micros(F.lit("2024-03-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000000
    config = F.expr(f"CASE WHEN ({_DECAY_LIFE}) IS NOT NULL THEN named_struct('half_life_secs', cast({_DECAY_LIFE} AS double), 'activation_floor', 0.1D) END")
    return e.select("event_id", F.round(N.decayed_activation(F.col("value"), config, elapsed), 9).alias("activation"))


# Allocation


@query(A.EVENT_TREE_SQL + "SELECT coalesce(count(h) >= 2 AND stddev_pop(h) / avg(h) > 0.5, false) AS heterogeneous FROM tree")
def hetero_decay(spark, d):
    return allocate.heterogeneous(A.event_tree(spark, d))


def _tier_sql(c, dd, t3):
    s, m, x = f"(p * 0.3 - {c} * 1.0 - {dd} * d)", f"(p * 0.7 - {c} * 2.0 - {dd} * d)", f"(p * 1.0 - {c} * 4.0 - {dd} * d - {t3})"
    best = f"greatest(0.0, {s}, {m}, {x})"
    return f"CASE WHEN {best} <= 0 THEN 'skip' WHEN {s} = {best} THEN 'shallow' WHEN {m} = {best} THEN 'moderate' ELSE 'deep' END"


_COST = "CASE {t} WHEN 'skip' THEN 0.0 WHEN 'shallow' THEN 1.0 WHEN 'moderate' THEN 2.0 ELSE 4.0 END"
_GAIN = "CASE {t} WHEN 'skip' THEN 0.0 WHEN 'shallow' THEN 0.3 WHEN 'moderate' THEN 0.7 ELSE 1.0 END"


@query(A.EVENT_TREE_SQL + f", s AS (SELECT cid, p, {_tier_sql('0.05::DOUBLE', '0.01::DOUBLE', '0.2::DOUBLE')} AS tier FROM tree) SELECT cid, tier, round(p * {_GAIN.format(t='tier')}, 9) AS gain, ({_COST.format(t='tier')})::DOUBLE AS cost FROM s")
def tier_solve(spark, d):
    return allocate.solve(A.event_tree(spark, d), 0.05, 0.01, 0.2).select("cid", "tier", F.round("gain", 9).alias("gain"), "cost")


@query(
    A.EVENT_TREE_SQL
    + f", hist AS (SELECT p, d, count(*) AS n FROM tree GROUP BY 1, 2), g AS (SELECT i, j, k, 10.0::DOUBLE * i / 10 AS lc, 10.0::DOUBLE * j / 10 AS lt, k::DOUBLE / 10 AS ld FROM range(11) a(i), range(11) b(j), range(11) c(k)), x AS (SELECT i, j, k, p, n, {_tier_sql('lc', 'ld', 'lt')} AS tier FROM hist, g)"
    + f", s AS (SELECT i, j, k, sum(p * {_GAIN.format(t='tier')} * n) AS gain, sum({_COST.format(t='tier')} * n)::DOUBLE AS cost, sum(CASE WHEN tier = 'deep' THEN n ELSE 0 END)::BIGINT AS tier3 FROM x GROUP BY 1, 2, 3) SELECT i::INT AS i, j::INT AS j, k::INT AS k, round(gain, 4)::DOUBLE AS gain, cost, tier3 FROM s WHERE cost <= 10000 AND tier3 <= 2000"
)
def lambda_grid(spark, d):
    found = allocate.lambda_grid(A.event_tree(spark, d), allocate.Constraints(10000, 20, 2000))
    return found.select("i", "j", "k", F.round("gain", 4).alias("gain"), "cost", "tier3")


def _calibrate_sql(limits: allocate.Constraints) -> str:
    """Plain trials by halvings, nested: a price is a number of steps, found bit by bit; the histogram is one list."""
    halvings = f"{[0] + [1 << k for k in reversed(range(allocate.STEPS))]}::BIGINT[]"
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    price = lambda top, k: f"({top}::DOUBLE * ({k}) / {1 << allocate.STEPS}::DOUBLE)"
    least = lambda k, step, holds: f"(list_reduce({halvings}, lambda {k}, {step}: {k} + CASE WHEN {holds} THEN 0 ELSE {step} END) + 1)"
    net = lambda x, c, d, t: [f"({x}.p * 0.3 - {c} * 1.0 - {d} * {x}.d)", f"({x}.p * 0.7 - {c} * 2.0 - {d} * {x}.d)", f"({x}.p * 1.0 - {c} * 4.0 - {d} * {x}.d - {t})"]
    by_tier = lambda x, c, d, t, of: "CASE WHEN greatest(0.0, {0}, {1}, {2}) <= 0 THEN 0 WHEN {0} >= greatest({1}, {2}) THEN {3} WHEN {1} >= {2} THEN {4} ELSE {5} END".format(*net(x, c, d, t), *of)
    total = lambda c, d, t, of: f"coalesce(list_sum(list_transform(h, lambda x: x.n * {by_tier('x', c, d, t, of)})), 0)"
    unused = lambda c, d, t: "len(list_filter(tops, lambda z: greatest({}, {}, {}) > 0)) = 0".format(*net("z", c, d, t))
    depth = lambda c, t: price(allocate.TOP_DEPTH, least("i", "si", let("ld", price(allocate.TOP_DEPTH, "i + si"), unused(c, "ld", t))))
    deep_kept = let("ot", depth("lc", "lt"), total("lc", "ot", "lt", (0, 0, 1)) + f" <= {limits.max_tier3}")
    deep = lambda c: price(allocate.TOP_TIER3, least("j", "sj", let("lt", price(allocate.TOP_TIER3, "j + sj"), deep_kept)))
    both = lambda c, body: let("lc", c, let("bt", deep("lc"), let("bd", depth("lc", "bt"), body)))
    cost_kept = both(price(allocate.TOP_COST, "k + sk"), total("lc", "bd", "bt", (1, 2, 4)) + f" <= {limits.max_cost}")
    tried = f"[((steps - 1) >> (s + 1) << (s + 1)) + (1 << s) for s in range({allocate.STEPS - 1}, -1, -1) if ((steps - 1) >> s) & 1 = 0]"
    gain = both("c", "{'c': lc, 'd': bd, 't': bt, 'gain': " + total("lc", "bd", "bt", ("x.p * 0.3", "x.p * 0.7", "x.p * 1.0")) + "}")
    solved = f"CASE WHEN best IS NULL THEN 'skip' ELSE {_tier_sql('best.c', 'best.d', 'best.t')} END"
    return (
        A.EVENT_TREE_SQL + f", hist AS (SELECT p, d, count(*) AS n FROM tree GROUP BY 1, 2), lists AS (SELECT (SELECT list({{'p': p, 'd': d, 'n': n}}) FROM hist) AS h, coalesce((SELECT list({{'p': p, 'd': d}}) FROM (SELECT d, max(p) AS p FROM hist WHERE d > {limits.max_depth} GROUP BY 1)), []) AS tops)"
        f", found AS (SELECT h, tops, {least('k', 'sk', cost_kept)} AS steps FROM lists), kept AS (SELECT h, tops, unnest({tried}) AS k FROM found), priced AS (SELECT list_transform([{price(allocate.TOP_COST, 'k')}], lambda c: {gain})[1] AS x FROM kept)"
        f", best AS (SELECT arg_max(x, (round(x.gain, 6), x.c)) FILTER (x.gain > 0) AS best FROM priced), s AS (SELECT cid, p, {solved} AS tier FROM tree, best)"
        f" SELECT cid, tier, round(p * {_GAIN.format(t='tier')}, 9) AS gain, ({_COST.format(t='tier')})::DOUBLE AS cost FROM s"
    )


_EVENT_LIMITS = allocate.Constraints(10000, 3, 2000)


@query(_calibrate_sql(_EVENT_LIMITS))
def wqs_calibrate(spark, d):
    """Tiers of the events under prices found by bisection; all half-lives are taken as one."""
    tree = A.event_tree(spark, d).withColumn("half_life_secs", F.lit(3600.0))
    return allocate.optimise(tree, _EVENT_LIMITS)[1].select("cid", "tier", F.round("gain", 9).alias("gain"), "cost")


@query("SELECT 'c' || doc_id AS cid, 'r3' AS root_cid, lpad(doc_id::VARCHAR, 12, '0') AS ts, n_chars::DOUBLE AS total_gain FROM documents WHERE doc_id % 7 = 3")
def calibration_history(spark, d):
    return allocate.history(A.calibrations(spark, d), "r3")


@query("SELECT 'c' || doc_id AS cid, 'r' || doc_id % 7 AS root_cid, lpad(doc_id::VARCHAR, 12, '0') AS ts, n_chars::DOUBLE AS total_gain FROM documents WHERE doc_id = 5")
def calibration_inspect(spark, d):
    return allocate.inspect(A.calibrations(spark, d), "c5")


_TREE_SQL = A.STAR_SQL + ", w AS (SELECT cid AS root, cid, NULL::VARCHAR AS parent_cid, 0 AS depth FROM nodes WHERE kind = 'region' UNION ALL SELECT w.root, e.child_cid, w.cid, w.depth + 1 FROM w JOIN edges e ON e.parent_cid = w.cid) "


@query(_TREE_SQL + "SELECT root, cid, parent_cid, depth::INT AS depth FROM w")
def spanning_tree(spark, d):
    nodes = A.star_nodes(spark, d)
    return graph.spanning_tree(nodes, A.star_edges(spark, d), nodes.where("kind = 'region'"))


@query(
    A.STAR_SQL
    + ", w AS (SELECT cid AS root, cid, 0 AS depth, 'deep' AS tier FROM nodes WHERE kind = 'region' UNION ALL SELECT w.root, e.child_cid, w.depth + 1, CASE length(e.child_cid) % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'shallow' WHEN 2 THEN 'moderate' ELSE 'deep' END FROM w JOIN edges e ON e.parent_cid = w.cid WHERE w.tier <> 'skip')"
    + " SELECT root, cid, depth::INT AS depth, tier, tier = 'skip' AS pruned FROM w"
)
def traverse(spark, d):
    nodes, r = A.star_nodes(spark, d), F.length("cid") % 4
    tiers = nodes.select("cid", F.when(F.col("kind") == "region", "deep").when(r == 0, "skip").when(r == 1, "shallow").when(r == 2, "moderate").otherwise("deep").alias("tier"), F.lit(1.0).alias("info_potential"))
    return allocate.traverse(tiers, A.star_edges(spark, d), nodes, nodes.where("kind = 'region'")).select("root", "cid", "depth", "tier", "pruned")


# Log, drift, snapshots, versions


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS cid, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN sha256(text || '!') ELSE sha256(text) END AS current_cid, CASE doc_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'DRIFTED' ELSE 'OK' END AS status FROM documents")
def drift(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id"), "text")
    current = docs.where(F.col("doc_id") % 5 != 0).select("path", F.sha2(F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("current_cid"))
    return audit.drift(docs.select("path", F.sha2("text", 256).alias("cid")), current)


@query("WITH s AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), f AS (SELECT sha256(text) AS cid, length(text) % 7 = 0 AS bad FROM s), n AS (SELECT unnest([sha256(doc_id::VARCHAR), sha256(text)]) AS cid FROM documents) SELECT 'v1' AS name, count(*) FILTER (NOT bad) AS present, count(*) FILTER (bad IS NULL) AS missing, count(*) FILTER (bad) AS corrupted, count(*) FILTER (bad OR bad IS NULL) = 0 AS ok FROM n LEFT JOIN f USING (cid)")
def snapshot_verify(spark, d):
    """A snapshot over blobs of which some were damaged and some are missing."""
    docs = t(spark, d, "documents")
    nodes = docs.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cid"), F.sha2("text", 256).alias("output_cid"))
    blobs = B.blobs_of(docs, F.col("text"))
    text = F.col("data").cast("string")
    damaged = blobs.withColumn("data", F.when(F.length(text) % 7 == 0, F.concat(text, F.lit("x")).cast("binary")).otherwise(F.col("data")))
    return audit.verify_snapshot(audit.snapshot(nodes, "v1", A.TS), damaged)


@query("SELECT 'v' || doc_id % 3 AS name, 't' || doc_id % 3 AS created_at, count(*) AS n_nodes FROM documents GROUP BY 1, 2")
def snapshot_ls(spark, d):
    nodes = t(spark, d, "documents")
    third = (F.col("doc_id") % 3).cast("string")
    taken = nodes.select(F.concat(F.lit("v"), third).alias("name"), F.concat(F.lit("t"), third).alias("created_at"), F.sha2("text", 256).alias("node_cid"))
    return audit.snapshots(taken)


_LOG_SQL = "WITH l AS (SELECT doc_id AS seq, source AS path, sha256(text) AS cid FROM documents WHERE doc_id % 17 <> 5)\n"


@query(f"WITH x AS (SELECT doc_id AS seq, CASE WHEN doc_id % 17 = 5 THEN NULL ELSE source || ' -> ' || sha256(text) END AS detail FROM documents ORDER BY doc_id DESC LIMIT 100) SELECT seq, '{A.TS}' AS ts, 'put' AS event, detail FROM x WHERE detail IS NOT NULL")
def log_tail(spark, d):
    return oplog.tail(A.log_lines(spark, d), 100)


@query(_LOG_SQL + "SELECT path, arg_max(cid, seq) AS cid FROM l GROUP BY 1")
def log_heads(spark, d):
    return oplog.heads(oplog.parse(A.log_lines(spark, d)))


@query(_LOG_SQL + "SELECT path, seq, cid, lag(cid) OVER (PARTITION BY path ORDER BY seq) AS superseded FROM l")
def log_supersessions(spark, d):
    return oplog.supersessions(oplog.parse(A.log_lines(spark, d)))


@query(ORACLES["log_supersessions"])
def log_supersession_stream(spark, d):
    """The same by a stream over the log's files, which has every third line in each, so that lines come out of order."""
    source, sink, checkpoint = (folder(spark, f"log-{x}") for x in ("in", "out", "checkpoint"))
    A.log_lines(spark, d).repartition(3, F.col("seq") % 3).write.parquet(source)
    supersede.run(spark, source, sink, checkpoint, files=1, chunk=1 << 10).awaitTermination()
    return supersede.current(spark, sink)


_NEW_SQL = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '*' ELSE source END AS source FROM documents WHERE doc_id % 11 <> 0)"


@query(f"SELECT *, '-' AS change FROM (SELECT doc_id, source FROM documents EXCEPT ALL SELECT * FROM {_NEW_SQL}) UNION ALL SELECT *, '+' FROM (SELECT * FROM {_NEW_SQL} EXCEPT ALL SELECT doc_id, source FROM documents)")
def version_diff(spark, d):
    old = t(spark, d, "documents").select("doc_id", "source")
    new = old.where(F.col("doc_id") % 11 != 0).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("*"))).otherwise(F.col("source")))
    return diff(old, new)


# Tasks, agents, tracked files, symbols, SQL


@query("WITH e AS (SELECT user_id::VARCHAR AS id, lpad(event_id::VARCHAR, 12, '0') AS seq, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN NULL WHEN 'error' THEN 'failed' ELSE 'done' END AS status, CASE WHEN event_type = 'view' THEN 'agent' || event_id % 3 END AS assigned_to FROM events), f AS (SELECT id, seq, coalesce(status, CASE WHEN assigned_to IS NOT NULL THEN 'assigned' END) AS status, assigned_to FROM e) SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(assigned_to, seq) FILTER (assigned_to IS NOT NULL) AS assigned_to FROM f GROUP BY 1")
def tasks_fold(spark, d):
    e = t(spark, d, "events")
    kind = F.col("event_type")
    events = e.select(F.col("user_id").cast("string").alias("id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("seq"), F.when(kind == "click", "running").when(kind == "error", "failed").when(kind != "view", "done").alias("status"), F.when(kind == "view", F.concat(F.lit("agent"), F.col("event_id") % 3)).alias("assigned_to"), F.lit(None).cast("string").alias("result_cid"))
    none = F.lit(None).cast("string")
    created = events.select("id").distinct().select("id", F.lit("pending").alias("status"), none.alias("assigned_to"), none.alias("result_cid"), none.alias("updated_at"))
    return tasks.fold_tasks(created, events).select("id", "status", "assigned_to")


@query("SELECT 'a' || (l_suppkey % 50) AS name, arg_max(l_returnflag || ',' || l_linestatus, lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber || l_partkey || '-' || l_suppkey || l_returnflag || l_linestatus) AS capabilities FROM lineitem GROUP BY 1")
def agents_upsert(spark, d):
    li = t(spark, d, "lineitem")
    seq = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", F.lit("-"), "l_suppkey", "l_returnflag", "l_linestatus")
    rows = li.select(F.concat(F.lit("a"), F.col("l_suppkey") % 50).alias("name"), F.array("l_returnflag", "l_linestatus").alias("capabilities"), seq.alias("updated_at"))
    return tasks.register_agents(rows.select("name", F.array_join("capabilities", ",").alias("capabilities"), "updated_at").limit(0), rows).select("name", "capabilities")


@query("SELECT sha256(o_orderpriority || chr(31) || o_custkey || chr(31) || o_orderkey) AS id, o_orderpriority AS title, o_orderstatus AS status, o_custkey::VARCHAR AS created_by, o_orderkey::VARCHAR AS created_at FROM orders")
def task_list(spark, d):
    by, at = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    rows = t(spark, d, "orders").select(tasks.task_id(F.col("o_orderpriority"), by, at).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("assigned_to"), by.alias("created_by"), at.alias("created_at"))
    return tasks.list_tasks(rows).drop("assigned_to")


@query("SELECT 's' || s_suppkey AS name, '' AS capabilities FROM supplier UNION ALL SELECT * FROM (VALUES ('codex', 'x,y'), ('copilot', 'code,suggestion')) WHERE (SELECT count(*) FROM supplier) > 0 AND col0 IS NOT NULL")
def agent_list(spark, d):
    """Presets of which one is registered anew, and an agent for each supplier."""
    known = tasks.presets(spark, "1").where("name IN ('codex', 'copilot')")
    row = lambda name, said: (F.col(name) if name == "name" else F.lit(said)).alias(name)
    fresh = t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name")).union(spark.createDataFrame([("codex",)], "name string"))
    rows = fresh.select("name", F.lit("").alias("cli_command"), F.lit(False).alias("mcp_capable"), F.when(F.col("name") == "codex", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("capabilities"), row("model", ""), row("updated_at", "2"))
    return tasks.list_agents(tasks.register_agents(known, rows)).select("name", "capabilities")


@query(_LINKS_SQL + "SELECT from_cid, to_cid, relation FROM l UNION ALL SELECT to_cid, from_cid, 'copied' FROM l")
def soft_links_insert(spark, d):
    """Links that are added to others; a repeated key would fail."""
    links = _links(spark, d)
    more = links.select(F.col("to_cid").alias("from_cid"), F.col("from_cid").alias("to_cid"), F.lit("copied").alias("relation"), "created_at")
    return projection.insert(links, more, ["from_cid", "to_cid", "relation"]).select("from_cid", "to_cid", "relation")


@query("SELECT source AS path, arg_max(sha256(text), doc_id) AS cid FROM documents GROUP BY 1")
def context_files(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("path"), F.sha2("text", 256).alias("cid"), F.col("doc_id").alias("tracked_at"))
    return projection.replace_into(rows.limit(0), rows, ["path"], ["tracked_at"]).select("path", "cid")


@query("SELECT nullif(arg_max(sha256(text), doc_id), '') AS cid FROM documents WHERE source = (SELECT min(source) FROM documents)")
def tracked_cid(spark, d):
    """The address that is tracked for one path."""
    rows = t(spark, d, "documents").select(F.col("source").alias("path"), F.sha2("text", 256).alias("cid"), F.col("doc_id").alias("tracked_at"))
    return projection.tracked_cid(projection.replace_into(rows.limit(0), rows, ["path"], ["tracked_at"]), rows.agg(F.min("path")).first()[0] or "")


_SYMBOLS_SQL = """WITH s AS (
  SELECT 'd' || doc_id || '.py' AS file_path, unnest([
    {'name': 'import os', 'kind': 'import', 'a': 1, 'b': 1, 'p': NULL}, {'name': 'C' || doc_id, 'kind': 'class', 'a': 3, 'b': 5, 'p': NULL}, {'name': 'm' || doc_id % 10, 'kind': 'method', 'a': 4, 'b': 5, 'p': 'C' || doc_id},
    {'name': 'f' || doc_id % 10, 'kind': 'function', 'a': CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 7 END, 'b': CASE WHEN doc_id % 3 = 0 THEN 11 ELSE 8 END, 'p': NULL}]) AS x FROM documents
  UNION ALL SELECT 'd' || doc_id || '.rs', unnest([
    {'name': 'S' || doc_id, 'kind': 'struct', 'a': 2, 'b': 2, 'p': NULL}, {'name': 'S' || doc_id, 'kind': 'impl', 'a': 3, 'b': 5, 'p': NULL}, {'name': 'get', 'kind': 'function', 'a': 4, 'b': 4, 'p': 'S' || doc_id}, {'name': 'N' || doc_id % 10, 'kind': 'constant', 'a': 6, 'b': 6, 'p': NULL}]) FROM documents
), sym AS (SELECT file_path, x.name AS name, x.kind AS kind, x.a::INT AS start_line, x.b::INT AS end_line, x.p AS parent_symbol FROM s)
"""
_SYMBOL_COLUMNS = ["file_path", "name", "kind", "start_line", "end_line", "parent_symbol"]


@query(_SYMBOLS_SQL + "SELECT * FROM sym")
def symbol_extract(spark, d):
    """Two sources for every document, a third of the Python ones damaged in the middle."""
    return symbols.extract(A.source_files(spark, d)).select(*_SYMBOL_COLUMNS)


@query(_SYMBOLS_SQL + "SELECT kind, count(*) AS n FROM sym GROUP BY 1")
def symbol_stats(spark, d):
    return projection.counts_by(symbols.extract(A.source_files(spark, d)), "kind")


@query(_SYMBOLS_SQL + "SELECT * FROM sym WHERE name LIKE '%C_1%'")
def symbol_search(spark, d):
    """Wildcards of the text stay wildcards."""
    return projection.search_symbols(symbols.extract(A.source_files(spark, d)), "C_1").select(*_SYMBOL_COLUMNS)


@query(_SYMBOLS_SQL + "SELECT * FROM sym WHERE contains(lower(name), 'c1')")
def symbol_query(spark, d):
    return symbols.query(symbols.extract(A.source_files(spark, d)), "C1").select(*_SYMBOL_COLUMNS)


@query(_SYMBOLS_SQL + "SELECT * FROM sym WHERE kind = 'impl'")
def symbols_by_kind(spark, d):
    return projection.symbols_by_kind(symbols.extract(A.source_files(spark, d)), "impl").select(*_SYMBOL_COLUMNS)


@query(_SYMBOLS_SQL + "SELECT * FROM sym WHERE file_path = (SELECT min(file_path) FROM sym)")
def symbols_in_file(spark, d):
    found = symbols.extract(A.source_files(spark, d))
    return projection.symbols_in_file(found, A.source_files(spark, d).agg(F.min("file_path")).first()[0] or "").select(*_SYMBOL_COLUMNS)


@query(_SYMBOLS_SQL + "SELECT file_path, CASE WHEN ends_with(file_path, '.rs') THEN 'new_' || name ELSE name END AS name, kind, start_line, end_line, parent_symbol FROM sym")
def sync_symbols(spark, d):
    """Symbols of files that are scanned again take the place of those they had."""
    old = symbols.extract(A.source_files(spark, d)).select(*_SYMBOL_COLUMNS)
    again = old.where("endswith(file_path, '.rs')").withColumn("name", F.concat(F.lit("new_"), "name"))
    return projection.sync_symbols(old, again)


@query("SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'rust' END AS language, count(*) AS n FROM documents GROUP BY 1")
def detected_languages(spark, d):
    """By the ending of a path for every document; most endings have no language."""
    tail = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "de", "rs").otherwise(F.coalesce("lang", F.lit("")))
    paths = t(spark, d, "documents").select(F.concat(F.lit("a.b/c."), tail).alias("path"))
    return paths.groupBy(symbols.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100 + r_regionkey, 'new', r_regionkey FROM region")
def dml_batch(spark, d):
    """A batch of statements that change a table."""
    tables = {"nation": t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "region": t(spark, d, "region")}
    batch = ["DELETE FROM nation WHERE n_regionkey = 2", "UPDATE nation SET n_name = concat(upper(n_name), '!'), n_regionkey = 9 WHERE n_regionkey = 1", "INSERT INTO nation (n_regionkey, n_nationkey, n_name) SELECT r_regionkey, 100 + r_regionkey, 'new' FROM region"]
    return changed(spark, tables, batch)["nation"]


_RAW = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_returnflag, l_linestatus"


@query(_RAW)
def raw_sql(spark, d):
    t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_RAW)
