"""The driver's tables as tables of the data model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import blobs as B
from ..operators import graph
from ..schema import DIMENSIONS

TS = "2026-01-01T00:00:00+00:00"


#: Columns of the tables by their path, so that a table's footers are asked for them once in a process.
_columns: dict[str, StructType] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _columns:
        _columns[path] = spark.read.parquet(path).schema
    return spark.read.schema(_columns[path]).parquet(path)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = t(spark, sf_dir, "documents").select("text").union(t(spark, sf_dir, "conversations").select("text")).union(t(spark, sf_dir, "pages").select("html"))
    return texts.select(F.col("text").cast("binary").alias("data"))


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, json, cid``: canonical nodes; every turn derives from the one before it, so
    its address covers the whole conversation up to it.

    Turns stream by in order and only the last address is held, so no conversation is gathered."""
    said = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("out"))
    kinds = {"system": "context", "user": "memory", "assistant": "reasoning"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation = before = None
        for batch in batches:
            texts, cids = [], []
            for conv, role, out in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "out")), strict=True):
                parents = f'"{before}"' if conv == conversation and before else ""
                texts.append(f'{{"kind":"{kinds.get(role, "task")}","parents":[{parents}],"output_cid":"{out}","agent":"{role}","timestamp":"{TS}","meta":[]}}')
                cids.append(hashlib.sha256(texts[-1].encode()).hexdigest())
                conversation, before = conv, cids[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(cids, pa.string())], ["conv_id", "turn", "json", "cid"])

    ordered = said.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "out")
    return ordered.mapInArrow(run, f"conv_id {said.schema['conv_id'].dataType.simpleString()}, turn {said.schema['turn'].dataType.simpleString()}, json string, cid string")


NODES_SQL = f"""WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, sha256(text) AS out, CASE role WHEN 'system' THEN 'context' WHEN 'user' THEN 'memory' WHEN 'assistant' THEN 'reasoning' ELSE 'task' END AS kind FROM conversations
), chain AS (
  SELECT conv_id, turn, '{{"kind":"' || kind || '","parents":[],"output_cid":"' || out || '","agent":"' || role || '","timestamp":"{TS}","meta":[]}}' AS json FROM c WHERE turn = 0
  UNION ALL
  SELECT c.conv_id, c.turn, '{{"kind":"' || c.kind || '","parents":["' || sha256(chain.json) || '"],"output_cid":"' || c.out || '","agent":"' || c.role || '","timestamp":"{TS}","meta":[]}}'
  FROM chain JOIN c ON c.conv_id = chain.conv_id AND c.turn = chain.turn + 1
), n AS (SELECT conv_id, turn, json, sha256(json) AS cid FROM chain)
"""


def all_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_nodes(spark, sf_dir).select(F.col("json").cast("binary").alias("data"))
    return B.blobs_of(contents(spark, sf_dir).union(nodes), F.col("data"))


BLOBS_SQL = NODES_SQL + ", b AS (SELECT text AS data FROM documents UNION SELECT text FROM conversations UNION SELECT html FROM pages UNION SELECT json FROM n), blobs AS (SELECT sha256(data) AS cid, data, strlen(data) AS size FROM b WHERE data IS NOT NULL)\n"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_of(all_blobs(spark, sf_dir))


def order_node_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of orders: they derive from the customer and are grounded in their parts."""
    from ..functions.nodes import canonical_kinds, to_json
    from ..schema import DECAY

    parts = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("part:"), "l_partkey"))).alias("parts"))
    o = t(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # One step after the other, so that no array is built again for each of its uses.
    o = o.select("o_orderkey", "o_orderpriority", F.concat(F.array(F.concat(F.lit("customer:"), "o_custkey")), F.coalesce("parts", F.array().cast("array<string>"))).alias("parents"))
    o = o.withColumn("kinds", F.transform("parents", lambda _, i: F.when(i == 0, "derives").otherwise("grounds")))
    none = F.lit(None).cast("string")
    node = F.struct(
        F.lit("task").alias("kind"), F.col("parents"), canonical_kinds(F.col("parents"), F.col("kinds")).alias("parent_kinds"), F.sha2(F.concat(F.lit("order:"), "o_orderkey"), 256).alias("output_cid"),
        F.col("o_orderpriority").alias("agent"), F.lit(TS).alias("timestamp"), F.array().cast("array<array<string>>").alias("meta"), none.alias("schema_cid"), F.lit(None).cast("double").alias("activation"), F.lit(None).cast(DECAY).alias("decay_config"),
    )
    return o.select(to_json(node).cast("binary").alias("data")).select(F.sha2("data", 256).alias("cid"), "data")


ORDER_EDGES_SQL = """WITH p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT 'part:' || l_partkey)) AS ps FROM lineitem GROUP BY 1),
e AS (SELECT sha256('order:' || o_orderkey) AS output_cid, list_concat(['customer:' || o_custkey], coalesce(ps, [])) AS ps FROM orders LEFT JOIN p ON k = o_orderkey),
i AS (SELECT output_cid, ps, unnest(range(len(ps))) AS ordinal FROM e)
"""


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cid, kind, agent, created_at`` of regions, nations, customers, parts and orders."""
    spec = [("region", "r_regionkey", "r_name", "r"), ("nation", "n_nationkey", "n_name", "n"), ("customer", "c_custkey", "c_mktsegment", "c"), ("part", "p_partkey", "p_brand", "p"), ("orders", "o_orderkey", "o_orderpriority", "o")]
    parts = [t(spark, sf_dir, name).select(F.concat(F.lit(f"{p}:"), F.col(key).cast("string")).alias("cid"), F.lit(name).alias("kind"), F.col(agent).alias("agent"), F.lit(TS).alias("created_at")) for name, key, agent, p in spec]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def star_edges(spark: SparkSession, sf_dir: str, *, once: bool = True) -> DataFrame:
    """Edges of the star; an order that has a part in several lines has its edge once, or with each line."""
    def pair(df: DataFrame, parent: str, p: str, child: str, c: str, ordinal: int, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{p}:"), F.col(parent).cast("string")).alias("parent_cid"), F.concat(F.lit(f"{c}:"), F.col(child).cast("string")).alias("child_cid"), F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("edge_kind"))

    lines = t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    return (
        pair(t(spark, sf_dir, "nation"), "n_regionkey", "r", "n_nationkey", "n", 0, "derives")
        .union(pair(t(spark, sf_dir, "customer"), "c_nationkey", "n", "c_custkey", "c", 0, "derives"))
        .union(pair(t(spark, sf_dir, "orders"), "o_custkey", "c", "o_orderkey", "o", 0, "derives"))
        .union(pair(lines.distinct() if once else lines, "l_partkey", "p", "l_orderkey", "o", 1, "grounds"))
    )


STAR_SQL = f"""WITH RECURSIVE nodes AS (
  SELECT 'r:' || r_regionkey AS cid, 'region' AS kind, r_name AS agent, '{TS}' AS created_at FROM region UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, '{TS}' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'customer', c_mktsegment, '{TS}' FROM customer UNION ALL SELECT 'p:' || p_partkey, 'part', p_brand, '{TS}' FROM part UNION ALL SELECT 'o:' || o_orderkey, 'orders', o_orderpriority, '{TS}' FROM orders
), edges AS (
  SELECT 'r:' || n_regionkey AS parent_cid, 'n:' || n_nationkey AS child_cid, 0 AS ordinal, 'derives' AS edge_kind FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 0, 'derives' FROM customer
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 0, 'derives' FROM orders UNION ALL SELECT DISTINCT 'p:' || l_partkey, 'o:' || l_orderkey, 1, 'grounds' FROM lineitem
)
"""


EDGES_SQL = "WITH edges AS MATERIALIZED" + STAR_SQL.split(", edges AS", 1)[1]


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores: quality is correctness, the absence of toxicity is style."""
    both = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    each = F.explode(F.array(F.struct(F.lit("correctness").alias("dimension"), F.col("quality").cast("float").alias("value")), F.struct(F.lit("style").alias("dimension"), (1 - F.col("toxic")).cast("float").alias("value"))))
    return both.select(F.concat(F.lit("doc:"), "doc_id").alias("node_cid"), F.col("source").alias("agent"), each.alias("x")).select("node_cid", "agent", "x.dimension", "x.value")


SCORES_SQL = "WITH s AS (SELECT 'doc:' || doc_id AS node_cid, source AS agent, 'correctness' AS dimension, quality::DOUBLE AS value FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'doc:' || doc_id, source, 'style', 1 - toxic FROM labels JOIN documents USING (doc_id))\n"


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scores of all dimensions: the agent from the user, the value from the event's, at its time."""
    dimension = F.element_at(F.array(*[F.lit(d) for d in DIMENSIONS]), (F.col("event_id") % len(DIMENSIONS) + 1).cast("int"))
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double")
    return t(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("agent"), dimension.alias("dimension"), F.least(F.col("value") / 500, F.lit(1.0)).cast("float").alias("value"), at.alias("at"), "event_id")


EVENT_SCORES_SQL = f"WITH s AS (SELECT 'u' || user_id % 50 AS agent, {list(DIMENSIONS)}[event_id % {len(DIMENSIONS)} + 1] AS dimension, least(value / 500, 1.0)::FLOAT::DOUBLE AS value, epoch_us(ts) / 1000000.0 AS sec FROM events)\n"


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows like ``dag_nodes`` with a saturation that follows from the length of the text."""
    r = F.col("n_chars") % 5
    sat = F.when(r == 1, 0.0).when(r == 2, 1.0).when(r == 3, 0.75).when(r == 4, 0.1)
    return t(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("cid"), F.col("lang").alias("kind"), F.col("source").alias("agent"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("created_at"), F.sha2("text", 256).alias("output_cid"), F.col("lang").alias("schema_cid"), sat.cast("float").alias("saturation"))


DOC_NODES_SQL = "WITH d AS (SELECT 'doc:' || doc_id AS cid, doc_id, lang AS kind, source AS agent, lpad(doc_id::VARCHAR, 12, '0') AS created_at, sha256(text) AS output_cid, (CASE n_chars % 5 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.75 WHEN 4 THEN 0.1 END)::FLOAT AS saturation FROM documents)\n"


def event_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tree: potential from the value, depth from the user, half-life from the type."""
    e = t(spark, sf_dir, "events")
    life = F.when(F.col("event_type") == "click", 3600.0).when(F.col("event_type") == "view", 86400.0).when(F.col("event_type") != "error", 604800.0)
    return e.select(F.col("event_id").cast("string").alias("cid"), (F.floor(F.least(F.col("value") / 5, F.lit(100.0))) / 100).alias("info_potential"), (F.col("user_id") % 5).cast("int").alias("depth"), life.alias("half_life_secs"))


EVENT_TREE_SQL = "WITH tree AS (SELECT event_id::VARCHAR AS cid, floor(least(value / 5, 100.0)) / 100 AS p, (user_id % 5)::INT AS d, CASE WHEN event_type = 'click' THEN 3600.0 WHEN event_type = 'view' THEN 86400.0 WHEN event_type <> 'error' THEN 604800.0 END AS h FROM events)\n"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every document is put at the path of its source; some lines are malformed."""
    d = t(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 17 == 5, F.concat(F.lit("broken "), "doc_id")).otherwise(F.concat(F.lit(f"{TS} | put | "), "source", F.lit(" -> "), F.sha2("text", 256)))
    return d.select(F.col("doc_id").alias("seq"), line.alias("line"))


def damaged_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of documents under their address, every seventh changed after it was put."""
    rows = t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select(F.sha2("text", 256).alias("cid"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("data"))


def claim_node_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cid, data, doc_id``: a node for each document, with saturations of every sort in its metadata."""
    k = F.col("doc_id")
    said = F.when(k % 6 == 0, "0").when(k % 6 == 1, "1").when(k % 6 == 2, "0.25").when(k % 6 == 3, "2.5").when(k % 6 == 4, "none")
    meta = F.when(said.isNull(), F.lit('[["other","1"]]')).otherwise(F.concat(F.lit('[["other","1"],["saturation","'), said, F.lit('"],["saturation","0.9"]]')))
    json = F.concat(
        F.lit('{"kind":"memory","parents":["p","q"],'), F.when(k % 2 == 0, '"parent_kinds":["derives","grounds"],').otherwise(""), F.lit('"output_cid":"o'), k.cast("string"), F.lit(f'","agent":"a","timestamp":"{TS}","meta":'), meta,
        F.when(k % 2 == 0, F.concat(F.lit(',"schema_cid":"s'), (k % 5).cast("string"), F.lit('"'))).otherwise(""), F.when(k % 4 == 0, ',"activation":0.8,"decay_config":{"half_life_secs":3600.0,"activation_floor":0.1}').otherwise(""), F.lit("}"),
    )
    return t(spark, sf_dir, "documents").select(json.cast("binary").alias("data"), "doc_id").select(F.sha2("data", 256).alias("cid"), "data", "doc_id")


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return t(spark, sf_dir, "documents").select(F.concat(F.lit("c"), k).alias("cid"), F.concat(F.lit("r"), (F.col("doc_id") % 7).cast("string")).alias("root_cid"), F.lpad(k, 12, "0").alias("ts"), F.col("n_chars").cast("double").alias("total_gain"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_path, source, file_cid``: a Python and a Rust source for every document; a third of the Python ones don't parse."""
    k, last = F.col("doc_id").cast("string"), (F.col("doc_id") % 10).cast("string")
    broken = F.when(F.col("doc_id") % 3 == 0, "def broken(:\n    pass\n\n").otherwise("")
    python = F.concat(F.lit("import os\n\nclass C"), k, F.lit(":\n    def m"), last, F.lit("(self):\n        pass\n\n"), broken, F.lit("def f"), last, F.lit("():\n    return 1\n"))
    rust = F.concat(F.lit("// fn not_this() {}\npub struct S"), k, F.lit(" { x: u8 }\nimpl S"), k, F.lit(" {\n    fn get(&self) -> char { '{' }\n}\nconst N"), last, F.lit(": usize = { 1 };\n"))
    each = F.explode(F.array(F.struct(F.lit(".py").alias("tail"), python.alias("source")), F.struct(F.lit(".rs").alias("tail"), rust.alias("source"))))
    rows = t(spark, sf_dir, "documents").select(k.alias("k"), each.alias("x"))
    return rows.select(F.concat(F.lit("d"), "k", "x.tail").alias("file_path"), "x.source").withColumn("file_cid", F.sha2("source", 256))
