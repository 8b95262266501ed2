"""Types of the data model: nodes, edges and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed sets of the data model.
NODE_KINDS = ["memory", "code", "reasoning", "task", "cdom", "score", "context"]
EDGE_KINDS = ["derives", "grounds", "proposes"]
DIMENSIONS = ["correctness", "efficiency", "style", "completeness", "decay_adjusted_activation"]
TASK_STATUSES = ["pending", "assigned", "running", "done", "failed"]
SYMBOL_KINDS = ["function", "method", "class", "struct", "enum", "trait", "impl", "module", "import", "constant", "variable"]
#: tier -> (cost, share of the information gained)
TIERS = {"skip": (0.0, 0.0), "shallow": (1.0, 0.3), "moderate": (2.0, 0.7), "deep": (4.0, 1.0)}

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


DECAY = _table(("half_life_secs", D), ("activation_floor", D))
#: The order of the fields is the order in canonical JSON; null fields are left out there.
NODE = _table(
    ("kind", S), ("parents", T.ArrayType(S)), ("parent_kinds", T.ArrayType(S)), ("output_cid", S), ("agent", S), ("timestamp", S),
    ("meta", T.ArrayType(T.ArrayType(S))), ("schema_cid", S), ("activation", D), ("decay_config", DECAY),
)
REQUIRED = ["kind", "parents", "output_cid", "agent", "timestamp", "meta"]

BLOBS = _table(("cid", S), ("data", T.BinaryType()), ("size", L))
DAG_NODES = _table(("cid", S), ("kind", S), ("agent", S), ("created_at", S), ("output_cid", S), ("meta", S), ("schema_cid", S), ("saturation", T.FloatType()))
DAG_EDGES = _table(("parent_cid", S), ("child_cid", S), ("ordinal", T.IntegerType()), ("edge_kind", S))
SOFT_LINKS = _table(("from_cid", S), ("to_cid", S), ("relation", S), ("created_at", S))
TASKS = _table(("id", S), ("title", S), ("status", S), ("assigned_to", S), ("created_by", S), ("created_at", S), ("updated_at", S), ("parent_task", S), ("context_cid", S), ("result_cid", S), ("meta", S))
AGENTS = _table(("name", S), ("cli_command", S), ("mcp_capable", B), ("capabilities", S), ("model", S), ("updated_at", S))
CONTEXT_FILES = _table(("path", S), ("cid", S), ("tracked_at", S), ("agent", S))
CDOM_SYMBOLS = _table(("id", L), ("file_path", S), ("file_cid", S), ("name", S), ("kind", S), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("parent_symbol", S), ("scanned_at", S))
SCORES = _table(("id", S), ("node_cid", S), ("agent", S), ("scorer", S), ("dimension", S), ("value", T.FloatType()), ("evidence", S), ("created_at", S))
CALIBRATIONS = _table(("cid", S), ("root_cid", S), ("lambda_cost", D), ("lambda_depth", D), ("lambda_tier3", D), ("total_gain", D), ("total_cost", D), ("iterations", L), ("agent", S), ("ts", S))

#: Tables of the projection with their primary keys.
PROJECTION = {
    "dag_nodes": (DAG_NODES, ["cid"]), "dag_edges": (DAG_EDGES, ["parent_cid", "child_cid"]), "soft_links": (SOFT_LINKS, ["from_cid", "to_cid", "relation"]), "tasks": (TASKS, ["id"]), "agents": (AGENTS, ["name"]),
    "context_files": (CONTEXT_FILES, ["path"]), "cdom_symbols": (CDOM_SYMBOLS, ["id"]), "scores": (SCORES, ["id"]), "calibrations": (CALIBRATIONS, ["cid"]),
}
SYMBOL = "array<struct<name:string,kind:string,start_line:int,end_line:int,parent:string>>"
