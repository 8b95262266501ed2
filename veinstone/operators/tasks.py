"""Agents and tasks as event tables: the present state is a fold of what was appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AGENTS, TASK_STATUSES
from .graph import keep_last

# The agents that can be registered by name.
PRESETS = [
    ("claude", "claude -p --output-format json", True, ["code", "reasoning", "review"], "claude-sonnet-4-5-20250929"),
    ("codex", "codex exec", False, ["code", "execution"], None),
    ("copilot", "gh copilot suggest", True, ["code", "suggestion"], None),
]


def presets(spark: SparkSession, updated_at: str) -> DataFrame:
    return spark.createDataFrame([(n, c, m, ",".join(caps), model or "", updated_at) for n, c, m, caps, model in PRESETS], AGENTS)


def register_agents(agents: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace by name; capabilities given as an array are joined by commas."""
    if rows.schema["capabilities"].dataType.typeName() == "array":
        rows = rows.withColumn("capabilities", F.array_join("capabilities", ","))
    return keep_last(agents.unionByName(rows), ["name"], ["updated_at"])


def task_id(title, created_by, created_at):
    """Ids are digests of what was asked, by whom and when."""
    return F.sha2(F.concat_ws("\x1f", title, created_by, created_at), 256)


def fold_tasks(created: DataFrame, events: DataFrame) -> DataFrame:
    """Tasks with their present status and assignee.

    events(id, seq, status, assigned_to, result_cid): later events win field by field; an
    assignment alone sets the status to assigned.  Unknown statuses fail.
    """
    status = F.coalesce("status", F.when(F.col("assigned_to").isNotNull(), "assigned"))
    known = F.assert_true(status.isNull() | status.isin(TASK_STATUSES), F.lit("unknown task status"))
    e = events.withColumn("status", F.when(known.isNull(), status))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    now = e.groupBy("id").agg(last("status").alias("s"), last("assigned_to").alias("a"), last("result_cid").alias("r"), F.max("seq").alias("u"))
    return created.join(now, "id", "left").withColumns({"status": F.coalesce("s", "status"), "assigned_to": F.coalesce("a", "assigned_to"), "result_cid": F.coalesce("r", "result_cid"), "updated_at": F.coalesce(F.col("u").cast("string"), "updated_at")}).drop("s", "a", "r", "u")


def list_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", "title", "status", "assigned_to", "created_by", "created_at").orderBy("created_at", "id")


def list_agents(agents: DataFrame) -> DataFrame:
    return agents.orderBy("name")
