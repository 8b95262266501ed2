"""Scores of nodes by agent and dimension: validation, profiles, routing, automatic scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DIMENSIONS


def dimension(name: Column) -> Column:
    """The dimension in lower case; fails for unknown ones."""
    low = F.lower(name)
    known = F.assert_true(low.isin(DIMENSIONS), F.concat(F.lit("unknown dimension "), name))
    return F.when(known.isNull(), low)


def valid_value(value: Column) -> Column:
    """A value in [0, 1]; fails for others and for NaN."""
    return F.when(F.assert_true((value >= 0) & (value <= 1), "score values are from 0 to 1").isNull(), value)


def record(rows: DataFrame) -> DataFrame:
    """Rows of ``scores`` from (node_cid, agent, scorer, dimension, value, evidence, created_at);
    the id is a digest of the rest."""
    checked = rows.withColumns({"dimension": dimension(F.col("dimension")), "value": valid_value(F.col("value")).cast("float")})
    return checked.select(F.sha2(F.concat_ws("\x1f", "node_cid", "agent", "scorer", "dimension", F.col("value").cast("string"), "evidence", "created_at"), 256).alias("id"), "node_cid", "agent", "scorer", "dimension", "value", "evidence", "created_at")


def for_node(scores: DataFrame, address: str) -> DataFrame:
    return scores.where(F.col("node_cid") == address)


def profile(scores: DataFrame) -> DataFrame:
    """``agent, dimension, avg_score, n``, averages rounded to three places."""
    return scores.groupBy("agent", "dimension").agg(F.round(F.avg(F.col("value").cast("double")), 3).alias("avg_score"), F.count(F.lit(1)).alias("n"))


def best_agents(scores: DataFrame) -> DataFrame:
    """``dimension, agent, avg_score``: the best rounded average, of equal ones the first agent."""
    best = F.min_by(F.struct("agent", "avg_score"), F.struct(-F.col("avg_score"), F.col("agent")))
    return profile(scores).groupBy("dimension").agg(best.alias("b")).select("dimension", "b.agent", "b.avg_score")


def agent_profile(scores: DataFrame) -> DataFrame:
    """One wide row for each agent: a column for each dimension, and the number of scores."""
    wide = scores.groupBy("agent").pivot("dimension", DIMENSIONS).agg(F.round(F.avg(F.col("value").cast("double")), 3))
    return wide.join(scores.groupBy("agent").agg(F.count(F.lit(1)).alias("total")), "agent")


def icon(value: Column) -> Column:
    return F.when(value >= 0.8, "PASS").when(value >= 0.3, "WARN").otherwise("FAIL")


def mean_scores(scores: DataFrame) -> DataFrame:
    """``node_cid, mean_score`` over all dimensions."""
    return scores.groupBy("node_cid").agg(F.avg(F.col("value").cast("double")).alias("mean_score"))


def auto_scores(results: DataFrame) -> DataFrame:
    """Scores from results(node_cid, agent, step, exit_code, stderr, created_at) of a project's
    build, test and lint runs; nothing is executed here.  Other steps give no score."""
    step = F.col("step")
    dim = F.when(step == "build", "correctness").when(step == "test", "completeness").when(step == "lint", "style")
    ok = F.col("exit_code") == 0
    value = F.when(ok, 1.0).when(step == "lint", 0.3).otherwise(0.0)
    said = F.array_join(F.slice(F.split("stderr", "\n"), 1, 5), "; ")
    return record(results.where(dim.isNotNull()).select("node_cid", "agent", F.concat(F.lit("auto:"), step).alias("scorer"), dim.alias("dimension"), value.alias("value"), F.when(ok, F.concat(step, F.lit(" passed"))).otherwise(said).alias("evidence"), "created_at"))
