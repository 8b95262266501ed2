"""Score rollups that are kept up: partial states by agent and dimension, which merge.

A state is a sum, a count, and the sum of values and of weights that have faded to a time, by half every
``half_life``.  Sums are whole numbers of 2 ** -40, so they are the same for every split into appends.  Each
append writes the states of its scores, a row for each agent and dimension it has, and reading merges them;
no score is read again.  A faded pair is brought to the later of two times by one factor, and their quotient,
the mean in which recent scores count more, doesn't depend on the time it is read at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DIMENSIONS

HALF_LIFE = 30 * 86400.0
UNIT = float(1 << 40)
KEY = ["agent", "dimension"]
STATE = "agent string, dimension string, total decimal(38,0), n long, faded double, weight double, at double"


def _fading(at: Column, until: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), (at - until) / half_life)


def states(scores: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """The states of scores(agent, dimension, value, at); ``at`` is a time in seconds, a score without one counts as from the first."""
    value = F.col("value").cast("double")
    span = scores.agg(F.min("at").cast("double").alias("low"), F.max("at").cast("double").alias("high")).first()
    low, high = (F.lit(x if x is not None else 0.0) for x in span)
    weight = _fading(F.coalesce(F.col("at").cast("double"), low), high, half_life)
    rows = scores.where(value.isNotNull()).select(*KEY, F.round(value * UNIT).cast("decimal(20,0)").alias("units"), (value * weight).alias("faded"), weight.alias("weight"))
    sums = rows.groupBy(*KEY).agg(F.sum("units").cast("decimal(38,0)").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("faded").alias("faded"), F.sum("weight").alias("weight"))
    return sums.withColumn("at", high)


def merged(parts: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """One state for each agent and dimension from any number of them; there are few parts, one an append at most."""
    latest = parts.groupBy(*[F.col(c).alias(f"{c}_") for c in KEY]).agg(F.max("at").alias("until"))
    same = F.col("agent").eqNullSafe(F.col("agent_")) & F.col("dimension").eqNullSafe(F.col("dimension_"))
    factor = _fading(F.col("at"), F.col("until"), half_life)
    both = parts.join(latest, same).select(*KEY, "total", "n", (F.col("faded") * factor).alias("faded"), (F.col("weight") * factor).alias("weight"), "until")
    return both.groupBy(*KEY).agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"), F.sum("faded").alias("faded"), F.sum("weight").alias("weight"), F.max("until").alias("at"))


def append(path: str, scores: DataFrame, half_life: float = HALF_LIFE) -> None:
    """The states of new scores, added to the table at ``path``."""
    states(scores, half_life).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, half_life: float = HALF_LIFE) -> DataFrame:
    return merged(spark.read.schema(STATE).parquet(path), half_life)


def _mean() -> Column:
    return F.round(F.col("total").cast("double") / UNIT / F.col("n"), 3)


def profile(state: DataFrame) -> DataFrame:
    """What ``scores.profile`` says of all scores, and ``recent``, the mean of faded ones."""
    return state.select(*KEY, _mean().alias("avg_score"), "n", F.round(F.col("faded") / F.col("weight"), 6).alias("recent"))


def best_agents(state: DataFrame) -> DataFrame:
    """What ``scores.best_agents`` says of all scores."""
    best = F.min_by(F.struct("agent", "avg_score"), F.struct(-F.col("avg_score"), F.col("agent")))
    return profile(state).groupBy("dimension").agg(best.alias("b")).select("dimension", "b.agent", "b.avg_score")


def agent_profile(state: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """One wide row for each agent: a column for each dimension, the number of scores, and the recent mean of all.

    States of one agent that end at different times are brought to the latest first.
    """
    latest = state.groupBy(F.col("agent").alias("agent_")).agg(F.max("at").alias("until"))
    factor = _fading(F.col("at"), F.col("until"), half_life)
    state = state.join(latest, F.col("agent").eqNullSafe(F.col("agent_"))).withColumns({"faded": F.col("faded") * factor, "weight": F.col("weight") * factor})
    each = [F.max(F.when(F.col("dimension") == d, _mean())).alias(d) for d in DIMENSIONS]
    return state.groupBy("agent").agg(*each, F.sum("n").alias("total"), F.round(F.sum("faded") / F.sum("weight"), 6).alias("recent"))

