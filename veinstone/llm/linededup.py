"""Cross-site boilerplate lines, by how many distinct sites carry a line.

Every line hash gets a HyperLogLog sketch of the sites it was seen on.  A sketch is kept sparse, as
rows (line, register, rank) of which an aggregation takes the maximum: merging is partial
aggregation, a line on few sites has few rows, and no line has more than the number of registers.
A second aggregation turns registers into estimates.  Lines that are clearly spread or clearly not
are decided by the estimate; those from ``recount_from`` up to ``DEVIATIONS`` standard errors over
the threshold get exact distinct counts.  All steps are built-in expressions.

A line that spreads over ``min_sites`` sites or more is removed from every document but the one
with the smallest id that has it, so its content stays once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SITES = 8
#: log2 of the registers of a sketch.
PRECISION = 11
DEVIATIONS = 5.0


def line_key(line: Column) -> Column:
    """A line without the white space around it; what is blank has no key."""
    return F.trim(F.translate(line, "\t\r", "  "))


def occurrences(rows: DataFrame) -> DataFrame:
    """``key, at, h, site`` of all lines that aren't blank; rows(key, text, site)."""
    lines = rows.select("key", "site", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    k = line_key(F.col("line"))
    return lines.where(k != "").select("key", "at", F.xxhash64(k).alias("h"), "site")


def registers(occ: DataFrame, precision: int = PRECISION) -> DataFrame:
    """Sparse sketches: ``h, register, rank``."""
    s = F.xxhash64("site", F.lit("site"))
    rest = F.shiftrightunsigned(s, precision)
    rank = F.when(rest == 0, F.lit(64 - precision + 1)).otherwise(64 - precision - F.length(F.bin(rest)) + 1)
    return occ.where("site IS NOT NULL").groupBy("h", s.bitwiseAND((1 << precision) - 1).cast("int").alias("register")).agg(F.max(rank).alias("rank"))


def estimates(sketch: DataFrame, precision: int = PRECISION) -> DataFrame:
    """``h, sites``: HyperLogLog estimates with linear counting where registers are empty."""
    m = float(1 << precision)
    alpha = 0.7213 / (1 + 1.079 / m)
    by = sketch.groupBy("h").agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("power"))
    empty = m - F.col("used")
    raw = alpha * m * m / (F.col("power") + empty)
    return by.select("h", F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("sites"))


def _marked(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    return docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))


def recount_from(min_sites: int) -> float:
    """Estimate from which on lines are counted exactly.

    Sites that share a register lower an estimate: a line on ``min_sites`` is below this only if at
    least six of its sites (half of them, if that is more) fall on registers of others.  Up to five
    sites every line is counted.
    """
    return min(min_sites / 2, max(min_sites - 5.0, 0.0))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``key, drop``: the line numbers that each document loses; key is (id, hash of the text)."""
    occ = occurrences(_marked(docs, id_col, text_col, site_col))
    margin = max(1.0, DEVIATIONS * 1.04 / math.sqrt(1 << PRECISION) * min_sites)
    likely = written(
        estimates(registers(occ)).where(F.col("sites") > recount_from(min_sites))
        .select("h", (F.col("sites") > min_sites + margin).alias("sure")), "likely-lines",
    )
    # hot lines are split by Spark: both sides of this join are plain shuffles
    seen = written(occ.join(likely, "h").select("key", "at", "h", "site", "sure"), "likely-occurrences")
    exact = seen.where("NOT sure AND site IS NOT NULL").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    spread = exact.select("h").union(seen.where("sure").select("h").distinct())
    first = seen.groupBy("h").agg(F.min("key.id").alias("first")).join(spread, "h", "left_semi")
    first = written(first, "spread-lines")
    return seen.join(first, "h").where(~F.col("key.id").eqNullSafe(F.col("first"))).groupBy("key").agg(F.collect_set("at").alias("drop"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``row, n_removed``: every row of ``docs`` as a struct, without boilerplate lines in ``text_col``, and how many it lost.

    Lines are compared without white space around them; blank lines stay.  Lines of rows without
    a site count for no site and are removed like others.  Null texts stay null; a document may
    end up empty.  Very long texts are read whole, each within one task.  Rows that repeat an id are
    treated alike: each keeps the lines whose first document has that id.  Columns of ``docs``, whatever
    their names, stay as they are.
    """
    drop = boilerplate(docs, min_sites, id_col=id_col, text_col=text_col, site_col=site_col).select(F.col("key.id").alias("id"), F.col("key.h").alias("h"), "drop")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    of = lambda c: F.col("row").getField(c)
    joined = rows.join(drop, of(id_col).eqNullSafe(F.col("id")) & (F.xxhash64(of(text_col)) == F.col("h")), "left")
    lines = F.split(of(text_col), "\n", -1)
    chosen = F.map_from_arrays(F.col("drop"), F.transform("drop", lambda x: F.lit(True)))
    kept = F.array_join(F.filter(lines, lambda line, i: F.try_element_at(chosen, i).isNull()), "\n")
    text = F.when(F.col("drop").isNull(), of(text_col)).otherwise(kept)
    n_removed = F.coalesce(F.size("drop").cast("long") * F.col("drop").isNotNull().cast("long"), F.lit(0).cast("long"))
    return joined.select(F.struct(*[(text if c == text_col else of(c)).alias(c) for c in docs.columns]).alias("row"), n_removed.alias("n_removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The rows of ``cleaned`` with all their columns, and the column ``n_removed``, which replaces one of that name in any case."""
    found = cleaned(docs, min_sites, id_col=id_col, text_col=text_col, site_col=site_col)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "n_removed"], "n_removed")
