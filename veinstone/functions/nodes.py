"""Expressions over node columns: canonical JSON, metadata, saturation and decay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EDGE_KINDS, NODE, NODE_KINDS, REQUIRED


def edge_kind(kind: Column) -> Column:
    """Unknown and missing edge kinds are ``derives``."""
    return F.when(kind.isin(EDGE_KINDS), kind).otherwise(F.lit("derives"))


def canonical_kinds(parents: Column, kinds: Column) -> Column:
    """Parent kinds as they are stored: none when all are the default, so that such a node has the
    bytes of an untyped one.  Fails where the lengths differ."""
    same = F.assert_true(kinds.isNull() | (F.size(parents) == F.size(kinds)), "parents and parent kinds must have one length")
    shown = F.when(F.forall(kinds, lambda k: k == "derives"), F.lit(None)).otherwise(kinds)
    return F.when(same.isNull(), shown)


def to_json(node: Column) -> Column:
    """Canonical bytes of a node struct as text; null fields are left out."""
    return F.to_json(node)


def parse(data: Column) -> Column:
    """A node struct from a blob, null where the blob isn't a node.

    All required fields must be there with their JSON types, and the kind must be known; fields
    that the schema doesn't have are ignored.
    """
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))

    def checked(read: Column) -> Column:
        node, fine = read["node"], F.lit(True)
        for name in REQUIRED:
            fine = fine & node[name].isNotNull()
        fine = fine & node["kind"].isin(NODE_KINDS) & F.forall(node["parents"], lambda p: p.isNotNull())
        for name in ("kind", "output_cid", "agent", "timestamp"):
            fine = fine & (F.schema_of_variant(F.try_variant_get(read["v"], f"$.{name}", "variant")) == "STRING")
        return F.when(F.coalesce(fine, F.lit(False)), node)

    # Bound to a name of a lambda, so that a text is parsed once however often its node is asked for.
    read = F.struct(F.from_json(text, NODE).alias("node"), F.try_parse_json(text).alias("v"))
    return F.get(F.transform(F.array(read), checked), F.lit(0))


def meta_get(meta: Column, name: str) -> Column:
    """First value of a key; later ones of the same key are not seen."""
    return F.get(F.get(F.filter(meta, lambda m: F.get(m, F.lit(0)) == name), F.lit(0)), F.lit(1))


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")))


def saturation(meta: Column) -> Column:
    """Declared saturation in [0, 1] as a float; null where it's missing or no number."""
    x = meta_get(meta, "saturation").try_cast("float")
    return F.when(~F.isnan(x), clamp(x))


def saturation_text(x: Column) -> Column:
    """How a saturation is stored: clamped, and without a fraction where it has none."""
    return F.regexp_replace(clamp(x.cast("float")).cast("string"), r"\.0$", "")


def is_claim(sat: Column) -> Column:
    return F.coalesce(sat >= 1, F.lit(False))


def is_query(sat: Column) -> Column:
    return sat.isNull() | (sat == 0)


def decay(activation: Column, half_life: Column, floor: Column, elapsed: Column) -> Column:
    """``max(a * exp(-t ln 2 / h), floor)``; without a finite positive half-life ``max(a, floor)``."""
    a = activation.cast("double")
    faded = a * F.exp(-elapsed * F.lit(math.log(2)) / half_life)
    value = F.when(half_life.isNull() | F.isnan(half_life) | (half_life <= 0) | (half_life == float("inf")), a).otherwise(faded)
    return F.when(F.isnan(value), floor).otherwise(F.greatest(value, floor))


def decayed_activation(activation: Column, config: Column, elapsed: Column) -> Column:
    """A node's activation after ``elapsed`` seconds; 1 where none is stored, unchanged without a config."""
    base = F.coalesce(activation, F.lit(1.0))
    return F.when(config.isNull(), base).otherwise(decay(base, config["half_life_secs"], config["activation_floor"], elapsed))


def potential(sat: Column, mean_score: Column) -> Column:
    """Information still to be gained: 1 - saturation, else 1 - mean score, else 1; not below 0."""
    return F.greatest(F.coalesce(1 - sat.cast("double"), 1 - mean_score, F.lit(1.0)), F.lit(0.0))
