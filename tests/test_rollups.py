"""Rollups equal profiles of all scores, however these are split into appends."""

import math
import random

import pytest

from veinstone.operators import rollups, scores

SCHEMA = "agent string, dimension string, value float, at double"


def rows():
    rng = random.Random(51)
    out = [(rng.choice(["a", "b", "c", None]), rng.choice(["style", "correctness", "efficiency"]), rng.choice([0.0, 1.0, 0.3, rng.random()]), rng.choice([None, rng.random() * 1e7])) for _ in range(400)]
    return [*out, ("tie1", "completeness", 0.5, 1.0), ("tie2", "completeness", 0.5, 2.0), ("a", "style", None, 5.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_appends(spark, tmp_path, seed):
    rng, all_ = random.Random(seed), rows()
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    parts = [[] for _ in range(4)]
    for r in all_:
        rng.choice(parts[:3]).append(r)
    for part in parts:  # the last one is empty
        rollups.append(str(tmp_path / "r"), frame(part))
    state = rollups.read(spark, str(tmp_path / "r"))
    whole = frame([r for r in all_ if r[2] is not None])
    key = lambda r: str(r[:2])
    assert sorted((tuple(r)[:4] for r in rollups.profile(state).collect()), key=key) == sorted(map(tuple, scores.profile(whole).collect()), key=key)
    assert sorted(map(tuple, rollups.best_agents(state).collect())) == sorted(map(tuple, scores.best_agents(whole).collect()))
    assert {r["agent"]: r["total"] for r in rollups.agent_profile(state).collect()}["a"] == sum(r[0] == "a" and r[2] is not None for r in all_)


def test_recent_means_fade_alike(spark, tmp_path):
    timed = [(a, d, v, t) for a, d, v, t in rows() if t is not None and v is not None]
    for i in range(3):
        rollups.append(str(tmp_path / "r"), spark.createDataFrame(timed[i::3], SCHEMA), 1e6)
    state = rollups.read(spark, str(tmp_path / "r"), 1e6)
    for r in rollups.profile(state).collect():
        own = [(v, 2 ** ((t - 1e7) / 1e6)) for a, d, v, t in timed if (a, d) == (r["agent"], r["dimension"])]
        assert math.isclose(r["recent"], sum(v * w for v, w in own) / sum(w for _, w in own), abs_tol=2e-6)
    for r in rollups.agent_profile(state, 1e6).collect():
        own = [(v, 2 ** ((t - 1e7) / 1e6)) for a, d, v, t in timed if a == r["agent"]]
        assert math.isclose(r["recent"], sum(v * w for v, w in own) / sum(w for _, w in own), abs_tol=2e-6)
