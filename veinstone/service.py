"""Tools over a workspace, and JSON-RPC by lines."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable
from typing import IO

from pyspark.sql import functions as F

from .functions import nodes as N
from .operators import allocate, graph, projection, symbols
from .workspace import NotFound, Workspace

PROTOCOL = "2024-11-05"
Text, Number, Whole, Texts = "string", "number", "integer", "array"

_NODE = {"parents": Texts, "edge_kind": Text, "schema_cid": Text, "saturation": Number, "activation": Number, "half_life_secs": Number, "activation_floor": Number}
#: name -> (description, required parameters, optional parameters)
TOOLS: dict[str, tuple[str, dict, dict]] = {
    "put": ("Store a text; returns its address.", {"content": Text}, {}),
    "get": ("Content behind an address.", {"cid": Text}, {}),
    "verify": ("Whether a content has its address.", {"cid": Text}, {}),
    "dag_link": ("Store a content with a node.", {"content": Text, "kind": Text, "agent": Text}, _NODE),
    "dag_lineage": ("Ancestors of a node.", {"cid": Text}, {}),
    "check_drift": ("Whether a file differs from an address.", {"path": Text, "expected_cid": Text}, {}),
    "query_cdom": ("Symbols of a file by name.", {"query": Text, "path": Text}, {}),
    "store_reasoning": ("Store a reasoning node.", {"content": Text, "agent": Text}, _NODE),
    "create_subtask": ("Add a task.", {"title": Text, "created_by": Text}, {"parent_task": Text}),
    "get_reasoning": ("Text behind a node or blob.", {"cid": Text}, {}),
    "calibrate": ("Allocate tiers below a root.", {"root_cid": Text}, {"max_cost": Number, "max_depth": Whole, "max_tier3": Whole}),
    "score": ("Record a score.", {"node_cid": Text, "agent": Text, "scorer": Text, "dimension": Text, "value": Number}, {"evidence": Text}),
    "schema_stats": ("How often outputs of a schema repeat.", {"schema_cid": Text}, {}),
    "dag_ls": ("Nodes by address.", {}, {"kind": Text, "limit": Whole}),
    "status": ("Counts of everything.", {}, {}),
    "search": ("Blobs that contain a text.", {"query": Text}, {"limit": Whole}),
    "decay_status": ("Activation of a node after some time.", {"cid": Text}, {"elapsed_secs": Number}),
    "soft_link": ("Relate two addresses.", {"from_cid": Text, "to_cid": Text, "relation": Text}, {}),
    "soft_link_query": ("Relations of an address.", {"cid": Text}, {"relation": Text, "direction": Text}),
}


class InvalidParams(ValueError):
    pass


def _number(params: dict, key: str) -> float | None:
    v = params.get(key)
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
        raise InvalidParams(f"{key} must be a finite number")
    return float(v)


def saturation_param(params: dict) -> float | None:
    v = _number(params, "saturation")
    if v is not None and not 0 <= v <= 1:
        raise InvalidParams("saturation must be in [0, 1]")
    return v


def decay_params(params: dict) -> tuple[float, float, float] | None:
    """(activation, half-life, floor) if a half-life is given."""
    life = _number(params, "half_life_secs")
    if life is None:
        return None
    activation, floor = _number(params, "activation"), _number(params, "activation_floor")
    activation, floor = 1.0 if activation is None else activation, floor or 0.0
    for wrong, what in ((life <= 0, "half_life_secs must be above 0"), (activation < 0, "activation must not be negative"), (floor < 0, "activation_floor must not be negative"), (floor > activation, "activation_floor must not be above activation")):
        if wrong:
            raise InvalidParams(what)
    return activation, life, floor


def descriptors() -> list[dict]:
    out = []
    for name, (what, need, may) in TOOLS.items():
        fields = {k: {"type": t} | ({"items": {"type": "string"}} if t == Texts else {}) for k, t in {**need, **may}.items()}
        out.append({"name": name, "description": what, "inputSchema": {"type": "object", "properties": fields, "required": list(need)}})
    return out


class Service:
    def __init__(self, work: Workspace):
        self.work = work

    def call(self, name: str, params: dict) -> dict:
        if name not in TOOLS:
            raise InvalidParams(f"unknown tool {name}")
        for key in TOOLS[name][1]:
            if params.get(key) is None:
                raise InvalidParams(f"{key} is required")
        handler: Callable[[dict], dict] = getattr(self, f"_{name}")
        return handler(params)

    def _put(self, p):
        return {"cid": self.work.store.put(p["content"])}

    def _get(self, p):
        return {"content": self.work.store.get(p["cid"]).decode("utf-8", "replace")}

    def _verify(self, p):
        return {"valid": self.work.store.verify(p["cid"])}

    def _node(self, p, kind):
        parents = [x for x in p.get("parents") or [] if isinstance(x, str)]
        more: dict = {"saturation": saturation_param(p), "schema_cid": p.get("schema_cid")}
        if p.get("edge_kind"):
            more["parent_kinds"] = [p["edge_kind"]] * len(parents)
        if d := decay_params(p):
            more |= {"activation": d[0], "half_life_secs": d[1], "floor": d[2]}
        return self.work.create(p["content"], kind, parents, p["agent"], **more)

    def _dag_link(self, p):
        node, content = self._node(p, p["kind"])
        return {"node_cid": node, "content_cid": content}

    def _store_reasoning(self, p):
        return {"node_cid": self._node(p, "reasoning")[0]}

    def _dag_lineage(self, p):
        rows = self.work.dag.lineage(p["cid"]).select("cid", "kind", "agent", "timestamp", "output_cid", "parents").collect()
        return {"lineage": [r.asDict() for r in rows]}

    def _check_drift(self, p):
        return {"drifted": self.work.dag.check_drift(p["path"], p["expected_cid"])}

    def _query_cdom(self, p):
        with open(p["path"], encoding="utf-8") as f:
            found = symbols.symbols(f.read(), symbols.detect_language(p["path"]))
        return {"symbols": [dict(zip(("name", "kind", "start_line", "end_line"), s, strict=False)) for s in found if p["query"].lower() in s[0].lower()]}

    def _create_subtask(self, p):
        return {"task_id": self.work.create_task(p["title"], p["created_by"], p.get("parent_task") or "")}

    def _get_reasoning(self, p):
        of = self.work.spark.createDataFrame([(p["cid"],)], "cid string")
        row = graph.reasoning(self.work.dag.nodes(), self.work.store.df(), of).first()
        if row is None or row["content"] is None:
            raise NotFound(p["cid"])
        return {"content": row["content"]} if row["kind"] is None else {k: row[k] for k in ("agent", "kind", "timestamp", "content", "schema_cid")}

    def _calibrate(self, p):
        limits = allocate.Constraints(*(d if (v := _number(p, k)) is None else type(d)(v) for k, d in (("max_cost", 50.0), ("max_depth", 20), ("max_tier3", 5))))
        node, result = self.work.calibrate(p["root_cid"], limits)
        return {"node_cid": node, "result": result}

    def _score(self, p):
        value = _number(p, "value")
        if value is None or not 0 <= value <= 1:
            raise InvalidParams("value must be in [0, 1]")
        self.work.score(p["node_cid"], p["agent"], p["scorer"], p["dimension"], value, p.get("evidence") or "")
        return {"recorded": True}

    def _schema_stats(self, p):
        row = graph.schema_stats(self.work.dag.nodes().where(F.col("schema_cid") == p["schema_cid"])).first()
        return {"total_nodes": 0, "unique_outputs": 0, "dedup_ratio": "N/A"} if row is None else {k: row[k] for k in ("total_nodes", "unique_outputs", "dedup_ratio")}

    def _dag_ls(self, p):
        return {"nodes": [r.asDict() for r in graph.list_nodes(self.work.dag.nodes(), p.get("kind"), int(p.get("limit") or 50)).collect()]}

    def _status(self, _):
        return self.work.status()

    def _search(self, p):
        return {"results": [r.asDict() for r in graph.search(self.work.store.df(), p["query"], int(p.get("limit") or graph.SEARCH_LIMIT)).collect()]}

    def _decay_status(self, p):
        elapsed = _number(p, "elapsed_secs") or 0.0
        nodes = graph.nodes_of(self.work.store.df().where(F.col("cid") == p["cid"]))
        row = nodes.select("activation", "decay_config", N.decayed_activation(F.col("activation"), F.col("decay_config"), F.lit(elapsed)).alias("decayed")).first()
        if row is None:
            raise NotFound(p["cid"])
        config = row["decay_config"]
        return {"cid": p["cid"], "stored_activation": row["activation"], "decayed_activation": row["decayed"], "elapsed_secs": elapsed, "has_decay": config is not None, "decay_config": config and config.asDict()}

    def _soft_link(self, p):
        self.work.link(p["from_cid"], p["to_cid"], p["relation"])
        return {"created": True, **{k: p[k] for k in ("from_cid", "to_cid", "relation")}}

    def _soft_link_query(self, p):
        direction = p.get("direction") or "both"
        rows = projection.soft_links(self.work.table("soft_links"), p["cid"], direction, p.get("relation")).collect()
        hide = {"from": ["from_cid"], "to": ["to_cid"]}.get(direction, [])
        return {"links": [{k: v for k, v in r.asDict().items() if k not in hide} for r in rows], "cid": p["cid"], "direction": direction}

    def handle(self, request: dict) -> dict:
        """One JSON-RPC request to its response."""
        answer: dict = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "veinstone", "version": "0.1.0"}}}
        if method == "notifications/initialized":
            return answer | {"result": {}}
        if method == "tools/list":
            return answer | {"result": {"tools": descriptors()}}
        if method == "tools/call":
            try:
                result = self.call(params.get("name", ""), params.get("arguments") or {})
            except Exception as e:  # every failure of a tool is an answer
                return answer | {"error": {"code": -32603, "message": f"{type(e).__name__}: {e}"}}
            return answer | {"result": {"content": [{"type": "text", "text": json.dumps(result)}]}}
        return answer | {"error": {"code": -32601, "message": f"method not found: {method}"}}

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                answer = self.handle(json.loads(line))
            except ValueError as e:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e}"}}
            out.write(json.dumps(answer) + os.linesep)
            out.flush()
