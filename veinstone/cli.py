"""Command line over a workspace: ``python -m veinstone.cli --home DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import allocate, graph, projection, scores, symbols, tasks
from .service import Service
from .workspace import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinstone")
    p.add_argument("--home", default=os.environ.get("VEINSTONE_HOME", ".veinstone"))
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, /, *args: str, **options: Any) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, nargs="?" if a == "action" and options.get("plain") else None)
        for k, v in options.items():
            if k in ("plain",):
                continue
            flag = "--" + k.replace("_", "-")
            if v is bool:
                c.add_argument(flag, action="store_true")
            elif isinstance(v, list):
                c.add_argument(flag, nargs="*", default=v)
            else:
                c.add_argument(flag, default=None if isinstance(v, type) else v, type=v if isinstance(v, type) else type(v))

    for name in ("init", "status", "history", "mcp", "cas-stats", "drift", "verify-projection", "rebuild-projection"):
        add(name)
    for name, arg in (("put", "path"), ("get", "cid"), ("verify", "cid"), ("scan", "path"), ("import", "path"), ("sql", "query")):
        add(name, arg)
    add("dag", "action", cid=str, kind="memory", content="", agent="human", parents=[], edge_kind=str, path=str, max_depth=int, limit=int, schema=str, saturation=float)
    add("task", "action", id=str, title="", by="human", to=str)
    add("agent", "action", name=str, cli="", model="", capabilities=[])
    add("run", "task", agent="claude", result="-")
    add("cdom", "query", file=str)
    add("log", n=20)
    add("scores", "action", node=str, agent=str, scorer="human", dimension=str, value=float, evidence="", results=str)
    add("calibrate", "action", root=str, cid=str, max_cost=50.0, max_depth=20, max_tier3=5)
    add("repair", dry_run=bool)
    add("diff", "table", old=int, new=int)
    add("link", "action", a=str, b=str, relation="related", direction="both")
    add("track", "action", path=str)
    add("gc", delete=bool)
    add("export", "cid", out="-")
    add("merge", "content", parents=[], agent="human")
    add("dot", root=str)
    add("search", "query", limit=20)
    add("snapshot", "action", name=str)
    return p


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(a: argparse.Namespace, spark: SparkSession) -> tuple[Any, int]:
    """What a command gives, and its exit code."""
    home = os.path.abspath(a.home)
    if a.command == "init":
        Workspace.init(spark, home)
        return {"home": home}, 0
    w = Workspace(spark, home)
    t = w.table
    match a.command, getattr(a, "action", None):
        case "put", _:
            if a.path == "-":
                return {"cid": w.store.put(sys.stdin.buffer.read())}, 0
            return {"cid": w.put_file(a.path)}, 0
        case "get", _:
            return w.store.get(a.cid).decode("utf-8", "replace"), 0
        case "verify", _:
            ok = w.store.verify(a.cid)
            return {"valid": ok}, int(not ok and not a.json)
        case "dag", "ls":
            return _rows(graph.list_nodes(w.dag.nodes(), None, a.limit)), 0
        case "dag", "show":
            return w.dag.get_node(a.cid).asDict(recursive=True), 0
        case "dag", "create":
            kinds = [a.edge_kind] * len(a.parents) if a.edge_kind else None
            node, content = w.create(a.content, a.kind, a.parents, a.agent, parent_kinds=kinds, schema_cid=a.schema, saturation=a.saturation)
            return {"node_cid": node, "content_cid": content}, 0
        case "dag", "lineage":
            return _rows(w.dag.lineage(a.cid, a.max_depth)), 0
        case "dag", "drift":
            moved = w.dag.check_drift(a.path, a.cid)
            return {"drifted": moved}, int(moved and not a.json)
        case "sql", _:
            if a.query.split(None, 1)[0].upper() in ("INSERT", "UPDATE", "DELETE"):  # a batch, one statement a line
                return {"version": w.execute([x for x in a.query.split(";\n") if x.strip()])}, 0
            return _rows(w.versions.sql(a.query)), 0
        case "task", "create":
            return {"id": w.create_task(a.title, a.by)}, 0
        case "task", "ls":
            return _rows(tasks.list_tasks(t("tasks"))), 0
        case "task", "show":
            return _rows(t("tasks").where(F.col("id") == a.id)), 0
        case "task", "assign":
            w.update_task(a.id, assigned_to=a.to)
            return {"assigned": a.to}, 0
        case "agent", "register":
            w.register_agent(a.name, a.cli, capabilities=a.capabilities, model=a.model)
            return {"registered": a.name}, 0
        case "agent", "ls":
            return _rows(tasks.list_agents(t("agents"))), 0
        case "run", _:
            text = sys.stdin.read() if a.result == "-" else open(a.result, encoding="utf-8").read()
            return {"node_cid": w.record_task_result(a.task, a.agent, text)}, 0
        case "scan", _:
            return {"symbols": w.scan(a.path)}, 0
        case "cdom", _:
            if a.file:
                with open(a.file, encoding="utf-8") as f:
                    return [s for s in symbols.symbols(f.read(), symbols.detect_language(a.file)) if a.query.lower() in s[0].lower()], 0
            return _rows(projection.search_symbols(t("cdom_symbols"), a.query)), 0
        case "log", _:
            return _rows(w.log_tail(a.n)), 0
        case "mcp", _:
            Service(w).serve(sys.stdin, sys.stdout)
            return None, 0
        case "scores", "add":
            w.score(a.node, a.agent, a.scorer, a.dimension, a.value, a.evidence)
            return {"recorded": True}, 0
        case "scores", "show":
            return _rows(scores.for_node(t("scores"), a.node).withColumn("icon", scores.icon(F.col("value")))), 0
        case "scores", "profile":
            return _rows(scores.profile(t("scores")).where(F.col("agent") == a.agent).orderBy("dimension")), 0
        case "scores", "route":
            return _rows(scores.best_agents(t("scores")).where(F.col("dimension") == a.dimension)), 0
        case "scores", "auto":
            rows = spark.read.schema("node_cid string, agent string, step string, exit_code int, stderr string, created_at string").json(a.results)
            fresh = scores.auto_scores(rows)
            w.versions.commit({}, "auto scores", append={"scores": projection.fresh(t("scores"), fresh, ["id"])})
            return _rows(fresh), 0
        case "calibrate", "run":
            node, result = w.calibrate(a.root, allocate.Constraints(a.max_cost, a.max_depth, a.max_tier3))
            return {"node_cid": node, **result}, 0
        case "calibrate", "inspect":
            return _rows(allocate.inspect(t("calibrations"), a.cid)), 0
        case "calibrate", "history":
            return _rows(allocate.history(t("calibrations"), a.root)), 0
        case "repair", _:
            return w.repair(a.dry_run), 0
        case "status", _:
            return w.status(), 0
        case "history", _:
            return w.versions.log(), 0
        case "diff", _:
            new = a.new or w.versions.head()
            return _rows(w.versions.diff(a.table, a.old or new - 1, new)), 0
        case "link", "create":
            w.link(a.a, a.b, a.relation)
            return {"created": True}, 0
        case "link", "ls":
            return _rows(projection.soft_links(t("soft_links"), a.a, a.direction)), 0
        case "track", "add":
            return {"cid": w.track(os.path.abspath(a.path))}, 0
        case "track", "ls":
            return _rows(t("context_files").orderBy("path")), 0
        case "track", "rm":
            w.untrack(os.path.abspath(a.path))
            return {"removed": a.path}, 0
        case "drift", _:
            rows = w.drift()
            return rows, int(any(r["status"] != "OK" for r in rows) and not a.json)
        case "gc", _:
            return w.gc(a.delete), 0
        case "cas-stats", _:
            return w.cas_stats(), 0
        case "export", _:
            text = w.dag.export(a.cid)
            w.log("export", a.cid)
            if a.out == "-":
                return text, 0
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
            return {"written": a.out}, 0
        case "import", _:
            with open(a.path, encoding="utf-8") as f:
                n = w.dag.import_bundle(f.read())
            w.repair()
            w.log("import", f"{a.path} {n}")
            return {"new_blobs": n}, 0
        case "merge", _:
            return {"node_cid": w.merge(a.content, a.parents, a.agent)}, 0
        case "dot", _:
            nodes = w.dag.nodes()
            if a.root:
                nodes = nodes.join(w.dag.lineage(a.root).select("cid"), "cid", "left_semi")
            return "\n".join(r["line"] for r in graph.dot(nodes, graph.edges_of(nodes), t("soft_links")).toLocalIterator()), 0
        case "search", _:
            return _rows(graph.search_lines(w.store.df(), a.query, a.limit)), 0
        case "snapshot", "create":
            return {"nodes": w.snapshot(a.name)}, 0
        case "snapshot", "ls":
            from .operators import audit

            return _rows(audit.snapshots(w.snapshots())), 0
        case "snapshot", "verify":
            row = w.verify_snapshot(a.name)
            return row, int(not row["ok"] and not a.json)
        case "verify-projection", _:
            found, code = w.verify_projection()
            return _rows(found), code
        case "rebuild-projection", _:
            return w.rebuild_projection(), 0
    raise ValueError(f"unknown action {a.action!r} of {a.command}")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("veinstone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out, code = run(a, spark)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, indent=None if a.json else 2, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
