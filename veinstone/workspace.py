"""A home folder: blobs as Parquet, the log, versions of the projection, snapshots.

Blobs and the log are what is kept; everything else can be made again from them.  ``Store`` and
``Dag`` are the small API over single contents; their bulk forms take and give DataFrames.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import nodes as N
from .functions.address import cid, hash_bytes, hash_file
from .operators import allocate, audit, blobs, graph, projection, scores, symbols, tasks
from .sources import files, oplog
from .store import remove, scratch, written
from .versions import Versions


#: Column of a blob's partition.
PREFIX = "prefix"


class NotFound(KeyError):
    pass


def now() -> str:
    return datetime.now(UTC).isoformat()


class Store:
    """Content-addressed blobs in a folder of Parquet files, partitioned by the first two digits of the address.

    A point lookup reads one partition, of which row groups are skipped by their least and greatest
    address; bulk puts are sorted by address.
    """

    def __init__(self, spark: SparkSession, path: str, method: str = "sha256"):
        self.spark, self.path, self.method = spark, path, method
        if not os.path.isdir(path.removeprefix("file://")) and "://" not in path.removeprefix("file://"):
            raise NotFound(f"{path} is not initialised")

    @classmethod
    def init(cls, spark: SparkSession, path: str, method: str = "sha256") -> Store:
        spark.createDataFrame([], S.BLOBS).withColumn("prefix", F.lit("")).write.mode("append").partitionBy("prefix").parquet(path)
        return cls(spark, path, method)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"cid string, data binary, size long, {PREFIX} string").parquet(self.path)

    def df(self) -> DataFrame:
        return self._rows().drop(PREFIX)

    def at(self, address: str) -> DataFrame:
        """The row of an address, or none."""
        return blobs.get(self._rows().where(F.col(PREFIX) == address[:2]), address).drop(PREFIX)

    def _append(self, rows: DataFrame, mode: str = "append") -> None:
        placed = rows.select("cid", "data", "size", F.left("cid", F.lit(2)).alias(PREFIX))
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PREFIX).parquet(self.path)

    def put_df(self, rows: DataFrame, column: str) -> DataFrame:
        """Store a column of contents; returns ``cid`` of what is new."""
        return self.add(blobs.blobs_of(rows, F.col(column), self.method))

    def add(self, puts: DataFrame) -> DataFrame:
        """Store blobs; returns ``cid`` of what is new."""
        new = written(blobs.new_blobs(puts, self.df()), "puts")
        self._append(new.repartitionByRange("cid").sortWithinPartitions("cid"))
        return new.select("cid")

    def put(self, data: bytes | str) -> str:
        data = data.encode() if isinstance(data, str) else data
        address = hash_bytes(data, self.method)
        if not self.exists(address):
            self._append(self.spark.createDataFrame([(address, bytearray(data), len(data))], S.BLOBS).coalesce(1))
        return address

    def put_file(self, path: str) -> str:
        with open(path, "rb") as f:
            return self.put(f.read())

    def get(self, address: str) -> bytes:
        row = self.at(address).select("data").first()
        if row is None:
            raise NotFound(address)
        return bytes(row["data"])

    def exists(self, address: str) -> bool:
        return not self.at(address).isEmpty()

    def verify(self, address: str) -> bool:
        return hash_bytes(self.get(address), self.method) == address

    def list(self) -> list[str]:
        return [r["cid"] for r in blobs.listing(self.df()).toLocalIterator()]

    def blob_size(self, address: str) -> int:
        return len(self.get(address))

    def total_size(self) -> int:
        return blobs.total_size(self.df()).first()["total_size"]

    def remove(self, gone: DataFrame) -> None:
        """Delete what ``gone(cid)`` names: the partitions that are touched are written anew."""
        prefix = F.left("cid", F.lit(2))
        with scratch(self.spark):
            gone = written(gone.select("cid"), "gone")
            touched = [r["p"] for r in gone.select(prefix.alias("p")).distinct().collect()]  # of 256
            kept = written(blobs.delete(self._rows().where(F.col(PREFIX).isin(touched)), gone).drop(PREFIX), "kept")
            left = {r["p"] for r in kept.select(prefix.alias("p")).distinct().collect()}
            if left:
                self._append(kept, "overwrite")
            for p in set(touched) - left:
                remove(self.spark, f"{self.path}/{PREFIX}={p}")
        self.spark.catalog.refreshByPath(self.path)

    def delete(self, address: str) -> bool:
        if not self.exists(address):
            return False
        self.remove(self.at(address))
        return True


class Dag:
    """Nodes over a store."""

    def __init__(self, store: Store):
        self.store_, self.spark = store, store.spark

    def nodes(self) -> DataFrame:
        return graph.nodes_of(self.store_.df())

    def build(self, kind: str, parents: list[str], output_cid: str, agent: str, *, parent_kinds: list[str] | None = None, meta: list[tuple[str, str]] = (), schema_cid: str | None = None, saturation: float | None = None, activation: float | None = None, half_life_secs: float | None = None, floor: float = 0.0, timestamp: str | None = None) -> str:
        """Canonical JSON of a node."""
        if kind not in S.NODE_KINDS:
            raise ValueError(f"unknown node kind {kind!r}")
        if parent_kinds is not None:
            if len(parent_kinds) != len(parents):
                raise ValueError("parents and parent kinds must have one length")
            parent_kinds = [k if k in S.EDGE_KINDS else "derives" for k in parent_kinds]
            if all(k == "derives" for k in parent_kinds):
                parent_kinds = None
        node: dict = {"kind": kind, "parents": list(parents)}
        if parent_kinds:
            node["parent_kinds"] = parent_kinds
        meta = [list(m) for m in meta]
        if saturation is not None:
            meta.append(["saturation", f"{min(max(saturation, 0.0), 1.0):.7g}"])
        node |= {"output_cid": output_cid, "agent": agent, "timestamp": timestamp or now(), "meta": meta}
        if schema_cid is not None:
            node["schema_cid"] = schema_cid
        if half_life_secs is not None:
            node["activation"] = 1.0 if activation is None else float(activation)
            node["decay_config"] = {"half_life_secs": float(half_life_secs), "activation_floor": float(floor)}
        elif activation is not None:
            node["activation"] = float(activation)
        return json.dumps(node, separators=(",", ":"), ensure_ascii=False)

    def put_node(self, text: str) -> str:
        return self.store_.put(text)

    def store(self, content: bytes | str, kind: str, parents: list[str], agent: str, **more) -> tuple[str, str]:
        """Store a content and its node: (node address, content address)."""
        content_cid = self.store_.put(content)
        return self.put_node(self.build(kind, parents, content_cid, agent, **more)), content_cid

    def get_node(self, address: str) -> Row:
        row = graph.nodes_of(self.store_.at(address)).first()
        if row is None:
            raise NotFound(address)
        return row

    def lineage(self, address: str, max_depth: int | None = None) -> DataFrame:
        return graph.lineage(self.nodes(), self.spark.createDataFrame([(address,)], "start string"), max_depth).orderBy("depth", "cid")

    def check_drift(self, path: str, expected: str) -> bool:
        return hash_file(path, self.store_.method) != expected

    def export(self, root: str) -> str:
        """A bundle as JSON text."""
        rows = graph.bundle(self.nodes(), self.store_.df(), root).toLocalIterator()
        return json.dumps({"root_cid": root, "entries": [r.asDict() for r in rows]})

    def import_bundle(self, text: str) -> int:
        """Store what a bundle has and the store hasn't; the number of new blobs."""
        entries = json.loads(text)["entries"]
        if not entries:
            return 0
        rows = self.spark.createDataFrame([(e["node_cid"], e["node_bytes"], e["output_cid"], e["output_bytes"]) for e in entries], "node_cid string, node_bytes string, output_cid string, output_bytes string")
        return self.store_.add(graph.unbundle(rows, self.store_.method)).count()


class Workspace:
    """A home folder with everything in it."""

    def __init__(self, spark: SparkSession, home: str, method: str = "sha256"):
        self.spark, self.home = spark, home
        self.store = Store(spark, f"{home}/cas", method)
        self.dag = Dag(self.store)
        self.versions = Versions(spark, f"file://{home}/projection")

    @classmethod
    def init(cls, spark: SparkSession, home: str, method: str = "sha256") -> Workspace:
        home = os.path.abspath(home)
        os.makedirs(f"{home}/snapshots", exist_ok=True)
        Store.init(spark, f"{home}/cas", method)
        work = cls(spark, home, method)
        if work.versions.head() is None:
            work.versions.commit({n: spark.createDataFrame([], t) for n, (t, _) in S.PROJECTION.items()}, "init")
        work.log("init", home)
        return work

    def log(self, event: str, detail: str) -> None:
        oplog.append(f"{self.home}/log", event, detail)

    def log_tail(self, n: int = 20) -> DataFrame:
        return oplog.tail(oplog.read(self.spark, f"file://{self.home}/log"), n)

    def table(self, name: str) -> DataFrame:
        return self.versions.table(name)

    def upsert(self, name: str, rows: DataFrame, order: list[str], message: str, ignore: bool = False) -> None:
        rows = rows.select([F.col(f.name).cast(f.dataType) for f in S.PROJECTION[name][0]])
        keys = S.PROJECTION[name][1]
        if ignore:
            self.versions.commit({}, message, append={name: projection.ignored(self.table(name), rows, keys, order)})
        else:
            self.versions.commit({name: projection.replace_into(self.table(name), rows, keys, order)}, message)

    def execute(self, batch: str | list[str]) -> int:
        """INSERT, UPDATE and DELETE over the projection, as one version."""
        return self.versions.execute(batch)

    def rows(self, name: str, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, S.PROJECTION[name][0])

    # contents and nodes
    def put_file(self, path: str) -> str:
        address = self.store.put_file(path)
        self.log("put", f"{path} -> {address}")
        return address

    def create(self, content: bytes | str, kind: str, parents: list[str], agent: str, **more) -> tuple[str, str]:
        node, content_cid = self.dag.store(content, kind, parents, agent, **more)
        self.sync([node])
        self.log("dag:create", f"{kind} {node}")
        return node, content_cid

    def sync(self, addresses: list[str]) -> None:
        """Project nodes: what is there stays as it is."""
        nodes = graph.nodes_of(self.store.df().where(F.col("cid").isin(addresses)))
        fresh = projection.ignored(self.table("dag_nodes"), projection.dag_nodes_of(nodes), ["cid"], ["created_at"])
        edges = projection.ignored(self.table("dag_edges"), graph.edges_of(nodes), projection.EDGE_KEY, ["ordinal"])
        self.versions.commit({}, "sync", append={"dag_nodes": fresh, "dag_edges": edges})

    def merge(self, content: str, parents: list[str], agent: str, kind: str = "reasoning") -> str:
        if len(parents) < 2:
            raise ValueError("a merge has two parents at least")
        node, _ = self.create(content, kind, parents, agent)
        self.log("merge", node)
        return node

    def repair(self, dry_run: bool = False) -> dict:
        nodes = self.dag.nodes()
        missing = projection.repair(nodes, self.table("dag_nodes"))
        n, total = missing.count(), nodes.count()
        if n and not dry_run:
            lacking = nodes.join(missing.select("cid"), "cid", "left_semi")
            edges = projection.ignored(self.table("dag_edges"), graph.edges_of(lacking), projection.EDGE_KEY, ["ordinal"])
            self.versions.commit({}, "repair", append={"dag_nodes": missing, "dag_edges": edges})
        self.log("repair", f"synced={n} skipped={total - n}")
        return {"synced": n, "skipped": total - n, "errors": 0}

    def verify_projection(self) -> tuple[DataFrame, int]:
        """The differences, and the exit code: 0 clean, 1 not."""
        found = projection.verify(self.dag.nodes(), self.table("dag_edges"))
        return found, int(not found.isEmpty())

    def rebuild_projection(self) -> dict:
        fresh, report = projection.rebuild(self.dag.nodes(), self.table("dag_edges"))
        row = report.first().asDict()
        self.versions.commit({"dag_edges": fresh}, "rebuild")
        return row

    # housekeeping
    def gc(self, delete: bool = False) -> dict:
        row = blobs.gc_report(self.store.df(), self.dag.nodes()).first().asDict()
        if delete and row["orphans"]:
            self.store.remove(blobs.orphans(self.store.df(), self.dag.nodes()))
        self.log("gc", f"{'deleted' if delete else 'found'} {row['orphans']}")
        return row

    def cas_stats(self) -> dict:
        return blobs.cas_stats(self.store.df(), self.dag.nodes()).first().asDict()

    def status(self) -> dict:
        counts = {r["table_name"]: r["n"] for r in projection.stats(self.versions.tables()).collect()}
        return {"cas_blobs": self.store.df().count(), "dag_nodes": self.dag.nodes().count(), "tables": counts, "head": self.versions.head()}

    def snapshot(self, name: str) -> int:
        rows = audit.snapshot(self.dag.nodes(), name, now())
        rows.coalesce(1).write.mode("overwrite").json(f"file://{self.home}/snapshots/{name}")
        n = rows.count()
        self.log("snapshot:create", f"{name} {n}")
        return n

    def snapshots(self) -> DataFrame:
        kept = self.spark.read.schema("name string, created_at string, node_cid string, output_cid string")
        return kept.option("recursiveFileLookup", "true").json(f"file://{self.home}/snapshots")

    def verify_snapshot(self, name: str) -> dict:
        row = audit.verify_snapshot(self.snapshots().where(F.col("name") == name), self.store.df(), self.store.method).first()
        if row is None:
            raise NotFound(name)
        return row.asDict()

    # tracked files and symbols
    def track(self, path: str, agent: str = "human") -> str:
        address = self.put_file(path)
        self.upsert("context_files", self.rows("context_files", [(path, address, now(), agent)]), ["tracked_at"], f"track {path}")
        return address

    def untrack(self, path: str) -> None:
        self.versions.commit({"context_files": self.table("context_files").where(F.col("path") != path)}, f"untrack {path}")

    def drift(self) -> list[dict]:
        """Tracked files as they are now; tasks read them."""
        tracked = self.table("context_files").select("path", "cid")
        here = files.addresses(files.sized(tracked), self.store.method).withColumnRenamed("cid", "current_cid")
        found = audit.drift(tracked, here)
        return [r.asDict() for r in found.orderBy("path").collect()]

    def scan(self, path: str) -> int:
        """Symbols of a file or folder into the projection; scanned files are tracked.

        Files are read, addressed and taken apart by tasks; contents and a snapshot of each file's
        symbols are stored.
        """
        at, method = now(), self.store.method
        with scratch(self.spark):
            files = symbols.scan_dir(self.spark, os.path.abspath(path), method)
            files = written(files.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/")), "files")
            found = written(symbols.extract(files), "symbols")
            one = F.struct("start_line", F.negative("end_line").alias("last"), "name", "kind", "end_line", F.col("parent_symbol").alias("parent"))
            of = found.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("symbols"))
            language = symbols.language_of(F.col("file_path")).alias("language")
            shown = F.transform("symbols", lambda x: F.struct(*[x[c].alias(c) for c in ("name", "kind", "start_line", "end_line", "parent")]))
            kept = files.join(of, "file_path", "left").select(F.to_json(F.struct("file_path", language, F.col("file_cid").alias("content_cid"), F.coalesce(shown, F.array().cast(S.SYMBOL)).alias("symbols"))).alias("data"))
            both = files.select(F.col("source").alias("data")).union(kept)
            self.store.add(blobs.blobs_of(both, F.col("data"), method))
            tracked = files.select(F.col("file_path").alias("path"), F.col("file_cid").alias("cid"), F.lit(at).alias("tracked_at"), F.lit("cdom").alias("agent"))
            place = F.conv(F.substring(F.sha2(F.concat_ws(":", "file_path", "start_line", "end_line", "name", "kind"), 256), 1, 15), 16, 10).cast("long")
            rows = found.select(place.alias("id"), "file_path", "file_cid", "name", "kind", "start_line", "end_line", F.coalesce("parent_symbol", F.lit("")).alias("parent_symbol"), F.lit(at).alias("scanned_at"))
            tables = {"context_files": projection.replace_into(self.table("context_files"), tracked, ["path"], ["tracked_at"]), "cdom_symbols": projection.sync_symbols(self.table("cdom_symbols"), rows)}
            self.versions.commit(tables, f"scan {path}")
            n, seen = found.count(), files.count()
        self.log("put", f"{path} -> {seen} files")
        return n

    # scores, links, tasks, agents
    def score(self, node: str, agent: str, scorer: str, dimension: str, value: float, evidence: str = "") -> None:
        raw = self.spark.createDataFrame([(node, agent, scorer, dimension, float(value), evidence, now())], "node_cid string, agent string, scorer string, dimension string, value double, evidence string, created_at string")
        self.versions.commit({}, "score", append={"scores": projection.fresh(self.table("scores"), scores.record(raw), ["id"])})

    def link(self, a: str, b: str, relation: str) -> None:
        row = self.rows("soft_links", [(a, b, relation, now())])
        self.versions.commit({}, "link", append={"soft_links": projection.fresh(self.table("soft_links"), row, S.PROJECTION["soft_links"][1])})

    def create_task(self, title: str, created_by: str, parent: str = "") -> str:
        at = now()
        task = hash_bytes(f"{title}\x1f{created_by}\x1f{at}".encode())
        self.upsert("tasks", self.rows("tasks", [(task, title, "pending", None, created_by, at, at, parent, "", None, "")]), ["updated_at"], "task")
        return task

    def update_task(self, task: str, status: str | None = None, assigned_to: str | None = None, result_cid: str | None = None) -> None:
        if self.table("tasks").where(F.col("id") == task).isEmpty():
            raise NotFound(task)
        events = self.spark.createDataFrame([(task, now(), status, assigned_to, result_cid)], "id string, seq string, status string, assigned_to string, result_cid string")
        self.versions.commit({"tasks": tasks.fold_tasks(self.table("tasks"), events).select(S.TASKS.fieldNames())}, "task")

    def record_task_result(self, task: str, agent: str, text: str) -> str:
        """What an agent answered, as a reasoning node; agents are not run here."""
        if self.table("agents").where(F.col("name") == agent).isEmpty():
            raise NotFound(agent)
        node, _ = self.create(text, "reasoning", [], agent, meta=[("task", task)])
        self.update_task(task, status="done", result_cid=node)
        self.log("run", f"{agent} {task} -> {node}")
        return node

    def register_agent(self, name: str, command: str = "", mcp_capable: bool = False, capabilities: list[str] = (), model: str = "") -> None:
        preset = {p[0]: p for p in tasks.PRESETS}.get(name)
        if preset and not command:
            _, command, mcp_capable, capabilities, model = preset
        self.upsert("agents", self.rows("agents", [(name, command, mcp_capable, ",".join(capabilities), model or "", now())]), ["updated_at"], f"agent {name}")

    # allocation
    def tree(self, root: str) -> DataFrame:
        nodes = self.dag.nodes()
        starts = self.spark.createDataFrame([(root,)], "cid string")
        shape = graph.spanning_tree(nodes, graph.edges_of(nodes), starts).select("cid", "parent_cid", "depth")
        life = nodes.select("cid", F.col("decay_config.half_life_secs").alias("half_life_secs"))
        dag_nodes = nodes.select("cid", N.saturation(F.col("meta")).alias("saturation"))
        return allocate.potentials(shape.join(life, "cid"), dag_nodes, scores.mean_scores(self.table("scores")))

    def calibrate(self, root: str, limits: allocate.Constraints | None = None, agent: str = "calibrator") -> tuple[str, dict]:
        """Allocate tiers below a root and store the result as a node under it."""
        tree = self.tree(root)
        if tree.isEmpty():
            raise NotFound(root)
        found, tiers = allocate.optimise(tree, limits)
        result = {k: getattr(found, k) for k in ("lambda_cost", "lambda_depth", "lambda_tier3", "total_gain", "total_cost", "iterations", "heterogeneous", "feasible")}
        result |= {"root_cid": root, "allocated_tiers": {r["cid"]: r["tier"] for r in tiers.select("cid", "tier").orderBy("cid").toLocalIterator()}}
        node, _ = self.create(json.dumps(result, sort_keys=True), "reasoning", [root], agent, meta=[("type", "calibration")])
        row = (node, root, found.lambda_cost, found.lambda_depth, found.lambda_tier3, found.total_gain, found.total_cost, found.iterations, agent, now())
        self.upsert("calibrations", self.rows("calibrations", [row]), ["ts"], "calibrate")
        return node, result

    def traverse(self, root: str, calibration: str) -> DataFrame:
        """Walk down from a root as the stored calibration allows."""
        tiers = json.loads(self.store.get(self.dag.get_node(calibration)["output_cid"]))["allocated_tiers"]
        named = self.spark.createDataFrame(list(tiers.items()), "cid string, tier string")
        nodes = self.dag.nodes()
        known = named.join(self.tree(root).select("cid", "info_potential"), "cid", "left")
        return allocate.traverse(known, graph.edges_of(nodes), nodes, self.spark.createDataFrame([(root,)], "cid string"))


__all__ = ["Dag", "NotFound", "Store", "Workspace", "cid", "hash_bytes", "hash_file"]
