"""Versioned tables: a folder for each version, pointers, a log, and named branches.

A commit writes a new folder and then a new pointer, which is never changed afterwards: pointers of a
branch are numbered and the highest wins, so readers see whole versions only, at any time.  A pointer
is written beside its place and renamed to it if nothing is there; of two commits that want one
number, one fails with ``Conflict`` and its tables are seen by nobody.  Tables that a commit doesn't
give are carried over by reference, and rows that are only appended are a folder more of their table,
until ``MAX_FOLDERS`` are written as one.  Pointers go through the file system of the session; its rename
must be atomic, as that of HDFS and of local disks is.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of a table before an append writes it anew.
MAX_FOLDERS = 32


class Conflict(RuntimeError):
    """Another commit was faster."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _get(self, name: str) -> dict | None:
        fs, p = self._fs(f"{self.path}/{name}.json")
        if not fs.exists(p):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}.json", wholetext=True).collect()))

    def _put(self, name: str, value: dict) -> None:
        """Make a file that isn't there yet, whole."""
        fs, p = self._fs(f"{self.path}/new-{uuid.uuid4().hex}")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        _, to = self._fs(f"{self.path}/{name}.json")
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise Conflict(name)

    def _numbers(self, folder: str) -> list[int]:
        fs, p = self._fs(f"{self.path}/{folder}/*.json")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.globStatus(p) or [])

    def _pointer(self, branch: str) -> tuple[int, int | None]:
        """The number of a branch's newest pointer, and the version that it names."""
        seen = self._numbers(f"branch-{branch}")
        return (seen[-1], self._get(f"branch-{branch}/{seen[-1]}")["version"]) if seen else (0, None)

    def head(self, branch: str = "main") -> int | None:
        return self._pointer(branch)[1]

    def commit(self, tables: dict[str, DataFrame], message: str, branch: str = "main", append: dict[str, DataFrame] | None = None) -> int:
        """A new version of a branch, with the tables given and with rows appended to others; returns its number."""
        turn, parent = self._pointer(branch)
        folder = uuid.uuid4().hex
        where = dict(self.manifest(parent)["tables"]) if parent else {}
        for name, df in tables.items():
            where[name] = [self._write(df, folder, name)]
        for name, rows in (append or {}).items():
            if len(where[name]) < MAX_FOLDERS:
                where[name] = [*where[name], self._write(rows, folder, name)]
            else:
                where[name] = [self._write(self.table(name, parent).unionByName(rows), folder, name)]
        n = (self._numbers("versions") or [0])[-1] + 1
        self._put(f"versions/{n}", {"version": n, "parent": parent, "message": message, "ts": time.time(), "tables": where})
        self._put(f"branch-{branch}/{turn + 1}", {"version": n})
        return n

    def _write(self, df: DataFrame, folder: str, name: str) -> str:
        df.write.mode("errorifexists").parquet(f"{self.path}/data/{folder}/{name}")
        return f"data/{folder}/{name}"

    def manifest(self, version: int) -> dict:
        found = self._get(f"versions/{version}")
        if found is None:
            raise ValueError(f"no version {version}")
        return found

    def log(self, branch: str = "main") -> list[dict]:
        """Versions of a branch, newest first."""
        out, at = [], self.head(branch)
        while at:
            out.append(self.manifest(at))
            at = out[-1]["parent"]
        return out

    def branch(self, name: str, at: int | None = None) -> None:
        self._put(f"branch-{name}/{self._pointer(name)[0] + 1}", {"version": at or self.head()})

    def branches(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/branch-*")
        return sorted(s.getPath().getName()[len("branch-") :] for s in fs.globStatus(p) or [])

    def table(self, name: str, version: int | None = None, branch: str = "main") -> DataFrame:
        """A table as of a version, the head of the branch by default."""
        version = version or self.head(branch)
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in self.manifest(version)["tables"][name]])

    def tables(self, version: int | None = None, branch: str = "main") -> dict[str, DataFrame]:
        version = version or self.head(branch)
        return {} if version is None else {t: self.table(t, version) for t in self.manifest(version)["tables"]}

    def sql(self, text: str, version: int | None = None, args: dict | None = None) -> DataFrame:
        """SQL over the tables of a version; ``args`` are named parameters."""
        for name, df in self.tables(version).items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or {})

    def execute(self, batch: str | list[str], message: str = "sql", branch: str = "main") -> int:
        """INSERT, UPDATE and DELETE statements over the head, one after another, as one version: all of them or none."""
        batch = [batch] if isinstance(batch, str) else batch
        tables = self.tables(branch=branch)
        after = changed(self.spark, tables, batch)
        return self.commit({n: df for n, df in after.items() if df is not tables[n]}, message, branch)

    def diff(self, name: str, old: int, new: int) -> DataFrame:
        return diff(self.table(name, old), self.table(name, new))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that went and came, with ``change`` - or +; repeats count."""
    return old.exceptAll(new).withColumn("change", F.lit("-")).union(new.exceptAll(old).withColumn("change", F.lit("+")))


_INSERT = re.compile(r"\s*INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*)?((?:VALUES|SELECT|WITH)\b.*)", re.I | re.S)
_DELETE = re.compile(r"\s*DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", re.I | re.S)
_UPDATE = re.compile(r"\s*UPDATE\s+(\w+)\s+SET\s+(.*)", re.I | re.S)
#: What stands in brackets, quotes or by itself.
_PIECE = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|\"[^\"]*\"|[(\[]|[)\]]|,|\bWHERE\b|\bCASE\b|\bEND\b|[^'`\",()\[\]\s]+|\s+", re.I)


def _assignments(text: str) -> tuple[list[tuple[str, str]], str | None]:
    """(column, expression) of a SET list, and the condition after it."""
    parts, depth, at, condition = [""], 0, 0, None
    for m in _PIECE.finditer(text):
        piece = m.group()
        depth += (piece in "([" or piece.upper() == "CASE") - (piece in ")]" or piece.upper() == "END")
        if depth == 0 and piece.upper() == "WHERE":
            condition = text[m.end() :]
            break
        if depth == 0 and piece == ",":
            parts.append("")
        else:
            parts[-1] += piece
        at = m.end()
    if condition is None and at < len(text):
        raise ValueError(f"can't read {text[at:]!r}")
    pairs = [tuple(x.strip() for x in p.split("=", 1)) for p in parts]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"can't read {text!r}")
    return [(c.strip("`"), e) for c, e in pairs], condition


def changed(spark: SparkSession, tables: dict[str, DataFrame], batch: list[str]) -> dict[str, DataFrame]:
    """The tables after INSERT, UPDATE and DELETE statements, each of which sees what those before it did.

    Expressions, conditions and queries are Spark SQL; a condition that is null holds for no row.
    Inserted values are cast to the table's types and columns that aren't named are null.
    """
    now = dict(tables)
    for text in batch:
        text = text.strip().rstrip(";")
        m = _INSERT.fullmatch(text) or _DELETE.fullmatch(text) or _UPDATE.fullmatch(text)
        if m is None or m.group(1) not in now:
            raise ValueError(f"no INSERT, UPDATE or DELETE of a known table: {text!r}")
        name = m.group(1)
        df = now[name]
        for n, x in now.items():
            x.createOrReplaceTempView(n)
        if m.re is _INSERT:
            names = [c.strip().strip("`") for c in m.group(2).split(",")] if m.group(2) else df.columns
            rows = spark.sql(m.group(3)).toDF(*names)
            if strange := set(names) - set(df.columns):
                raise ValueError(f"{name} has no {sorted(strange)}")
            given = [(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]
            now[name] = df.union(rows.select(*given))
        elif m.re is _DELETE:
            holds = F.coalesce(F.expr(m.group(2)), F.lit(False)) if m.group(2) else F.lit(True)
            now[name] = df.where(~holds)
        else:
            pairs, condition = _assignments(m.group(2))
            if strange := {c for c, _ in pairs} - set(df.columns):
                raise ValueError(f"{name} has no {sorted(strange)}")
            holds = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
            new = dict(pairs)
            now[name] = df.select(*[F.when(holds, F.expr(new[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in df.schema])
    return now
