"""Tables that are cut from their lineage, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession


class Owner:
    """The folders of some results; they are deleted when it is closed.  A closed one may be used again."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.paths = spark, []

    @contextmanager
    def collecting(self) -> Iterator[Owner]:
        """Makes it the owner of what this thread writes in the block, and leaves it open."""
        token = _owners.set((*_owners.get(), self))
        try:
            yield self
        finally:
            _owners.reset(token)

    def close(self) -> None:
        spark = self.spark or SparkSession.getActiveSession()
        while spark is not None and self.paths:
            remove(spark, self.paths.pop())


#: The owners that are open around the code that runs, the innermost last: each thread has its own.
_owners: ContextVar[tuple[Owner, ...]] = ContextVar("owners", default=())
#: Owns what is written outside of any other, until the process ends or it is closed.
unowned = Owner()


@atexit.register
def _tidy() -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        unowned.close()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        made = tempfile.mkdtemp(prefix="veinstone-")
        atexit.register(shutil.rmtree, made, True)
        named = f"file://{made}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Owner]:
    """Deletes, at its end, the tables that ``written`` made in it, but those to be kept.

    What is kept belongs to the owner around it, if there is one.
    """
    owner = Owner(spark)
    try:
        with owner.collecting():
            yield owner
    finally:
        owner.close()


def folder(spark: SparkSession, what: str, *, keep: bool = False) -> str:
    """A new folder's name in the shared one, for what isn't one table; it goes as ``written`` says."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    open_ = _owners.get()
    (unowned, *(open_[:-1] if keep else open_))[-1].paths.append(path)
    return path


def written(df: DataFrame, what: str, *, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and safe from lost executors.

    The table belongs to the innermost ``scratch`` or ``Owner`` of this thread, with ``keep`` to the one
    around it, and goes when that ends or is closed; without any, when the process ends.
    """
    path = folder(df.sparkSession, what, keep=keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
