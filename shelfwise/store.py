"""Versioned snapshots of a library: a version is written whole beside the others, then one rename makes it one of them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schema import TABLES, LibraryState, conform


class Conflict(RuntimeError):
    """Another writer published a version since the one that this change started from."""


class SnapshotStore:
    """path/v00000001/<table>, and path/staging for what is being written. A folder v... appears by one rename, is whole
    then and never changes, so the highest one is the newest version whenever a writer dies. A version is published
    once: of two writers that started from the same one the second gets Conflict and loads again. The file system has
    to rename folders atomically, as HDFS and local ones do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._base: int | None = None

    def version(self) -> int:
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def load(self, version: int | None = None) -> LibraryState:
        """A version, the newest if none is given; the next publish starts from it."""
        v = self.version() if version is None else version
        if version is None:
            self._base = v
        if not v:
            return LibraryState.of(self.spark)
        return LibraryState.of(self.spark, **{t: self.spark.read.parquet(f"{self.path}/v{v:08d}/{t}") for t in TABLES})

    def publish(self, state: LibraryState) -> int:
        """state as the version after the one loaded last (after the newest, if none was loaded)."""
        v = (self.version() if self._base is None else self._base) + 1
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        for t, df in state.tables().items():
            conform(df, t).write.parquet(f"{staged}/{t}")
        target, source = self._path(f"{self.path}/v{v:08d}"), self._path(staged)
        inside = self._path(f"{self.path}/v{v:08d}/{staged.rsplit('/', 1)[1]}")
        # A rename onto a folder that another writer made meanwhile moves into it on some file systems; that is undone.
        lost = self.version() >= v or not self._fs.rename(source, target) or self._fs.exists(inside)
        if lost:
            for left in (source, inside):
                self._fs.delete(left, True)
            raise Conflict(f"version {v} was published by another writer")
        self._base = v
        return v


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir, or under one of our own where that is
    unset and all run on this machine. It goes when the application ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not shared:
        if not getattr(spark.sparkContext, "_shelfwise_settled", None):
            spark.sparkContext._shelfwise_settled = "file://" + tempfile.mkdtemp(prefix="shelfwise-")
        shared = spark.sparkContext._shelfwise_settled
    root = f"{shared}/shelfwise-state-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, root)
    return root


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what several branches of a plan use is computed once, and a lost
    executor costs no more than the last step."""
    root = shared_folder(df.sparkSession)
    df.write.parquet(root)
    return df.sparkSession.read.schema(df.schema).parquet(root)


def settle(state: LibraryState) -> LibraryState:
    """All tables settled, so that long chains of changes keep short plans."""
    return LibraryState.of(state.spark, **{t: settled(conform(df, t)) for t, df in state.tables().items()})


def _remove(spark: SparkSession, root: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone by now
        pass


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)
