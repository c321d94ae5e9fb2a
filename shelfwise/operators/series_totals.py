"""Series totals kept up from changes (A7, A8): what a batch of loans or feedback does to the counts of its series.

A book is read, unread or excluded by feedback. A batch gives the books that it touches with their state before and after; the
difference is a signed count for each series, so a book that goes back and forth leaves nothing. Totals lie in buckets of
their series' hash, a folder a bucket and version. A batch reads and rewrites the buckets of its own series; one small
file names the folders that count, with the batches that are in them, and appears by one rename: a batch that dies leaves
nothing, one that comes again is passed over, and the second of two writers gets Conflict."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LibraryState
from ..store import Conflict
from .series import judged

KEYS = ("author_id", "author", "series_name")
COUNTS = ("total_books", "books_read", "books_unread")
TOTALS = "author_id long, author string, series_name string, total_books long, books_read long, books_unread long"


def counted(state: LibraryState, keys: DataFrame | None = None) -> DataFrame:
    """Counts by series of the state's books, or of those with one of the keys (title, author)."""
    rows = judged(state)
    if keys is not None:
        wanted = keys.select(X.lower_trim(F.col("title")).alias("_t"), X.lower_trim(F.col("author")).alias("_a")).distinct()
        rows = rows.join(wanted, ["_t", "_a"], "left_semi")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("total_books"), F.count_if("_read").alias("books_read"), F.count_if("_unread").alias("books_unread"))


def changes(before: LibraryState, after: LibraryState, keys: DataFrame) -> DataFrame:
    """Signed counts by series of what differs between two states for the books with these keys (title, author)."""
    signed = counted(after, keys).unionByName(counted(before, keys).select(*KEYS, *((-F.col(c)).alias(c) for c in COUNTS)))
    return _summed(signed)


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in COUNTS))
    return sums.filter(" OR ".join(f"{c} <> 0" for c in COUNTS))


def shown(totals: DataFrame) -> DataFrame:
    """Q11's figures of each series that has a read or an unread book."""
    status = F.when(F.col("books_read") == 0, "not_started").when(F.col("books_unread") == 0, "complete").otherwise("partial")
    share = F.col("books_read") / F.col("total_books") * 100
    return totals.filter("books_read > 0 OR books_unread > 0").select(*KEYS, "total_books", "books_read", share.alias("completion_pct"), status.alias("status"), F.col("books_unread").alias("unread"))


class SeriesTotals:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        """version, folders by bucket, and the batches they hold, of the newest version."""
        at = self._path(f"{self.root}/versions")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        if not names:
            return {"version": 0, "folders": {}, "batches": []}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{names[-1]}", wholetext=True).first()[0])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(*(f"{self.root}/{f}" for f in folders))

    def totals(self) -> DataFrame:
        return self._read(sorted(self._current()["folders"].values()))

    def apply(self, batch: str, signed: DataFrame) -> list[int]:
        """Adds signed counts (KEYS, COUNTS) under the name of a batch; gives the buckets that were rewritten."""
        now = self._current()
        if batch in now["batches"]:
            return []
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")
        folder = f"data/{now['version'] + 1:08d}-{uuid.uuid4().hex}"
        delta = f"{self.root}/{folder}-signed"
        signed.select(*KEYS, *COUNTS).withColumn("bucket", bucket).write.parquet(delta)
        rows = self.spark.read.parquet(delta)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # `buckets` at most
        old = self._read([f for b, f in now["folders"].items() if int(b) in touched])
        _summed(old.unionByName(rows.drop("bucket"))).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        self._fs.delete(self._path(delta), True)
        written = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.isDirectory()}
        folders = {b: f for b, f in now["folders"].items() if int(b) not in touched} | {b: f"{folder}/bucket={b}" for b in written}
        self._publish({"version": now["version"] + 1, "folders": folders, "batches": [*now["batches"], batch]})
        return touched

    def _publish(self, new: dict) -> None:
        staged = self._path(f"{self.root}/staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        target = self._path(f"{self.root}/versions/{new['version']:08d}.json")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise Conflict(f"version {new['version']} of the totals was published by another writer")
