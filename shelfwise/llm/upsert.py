"""Keyed upsert into a table of sorted Parquet files: merge on read, then compaction of the files that changed.

`SortedFiles.create` writes a table as files of equally many rows, sorted by key. `homed` tells for any key the file where
it is or would be. `stage` compares changes with the table and writes two small tables beside it: deletion vectors, the
(file, row_index) of rows that go or are superseded, and deltas, the new values under the same row_index, or none for rows
that are new. A change that changes nothing leaves no trace, so a file is marked if and only if its rows differ. `merged` is
the table as readers see it then, vectors and deltas applied on the fly. `compact` reads the marked files alone,
writes each as few files as its rows need, joins small neighbours, and exchanges the files.

Work on rows is joins on the key or on (file, row_index), and positions: rows are dealt by ranges of the key, numbered inside
their range, and shifted by the counts of earlier ranges, so no task sees more than a range or the one file that it writes.
What passes the driver is the list of files, with one count each: 1,000 or so under the query's contract at any size.

A compaction is announced by one small file before files are exchanged; where a driver dies in between, `recover` carries
it to its end. Lost executors cost their tasks only, as all that is read twice lies in the shared folder.

Rows: null keys are never stored, and changes with a null key are ignored; rows that repeat a key are all changed, of
changes that repeat a key the caller's order picks one (`latest`; ties by all other values). Nulls are values like others. A
table without a file has no home for any key, so changes to it do nothing. Other columns of changes aren't read, and the
table's own may have any names but those of Spark's metadata.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, remove, session_of


def latest(changes: DataFrame, key: str, by: list[str], values: list[str]) -> DataFrame:
    """key, by and values of the greatest row of each key; nulls come first. Pre-aggregated, so a hot key is no group."""
    best = F.max(F.struct(*by, *(c for c in values if c not in by))).alias("best")
    return changes.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "best.*")


def _ranges(scratch: Scratch, rows: DataFrame, name: str, *order) -> DataFrame:
    """rows dealt by ranges of `order` and settled, with `range` and their place `at` in it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return scratch.write(dealt.select("*", F.shiftright("at", 33).alias("range")), name)


def _before(value, *group: str):
    """A window expression over ranges: value of all ranges before the row's own."""
    return value.over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))


def positioned(scratch: Scratch, rows: DataFrame, group: str, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `rank`, their place in their group by key; counts as `group`, range, n). A group may be any part of all rows."""
    dealt = _ranges(scratch, rows, name, group, key)
    counts = scratch.write(dealt.groupBy(group, "range").agg(F.count("*").alias("n"), F.min("at").alias("first")), f"{name}-counts")
    base = F.coalesce(_before(F.sum("n"), group), F.lit(0))
    bases = counts.select(group, "range", (base - F.col("first")).alias("shift"))
    ranked = dealt.join(bases, [group, "range"]).withColumn("rank", F.col("at") + F.col("shift"))
    return ranked.drop("at", "range", "shift"), counts


def layout(counts: dict[int, int], marked: Iterable[int], most: int) -> dict[int, tuple[int, int, int, int]]:
    """{home: (pieces, rows of a smaller piece, how many have one more, and the (home, piece) file its first piece goes to)}
    of the marked files, by ascending number. A first piece joins its left neighbour where that is a rewritten file, no
    unmarked one stands between, and both fit. Later pieces never can: two pieces of one home exceed `most`."""
    found, left, before = {}, None, None
    for home in sorted(marked):
        if before is not None and home != before + 1:
            left = None
        before, n = home, counts.get(home, 0)
        if not n:
            continue
        pieces = -(-n // most)
        small, more = divmod(n, pieces)
        first = small + (more > 0)
        joins = left is not None and left[2] + first <= most
        target = left[:2] if joins else (home, 0)
        found[home] = (pieces, small, more, *target)
        left = (*target, first + (left[2] if joins else 0)) if pieces == 1 else (home, pieces - 1, small)
    return found


class SortedFiles:
    """root/data holds the table: 00000007.parquet is its starting file 7, 00000007-000002.parquet a rewritten one."""

    def __init__(self, spark: SparkSession, root: str, key: str, rows_per_file: int, schema):
        self.spark, self.root, self.key, self.most, self.schema = spark, root, key, rows_per_file, schema
        self.data, self.scratch = f"{root}/data", Scratch(spark)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str, rows_per_file: int) -> SortedFiles:
        made = cls(session_of(rows), root, key, rows_per_file, rows.schema)
        kept = rows.filter(F.col(key).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(key).alias("key"), F.lit(0).alias("all"))
        ranked, _ = positioned(made.scratch, kept, "all", "key", "start")
        made._write(ranked.withColumn("file", F.format_string("%08d", F.floor(F.col("rank") / rows_per_file).cast("long"))), "start")
        made.scratch.drop("start")
        made._exchange("start", [])
        return made

    # Files

    def files(self) -> list[str]:
        """Names of the table's files in their order."""
        at = self._path(self.data)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _write(self, rows: DataFrame, name: str) -> None:
        """Writes row, a file for each value of `file`, by key. Each file has at most `most` rows, and one task writes it."""
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        ordered = rows.select("row.*", F.col("key").alias("__key"), F.col("file").alias("__file")).repartition(tasks, "__file").sortWithinPartitions("__file", "__key").drop("__key")
        ordered.write.partitionBy("__file").parquet(f"{self.root}/staged/{name}")

    def _exchange(self, name: str, gone: list[str]) -> None:
        """Moves the files that were written under a name to the table, then deletes those of it that they replace."""
        out = self._fs.create(self._path(f"{self.root}/exchange.json"), True)
        out.write(bytearray(json.dumps({"name": name, "gone": gone}).encode()))
        out.close()
        self.recover()

    def recover(self) -> None:
        """Carries an exchange that was announced to its end; each step may be repeated."""
        note = self._path(f"{self.root}/exchange.json")
        if not self._fs.exists(note):
            return
        asked = json.loads(self.spark.read.text(note.toString(), wholetext=True).first()[0])
        self._fs.mkdirs(self._path(self.data))
        for s in self._fs.globStatus(self._path(f"{self.root}/staged/{asked['name']}/__file=*/part-*")) or []:
            file = s.getPath().getParent().getName().removeprefix("__file=")
            self._fs.rename(s.getPath(), self._path(f"{self.data}/{file}.parquet"))
        for file in asked["gone"]:
            self._fs.delete(self._path(f"{self.data}/{file}"), False)
        remove(self.spark, f"{self.root}/staged")
        self._fs.delete(note, False)

    def read(self, files: list[str] | None = None) -> DataFrame:
        """The table, or some of its files, with the name of each row's file and its index there."""
        paths = [self.data] if files is None else [f"{self.data}/{f}" for f in files]
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_path").alias("path"))

    # Merge on read

    def homed(self, keys: DataFrame) -> DataFrame:
        """keys with `home`, the number of the last starting file that begins at or below the key, else the first one, and
        `home_first`, its first key. Files and keys meet in ranges of the key; what a range begins with comes from those
        before it."""
        firsts = self.read().groupBy("file").agg(F.min(f"row.{self.key}").alias("first")).select(F.struct(F.substring("file", 1, 8).cast("long").alias("home"), F.col("first").alias("home_first")).alias("start"), F.lit(None).cast(keys.select(F.struct("*").alias("x")).schema["x"].dataType).alias("asked"))
        wanted = keys.filter(F.col(self.key).isNotNull()).select(F.lit(None).cast(firsts.schema["start"].dataType).alias("start"), F.struct("*").alias("asked"))
        both = firsts.unionByName(wanted).withColumn("key", F.coalesce("start.home_first", F.col(f"asked.{self.key}"))).withColumn("later", F.col("asked").isNotNull())
        dealt = _ranges(self.scratch, both, "homes", "key", "later")
        ends = self.scratch.write(dealt.groupBy("range").agg(F.max("start").alias("last"), F.min("start").alias("least")), "home-ends")
        whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carried = ends.select("range", F.coalesce(_before(F.max("last")), F.min("least").over(whole)).alias("carried"))  # a row a range
        inside = F.last("start", ignorenulls=True).over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        found = dealt.withColumn("inside", inside).filter("later").join(carried, "range")
        return found.select("asked.*", F.coalesce("inside", "carried").alias("__start")).select(*keys.columns, "__start.home", "__start.home_first")

    def stage(self, changes: DataFrame, values: list[str]) -> None:
        """changes: key, home, deletes (boolean) and values. Writes vectors (file, row_index) and deltas (file, row_index, home,
        key, new); null flags don't delete."""
        now = self.read().select(F.col(f"row.{self.key}").alias("key"), "file", "row_index", F.struct(*(F.col(f"row.{c}") for c in values)).alias("now"))
        asked = changes.select(F.col(self.key).alias("key"), "home", F.coalesce("deletes", F.lit(False)).alias("deletes"), F.struct(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in values)).alias("new"))
        differs = reduce(or_, (~F.col(f"now.{c}").eqNullSafe(F.col(f"new.{c}")) for c in values))
        known = F.col("row_index").isNotNull()
        effective = asked.join(now, "key", "left").filter(F.when(F.col("deletes"), known).otherwise(~known | differs))
        staged = self.scratch.write(effective.drop("now"), "effective")
        vectors = staged.filter(known).select("file", "row_index")
        vectors.write.mode("overwrite").parquet(f"{self.root}/vectors")
        staged.filter(~F.col("deletes")).select("file", "row_index", "home", "key", "new").write.mode("overwrite").parquet(f"{self.root}/deltas")
        self.scratch.drop("effective")

    def _staged(self) -> tuple[DataFrame, DataFrame]:
        read = self.spark.read
        return read.parquet(f"{self.root}/vectors"), read.parquet(f"{self.root}/deltas")

    def merged(self, files: list[str] | None = None) -> DataFrame:
        """row, key and home of the table, or of some files of it with all rows that are new, vectors and deltas applied."""
        vectors, deltas = self._staged()
        home = F.substring("file", 1, 8).cast("long")
        new = deltas.schema["new"].dataType.names
        vectors = vectors.withColumn("gone", F.lit(True)).join(deltas.filter("row_index IS NOT NULL").select("file", "row_index", "new"), ["file", "row_index"], "left")
        old = self.read(files).join(vectors, ["file", "row_index"], "left").filter("gone IS NULL OR new IS NOT NULL")
        columns = self.schema.names
        replaced = F.struct(*((F.when(F.col("gone"), F.col(f"new.{c}")).otherwise(F.col(f"row.{c}")) if c in new else F.col(f"row.{c}")).alias(c) for c in columns))
        inserted = F.struct(*((F.col("key") if c == self.key else F.col(f"new.{c}") if c in new else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in columns))
        kept = old.select(replaced.alias("row"), F.col(f"row.{self.key}").alias("key"), home.alias("home"))
        return kept.unionByName(deltas.filter("row_index IS NULL").select(inserted.alias("row"), "key", "home"))

    # Compaction

    def compact(self) -> list[int]:
        """Rewrites the files that vectors and deltas mark, and gives their numbers."""
        vectors, deltas = self._staged()
        of_file = vectors.select(F.substring("file", 1, 8).cast("long").alias("home")).unionByName(deltas.select("home"))
        marked = sorted(r["home"] for r in of_file.distinct().collect())  # files, not rows
        files = [f"{k:08d}.parquet" for k in marked]
        if marked:
            ranked, counts = positioned(self.scratch, self.merged(files), "home", "key", "new")
            per_home = {r["home"]: r["n"] for r in counts.groupBy("home").agg(F.sum("n").alias("n")).collect()}  # one a file
            plan = layout(per_home, marked, self.most)
            targets = self.spark.createDataFrame([(k, *v) for k, v in plan.items()], "home long, pieces long, small long, more long, to_home long, to_piece long")
            longer = F.col("more") * (F.col("small") + 1)
            piece = F.when(F.col("rank") < longer, F.floor(F.col("rank") / (F.col("small") + 1))).otherwise(F.col("more") + F.floor((F.col("rank") - longer) / F.col("small")))
            first = F.col("piece") == 0
            file = F.format_string("%08d-%06d", F.when(first, F.col("to_home")).otherwise(F.col("home")), F.when(first, F.col("to_piece")).otherwise(F.col("piece")))
            self._write(ranked.join(F.broadcast(targets), "home").withColumn("piece", piece.cast("long")).withColumn("file", file), "new")
            self._exchange("new", files)
        for left in ("vectors", "deltas"):
            remove(self.spark, f"{self.root}/{left}")
        for left in ("new", "new-counts", "start-counts", "homes", "home-ends"):
            self.scratch.drop(left)
        return marked

    def hashes(self, of: str) -> DataFrame:
        """path and the SHA-256 of a column's values in file order, comma-joined. Rows stream past, a hash at a time."""
        rows = self.read().select("path", "row_index", F.col(f"row.{of}").cast("string").alias("value"))

        def run(batches):
            import hashlib

            path, state = None, None
            for b in batches:
                for p, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    if p != path:
                        if state is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state.hexdigest()])], names=["path", "sha256"])
                        path, state = p, hashlib.sha256((v or "").encode())
                    else:
                        state.update(b"," + (v or "").encode())
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state.hexdigest()])], names=["path", "sha256"])

        tasks = 4 * self.spark.sparkContext.defaultParallelism
        return rows.repartition(tasks, "path").sortWithinPartitions("path", "row_index").mapInArrow(run, "path string, sha256 string")


def crc32(value) -> F.Column:
    return F.crc32(value.cast("string").cast("binary"))


VALUES = ["source", "segment", "city", "balance"]


def upsert_clients(clients: DataFrame, changes: DataFrame, root: str) -> DataFrame:
    """The files of clients after the latest change of each id, one row a file, under a new folder root."""
    per_file = 1 + clients.count() // 1000
    table = SortedFiles.create(clients.filter(crc32(F.col("client_id")) % 7 > 3), root, "client_id", per_file)
    if not table.files():
        return clients.sparkSession.createDataFrame([], "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean")
    chosen = latest(changes, "client_id", ["seq", "change_id"], ["op", *VALUES])
    homed = table.homed(chosen)
    h = crc32(F.col("home_first")) % 16
    deletes = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(crc32(F.col("change_id")) % 8 < h, F.lit(False))
    table.stage(homed.filter(h <= 7).withColumn("deletes", deletes), VALUES)
    table.compact()
    text = F.concat_ws("|", *(F.coalesce(F.col(f"row.{c}"), F.lit("")) for c in ("source", "segment", "city")))
    cents = F.coalesce(F.floor(100 * F.col("row.balance") + 0.5), F.lit(0)).cast("long")
    sums = table.read().groupBy("path", "file").agg(F.min("row.client_id").alias("first_id"), F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.sum(crc32(text)).alias("rows_crc"))
    columns = F.lit(",".join(table.schema.names))
    return sums.join(table.hashes("client_id"), "path").select("first_id", "n_rows", "cents", "rows_crc", F.col("sha256").alias("ids_sha256"), columns.alias("columns"), "path", F.col("file").contains("-").alias("rewritten"))
