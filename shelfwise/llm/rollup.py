"""Token totals kept up to date by signed deltas.

A batch of events (insert, delete, revise) becomes additive deltas of documents and tokens by source, language and
tokenizer version: inserts add, deletes subtract, a revision adds its new count less its old one. A batch is committed
under its id by one rename, so a batch that is delivered again, or whose writer died and was started again, counts
once. Totals are the sums of all committed deltas; compaction folds committed batches into a snapshot that lists them,
so replays stay without effect after it too.

Deltas are aggregated map-side first: a source with a third of all rows costs a row per task. Nothing is read per
document but the batch itself. Rows: null source, lang or tokenizer is a group of its own; null counts are 0; groups
whose documents and tokens are all taken back are left out; an event of an unknown kind fails the batch. Columns of
events besides those named are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns, session_of
from .packing import Encoder
from .quality import BLANKS, count_any, words_of

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Marks that the second version of the word counter takes as tokens of their own.
MARKS = ".,;:!?|"


def deltas(events: DataFrame) -> DataFrame:
    """events: kind (insert, delete, revise), source, lang, tokenizer, tokens, old_tokens (what a revision replaces)."""
    kind = F.col("kind")
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    change = F.when(kind == "revise", tokens - old).otherwise(sign * tokens)
    return events.select(*KEYS, sign.alias("docs"), change.alias("change")).groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("change").cast("long").alias("tokens"))


class TokenTotals:
    """path/batches/<id>: the deltas of a committed batch; path/snapshots/<n>: totals and, in rows of their own, the ids of
    the batches folded into them. Folders appear by one rename and are never changed, so the file system must rename
    folders atomically (HDFS and local ones do; on an object store a committer or table format has to stand in)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _remove(self, place: str) -> None:
        fs, where = self._fs(f"{self.path}/{place}")
        fs.delete(where, True)

    def _publish(self, df: DataFrame, place: str) -> bool:
        """df as the folder `place`, whole or not at all; False if another writer was first."""
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        fs, target = self._fs(f"{self.path}/{place}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(self._fs(staged)[1], target):
            fs.delete(self._fs(staged)[1], True)
            return False
        # A rename onto a folder that appeared meanwhile moves into it on some file systems; undo that.
        inside = self._fs(f"{self.path}/{place}/{staged.rsplit('/', 1)[1]}")[1]
        if fs.exists(inside):
            fs.delete(inside, True)
            return False
        return True

    def _snapshot(self) -> DataFrame:
        """The newest snapshot: SCHEMA and batch, which is null in rows of totals and an id in all others."""
        found, schema = self._names("snapshots"), f"{SCHEMA}, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def _pending(self) -> list[str]:
        """Committed batches that the newest snapshot doesn't hold: those since the last compaction."""
        names = self._names("batches")
        folded = {r["batch"] for r in self._snapshot().filter(F.col("batch").isin(names)).select("batch").collect()}
        return [n for n in names if n not in folded]

    def committed(self) -> set[str]:
        """All batches ever committed, for inspection."""
        return set(self._names("batches")) | {r["batch"] for r in self._snapshot().filter("batch IS NOT NULL").select("batch").collect()}

    def is_committed(self, batch_id: str) -> bool:
        # Compaction publishes a snapshot before it removes what it folded, so this order misses no batch.
        fs, where = self._fs(f"{self.path}/batches/{batch_id}")
        return fs.exists(where) or not self._snapshot().filter(F.col("batch") == batch_id).isEmpty()

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Adds the batch; False, without effect, if a batch of that id was committed before."""
        return not self.is_committed(batch_id) and self._publish(deltas(events), f"batches/{batch_id}")

    def _summed(self, pending: list[str]) -> DataFrame:
        parts = self._snapshot().filter("batch IS NULL").drop("batch")
        if pending:
            parts = parts.unionByName(self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/batches/{b}" for b in pending)))
        return parts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        return self._summed(self._pending())

    def compact(self) -> bool:
        """Folds what is committed now into a new snapshot, then removes the folders it replaces; batches committed
        meanwhile stay beside it. A batch that a late writer commits again after that is listed, so it doesn't count."""
        pending, old = self._pending(), self._names("snapshots")
        ids = self._snapshot().filter("batch IS NOT NULL").select("batch")
        if pending:
            ids = ids.unionByName(self.spark.createDataFrame([(b,) for b in pending], "batch string"))
        rows = self._summed(pending).withColumn("batch", F.lit(None).cast("string"))
        if not self._publish(rows.unionByName(ids, allowMissingColumns=True), f"snapshots/{int(old[-1]) + 1 if old else 0:08d}"):
            return False
        for place in [f"batches/{b}" for b in pending] + [f"snapshots/{n}" for n in old[:-1]]:  # the last one may still be read
            self._remove(place)
        return True


def native_counts(text: Column) -> dict[str, Column]:
    """Counters that run in the JVM, by tokenizer version."""
    words = F.size(words_of(text))
    return {
        "bytes-1": F.octet_length(text),
        "bytes-2": F.octet_length(F.btrim(text, F.lit(BLANKS))),
        "words-1": words,
        "words-2": words + count_any(text, MARKS),
    }


def inserted(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """docs (source, lang, text) as insert events counted by a tokenizer file."""

    def run(texts):
        encoder = Encoder.of_process(tokenizer_path)
        return [pa.array([encoder.count(t or "") for t in texts.to_pylist()], pa.int64())]

    counted = add_columns(docs.select("source", "lang", "text"), run, ["text"], [("tokens", T.LongType())], keep=["source", "lang"])
    return counted.select(F.lit("insert").alias("kind"), "source", "lang", F.lit(version).alias("tokenizer"), "tokens", F.lit(None).cast("long").alias("old_tokens"))


def maintained_totals(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """A corpus's life as batches under counters that SQL can follow: all documents come in under two counters; the word
    counter moves to its second version; byte counts are revised to those without surrounding blanks; documents under
    least_words words are taken out and come back. Batches are delivered twice, before or after compaction. Gives the
    totals then."""
    spark = session_of(docs)
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    counts = native_counts(F.col("t"))
    ledger = scratch.write(docs.select("source", "lang", text.alias("t")).select("source", "lang", *(c.cast("long").alias(v) for v, c in counts.items())), "ledger")

    def event(kind: str, tokenizer: str, count: str, old: str | None = None, rows: DataFrame = ledger) -> DataFrame:
        return _events(rows, kind, tokenizer, F.col(f"`{count}`"), F.col(f"`{old}`") if old else None)

    def both(kind: str) -> DataFrame:
        short = ledger.filter(F.col("`words-1`") < least_words)
        return event(kind, "bytes-1", "bytes-2", rows=short).unionByName(event(kind, "words-2", "words-2", rows=short))

    batches = {
        "0-ingest": event("insert", "bytes-1", "bytes-1").unionByName(event("insert", "words-1", "words-1")),
        "1-retokenize": event("delete", "words-1", "words-1").unionByName(event("insert", "words-2", "words-2")),
        "2-recount": event("revise", "bytes-1", "bytes-2", "bytes-1"),
        "3-purge": both("delete"),
        "4-return": both("insert"),
    }
    return _delivered_twice(TokenTotals(spark, f"{scratch.root}/totals"), batches)


def _events(rows: DataFrame, kind: str, tokenizer: str, tokens: Column, old: Column | None = None) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), (F.lit(None) if old is None else old).cast("long").alias("old_tokens"))


def tokenizer_totals(docs: DataFrame, files: dict[str, str], least_words: int = 50) -> DataFrame:
    """Totals of all documents under each tokenizer file (version: path), after a life of batches: all documents come in
    with an estimate (a quarter of their bytes), and each version's counts replace its estimates as revisions; documents
    under least_words words are taken out of all versions and come back. Each text is counted once per version, into a
    ledger; batches are delivered twice as in maintained_totals."""
    spark = session_of(docs)
    scratch = Scratch(spark)

    def run(texts, words):
        encoders = [Encoder.of_process(path) for path in files.values()]
        texts = texts.to_pylist()
        return [*(pa.array([e.count(t) for t in texts], pa.int64()) for e in encoders), pa.compute.less(words, least_words)]

    source = docs.select("source", "lang", F.coalesce("text", F.lit("")).alias("t"))
    source = source.select("source", "lang", "t", F.size(words_of(F.col("t"))).alias("n"), F.floor(F.octet_length("t") / 4).cast("long").alias("estimate"))
    fields = [*((v, T.LongType()) for v in files), ("short", T.BooleanType())]
    ledger = scratch.write(add_columns(source, run, ["t", "n"], fields, keep=["source", "lang", "estimate"]), "ledger")

    def every(kind: str, rows: DataFrame, tokens: Callable[[str], Column]) -> DataFrame:
        return reduce(DataFrame.unionByName, (_events(rows, kind, v, tokens(v)) for v in files))

    short = ledger.filter("short")
    batches = {"0-estimate": every("insert", ledger, lambda v: F.col("estimate"))}
    batches |= {f"1-count-{v}": _events(ledger, "revise", v, F.col(f"`{v}`"), F.col("estimate")) for v in files}
    batches |= {"2-purge": every("delete", short, lambda v: F.col(f"`{v}`")), "3-return": every("insert", short, lambda v: F.col(f"`{v}`"))}
    return _delivered_twice(TokenTotals(spark, f"{scratch.root}/totals"), batches)


def _delivered_twice(totals: TokenTotals, batches: dict[str, DataFrame]) -> DataFrame:
    """The totals after all batches, the first two delivered again before compaction and the others after it."""
    for name, events in batches.items():
        totals.commit(name, events)
    for name in list(batches)[:2]:
        totals.commit(name, batches[name])
    totals.compact()
    for name in list(batches)[2:]:
        totals.commit(name, batches[name])
    return totals.totals()
