"""Loan exports that keep arriving, and feedback as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.ingest import ingest, set_metadata
from ..sources.loans import COLUMNS
from ..store import SnapshotStore, settled


def stream_loans(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, update: bool = False) -> StreamingQuery:
    """Each micro-batch of CSV files under folder is ingested into the store's newest version. The version's metadata name
    the last batch it holds (key `stream:` and the checkpoint), so a batch that is run again after a failure is passed over."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    files = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)

    mark = f"stream:{checkpoint}"

    def add(batch: DataFrame, batch_id: int) -> None:
        state = store.load()
        last = state.metadata.filter(F.col("key") == mark).select("value").first()
        if last is not None and int(last[0]) >= batch_id:
            return
        fields = [X.blank_to_null(F.col(c)).alias(c) for c in COLUMNS]
        loans = batch.select(*fields, F.monotonically_increasing_id().alias("_pos")).filter("title IS NOT NULL AND author IS NOT NULL").withColumn("_bucket", F.shiftright("_pos", 33))
        new = ingest(state, loans, F.current_timestamp(), update)[1]
        store.publish(new.with_(metadata=set_metadata(settled(new.metadata), mark, F.lit(str(batch_id)), F.current_timestamp())))

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_feedback(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of feedback events (title, author, format, action, at, event_id) without repeats, and its counts by day
    and action, late events allowed for `delay`."""
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", "1 day"), "format", "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "format", "action", "n")
