"""Feedback as a stream with state (D7, D8): of each title and author, the latest setter of every flag.

The state of a key is, for each flag, the value, time and action of the event that set it last, and the title, author and time
of the latest event. A later event replaces what is older, so late and repeated events change nothing, and after a
restart the state goes on from the checkpoint. Each batch gives the rows whose keys had events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.feedback import ACTIONS, FLAGS

ROWS = "title string, author string, format string, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", feedback_at long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of events without one: before all others.
NO_TIME = -(1 << 62)


def _setter(flag: str) -> Column:
    """at, action and value of the latest event that sets a flag."""
    values = {a: v[flag] for a, v in ACTIONS.items() if flag in v}
    value = reduce(lambda w, x: w.when(F.col("action") == x[0], F.lit(x[1])), values.items(), F)
    return F.max(F.when(F.col("action").isin(*values), F.struct("at", "action", value.alias("value"))))


def feedback_rows(events: DataFrame) -> DataFrame:
    """events: a stream of (title, author, format, action, at). Blank titles or authors and unknown actions are refused."""
    keyed = events.withColumns({"_t": X.lower_trim(F.col("title")), "_a": X.lower_trim(F.col("author")), "_f": F.coalesce("format", F.lit("")), "at": F.coalesce(F.unix_micros("at"), F.lit(NO_TIME))})
    good = keyed.filter("_t <> '' AND _a <> ''").filter(F.col("action").isin(*ACTIONS)).select("_t", "_a", "_f", "title", "author", "action", "at")
    latest = good.groupBy("_t", "_a", "_f").agg(F.max(F.struct("at", "action", "title", "author")).alias("last"), *(_setter(f).alias(f"_{f}") for f in FLAGS))
    return latest.select("last.title", "last.author", F.col("_f").alias("format"), *(F.col(f"_{f}.value").alias(f) for f in FLAGS), F.col("last.at").alias("feedback_at"))


def stream_feedback(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Events that arrive as Parquet under folder; each batch's rows are written to out/batch=N, again if it runs again."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    # Each partition has a state store of its own, so there are no more of them than tasks that run at once need.
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(stores))
    events = own.readStream.schema("title string, author string, format string, action string, at timestamp").parquet(folder)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return feedback_rows(events).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each key of what stream_feedback wrote, as rows of recommendations: flags that nothing set are unset,
    but non_english, already_read and duplicate false."""
    rows = spark.read.schema(f"{ROWS}, batch int").parquet(out)
    keys = [X.lower_trim(F.col("title")), X.lower_trim(F.col("author")), F.col("format")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    newest = rows.withColumn("_n", first).filter("_n = 1")
    flags = [F.col(f) if f.startswith("thumbs") else F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS]
    when = F.when(F.col("feedback_at") != NO_TIME, F.timestamp_micros("feedback_at")).alias("feedback_date")
    return newest.select("title", "author", F.nullif("format", F.lit("")).alias("format"), *flags, when)
