"""What the training-data operators share: shared storage, Arrow-batch columns, seeded splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than space and the control characters 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows of one Arrow batch; texts can be long, so a batch is kept small.
BATCH_ROWS = 1000
#: Rows of one file of a narrow table.
FILE_ROWS = 250_000


def session_of(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run
    on this machine (tests)."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(spark.sparkContext, "_shelfwise_shared", None):
        spark.sparkContext._shelfwise_shared = "file://" + tempfile.mkdtemp(prefix="shelfwise-")
    return spark.sparkContext._shelfwise_shared


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before.

    Each one can be dropped as soon as nothing later reads it; what is left goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/shelfwise-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
        """most_rows: a bound on the rows of a narrow table where one is known; it then gets as few files as that needs,
        each of which costs the file system several calls."""
        if most_rows is not None:
            df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.settle()
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def settle(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished plans."""
        self.spark._jvm.System.gc()

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the JVM may be gone by now
            pass


def add_columns(df: DataFrame, fn: Callable, inputs: list[str], fields: list[tuple[str, T.DataType]], keep: list[str] | None = None) -> DataFrame:
    """df with columns that fn makes from Arrow batches: fn(*arrays of the inputs) gives one array for each field. Of df's
    own columns those in keep (all, if None) come back, so texts that nobody needs further don't."""
    session_of(df)
    stay = [f for f in df.schema.fields if keep is None or f.name in keep]
    schema = T.StructType(stay + [T.StructField(n, t) for n, t in fields])
    names = [*(f.name for f in stay), *(n for n, _ in fields)]

    def run(batches):
        for b in batches:
            made = fn(*(b.column(b.schema.get_field_index(c)) for c in inputs))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in stay), *made], names=names)

    return df.mapInArrow(run, schema)


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def plain_names(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but doc_id and text under names that clash with nothing, and what gives a result with these
    columns their names back."""
    own = {c: c if c in ("doc_id", "text") else f"c{k}_" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), lambda df: df.select(*(F.col(n).alias(c) for c, n in own.items()))


def bytes_of(column: pa.Array) -> list:
    """The UTF-8 bytes of each text; None stays None."""
    return column.cast(pa.binary()).to_pylist()


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
