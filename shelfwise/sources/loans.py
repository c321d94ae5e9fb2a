"""Loan exports: CSV files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

COLUMNS = ("title", "author", "isbn", "publisher", "timestamp", "cover", "library", "details")


def newest(spark: SparkSession, pattern: str) -> str:
    """The newest file a pattern matches, or folder, which is one export in parts; a path that matches nothing as a
    pattern is taken as it stands."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(where) or []
    if not len(found):
        raise FileNotFoundError(pattern)
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().toString())).getPath().toString()


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    """Fields by header name, stripped; missing columns are empty; empty becomes null but for title and author;
    rows lacking one of these are dropped. _bucket and _pos give the order in the files."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False, ignoreLeadingWhiteSpace=False)
    present = {c.strip().lower(): c for c in raw.columns}
    fields = [(X.blank_to_null(F.col(f"`{present[c]}`")) if c in present else F.lit(None).cast("string")).alias(c) for c in COLUMNS]
    return raw.select(*fields, F.monotonically_increasing_id().alias("_pos")).filter(F.col("title").isNotNull() & F.col("author").isNotNull()).withColumn("_bucket", F.shiftright("_pos", 33))
