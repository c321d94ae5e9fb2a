"""The six tables, and the state that holds them.

Every change is a function from a state to a plan (what would change) and a new state; nothing is updated in place.
A dry run is the plan alone."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _struct(fields: str) -> T.StructType:
    """`name type, name type, ...` (no session is needed for that)."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


TABLES: dict[str, T.StructType] = {
    "books": _struct(
        "id long, title string, author string, publisher string, isbn string, format string, cover_url string, library string, "
        "borrowed_date timestamp, loan_duration string, created_at timestamp, already_read boolean"
    ),
    "authors": _struct("id long, name string, normalized_name string, open_library_id string, last_catalog_check timestamp, hidden boolean, hidden_at timestamp, created_at timestamp"),
    "catalog": _struct(
        "id long, author_id long, title string, isbn string, publication_date string, series_name string, series_position int, format_available string, "
        "open_library_key string, google_books_id string, description string, categories string, fetched_at timestamp, is_read boolean, matched_book_id long"
    ),
    "series": _struct("id long, name string, author_id long, total_books int, books_read int, status string, created_at timestamp"),
    "recommendations": _struct(
        "id long, book_id long, catalog_book_id long, title string, author string, isbn string, format string, category string, recommendation_type string, "
        "similarity_score double, reason string, created_at timestamp, thumbs_up boolean, thumbs_down boolean, non_english boolean, already_read boolean, duplicate boolean, feedback_date timestamp"
    ),
    "metadata": _struct("id long, key string, value string, updated_at timestamp"),
}
#: What a missing column holds after a migration.
DEFAULTS = {"hidden": False, "non_english": False, "already_read": False, "duplicate": False, "is_read": False, "books_read": 0}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df in the table's columns and types; a column that an older schema lacks gets its default."""
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(DEFAULTS.get(f.name)).cast(f.dataType)).alias(f.name) for f in TABLES[table]))


@dataclass(frozen=True)
class LibraryState:
    books: DataFrame
    authors: DataFrame
    catalog: DataFrame
    series: DataFrame
    recommendations: DataFrame
    metadata: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> LibraryState:
        """Tables that aren't given are empty; those given are conformed."""
        return cls(**{t: conform(tables[t], t) if t in tables else spark.createDataFrame([], schema) for t, schema in TABLES.items()})

    @property
    def spark(self) -> SparkSession:
        return self.books.sparkSession

    def with_(self, **tables: DataFrame) -> LibraryState:
        return replace(self, **{t: conform(df, t) for t, df in tables.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}


def on(flag: str) -> F.Column:
    """A nullable flag as true or false."""
    return F.coalesce(F.col(flag), F.lit(False))


def with_numbers(rows: DataFrame, *order: F.Column, name: str = "number", kind: str = "int") -> DataFrame:
    """rows with consecutive numbers from 1 in the given order: rows are sorted by ranges, numbered within their range, and
    what meets in one task is one count per range. The order has to tell rows apart, or ties take any place."""
    from pyspark.sql import Window

    from .store import settled

    rows = settled(rows)  # ranges are found by a pass of their own, which would compute the rows once more
    dealt = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # as many rows as partitions
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = dealt.withColumn("__local", local).join(F.broadcast(bases), "__part")
    return numbered.withColumn(name, (F.col("__base") + F.col("__local")).cast(kind)).drop("__part", "__local", "__base")


def assign_ids(rows: DataFrame, taken: DataFrame, bucket: F.Column, *order: F.Column) -> DataFrame:
    """rows with consecutive ids after the largest in `taken`, in the order of bucket, then order; only counts of ranges
    meet in one task."""
    start = taken.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__start"))
    tagged = rows.drop("id").withColumn("__bucket", bucket)
    numbered = with_numbers(tagged, F.col("__bucket"), *order, name="__number", kind="long").crossJoin(F.broadcast(start))  # one row
    return numbered.withColumn("id", (F.col("__start") + F.col("__number")).cast("long")).drop("__bucket", "__number", "__start")
