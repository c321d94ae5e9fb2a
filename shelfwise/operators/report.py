"""Status, lists, inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LibraryState
from .series import series_summary


def status(state: LibraryState, now: Column) -> DataFrame:
    """Q17: one row of counts by table and format, series by status, and when things last happened."""
    b = state.books.agg(F.count("*").alias("books"), F.count_if(F.col("format") == "audiobook").alias("audiobooks"), F.count_if(F.col("format") == "ebook").alias("ebooks"))
    when = {k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"{k}_value") for k in ("last_libby_import", "last_catalog_check")}
    m = state.metadata.agg(*when.values()).select(*(X.since(F.col(f"{k}_value"), now).alias(k) for k in when))
    one = b.crossJoin(state.authors.agg(F.count("*").alias("authors"))).crossJoin(state.catalog.agg(F.count("*").alias("catalog_books"))).crossJoin(state.recommendations.agg(F.count("*").alias("recommendations")))
    return one.crossJoin(series_summary(state)).crossJoin(m)


def list_authors(state: LibraryState, search: str | None = None) -> DataFrame:
    """Q18: authors by name with their catalog rows and loans; search: part of the name in any case."""
    rows = state.authors if not search else state.authors.filter(F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.lower("normalized_name"), F.lit(search.lower())))
    c = state.catalog.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("catalog_books"))
    b = state.books.groupBy(F.col("author").alias("normalized_name")).agg(F.count("*").alias("loans"))
    return rows.join(c, "id", "left").join(b, "normalized_name", "left").select("id", "name", "normalized_name", F.coalesce("catalog_books", F.lit(0)).alias("catalog_books"), F.coalesce("loans", F.lit(0)).alias("loans"), "open_library_id").orderBy("name", "id")


def top_authors(state: LibraryState, at_least: int = 0, limit: int | None = 10) -> DataFrame:
    """A3, A4: authors by number of catalog rows."""
    out = state.catalog.groupBy("author_id").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).join(state.authors.select(F.col("id").alias("author_id"), "name"), "author_id").orderBy(F.desc("n"), "author_id")
    return out if limit is None else out.limit(limit)


def inspect(state: LibraryState) -> DataFrame:
    """Q33: rows of each table and authors with any catalog row."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n") for t, df in state.tables().items()]
    counts.append(state.catalog.agg(F.count_distinct("author_id").alias("n")).select(F.lit("authors_with_catalog").alias("what"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def histogram(rows: DataFrame, tags: str, limit: int | None = None) -> DataFrame:
    """How often each tag of an array column occurs."""
    out = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
    return out if limit is None else out.limit(limit)


def subtotals(rows: DataFrame, *keys: str) -> DataFrame:
    """A12, A15, A18 with subtotals: rows by all keys, by all but the last, and so on to the total, counted in one pass.
    level: how many keys, from the last, are summed up."""
    level = F.length(F.replace(F.bin(F.grouping_id(*keys)), F.lit("0"), F.lit("")))
    return rows.rollup(*keys).agg(F.count("*").alias("n"), level.alias("level"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"))
    return g.select(key, "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def author_chunk(state: LibraryState, limit: int | None, offset: int = 0) -> DataFrame:
    """A5: ids of a slice of the catalog's authors, ascending."""
    ids = state.catalog.select("author_id").distinct().orderBy("author_id").offset(offset)
    return ids.limit(limit) if limit is not None else ids
