"""Joins of catalogs with the loan history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, on
from ..store import settled
from .parts import either_holding


def match_to_history(catalog: DataFrame, authors: DataFrame, books: DataFrame, unmatched_only: bool = False) -> DataFrame:
    """Catalog with is_read and matched_book_id set anew: by isbn (last loan), by title (last loan), by one title
    holding the other (first loan), each within the author's own loans. Rows without a match are reset."""
    return with_matches(catalog, history_matches(catalog.filter(~on("is_read")) if unmatched_only else catalog, authors, books))


def history_matches(scope: DataFrame, authors: DataFrame, books: DataFrame) -> DataFrame:
    """id, _match: the loan of each row of scope (id, author_id, isbn, title) whose author is known, or null.

    The two equi joins run on aggregates; what they leave meets the author's loans under its rarest part (parts.py), in either
    direction. There each different title of an author meets each different title of its loans once, and the first loan of
    that title stands for all: copies on both sides would make pairs that grow with the square of the tables."""
    rows = scope.select("id", "author_id", "isbn", X.lower_trim(F.col("title")).alias("_t")).join(authors.select(F.col("id").alias("author_id"), F.col("normalized_name").alias("_author")), "author_id")
    loans = settled(books.select(F.col("id").alias("_book"), F.col("author").alias("_author"), F.col("isbn").alias("_isbn"), X.lower_trim(F.col("title")).alias("_bt"), F.lower("title").alias("_raw")))
    by_isbn = loans.filter("_isbn <> ''").groupBy("_author", F.col("_isbn").alias("isbn")).agg(F.max("_book").alias("_m1"))
    by_title = loans.filter("_bt IS NOT NULL").groupBy("_author", F.col("_bt").alias("_t")).agg(F.max("_book").alias("_m2"))
    equi = settled(rows.join(by_isbn, ["_author", "isbn"], "left").join(by_title, ["_author", "_t"], "left").select("id", "_author", "_t", F.coalesce("_m1", "_m2").alias("_equi")))
    rest = settled(equi.filter("_equi IS NULL AND _t IS NOT NULL").select("_author", "_t").distinct())
    held = settled(loans.filter("_raw IS NOT NULL").groupBy("_author", "_raw").agg(F.min("_book").alias("_book")))
    by_part = either_holding(rest, held, ["_author"], "_t", "_raw").groupBy("_author", "_t").agg(F.min("_book").alias("_m3"))
    return equi.join(by_part, ["_author", "_t"], "left").select("id", F.coalesce("_equi", "_m3").alias("_match"))


def with_matches(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """catalog with is_read and matched_book_id of the rows that are in found (history_matches)."""
    fresh = catalog.join(found.withColumn("_in", F.lit(True)), "id", "left")
    return fresh.select(*(
        F.when(F.col("_in"), F.col("_match").isNotNull()).otherwise(F.col(c)).alias(c) if c == "is_read"
        else F.when(F.col("_in"), F.col("_match")).otherwise(F.col(c)).alias(c) if c == "matched_book_id" else F.col(c)
        for c in catalog.columns
    ))


def resolve_authors(names: DataFrame, authors: DataFrame) -> DataFrame:
    """Names (column author) with author_id, display and normalized_name of the author: by exact name, else by
    normalised name, the smallest id; names without an author drop out."""
    by_name = authors.groupBy(F.col("name").alias("author")).agg(F.min("id").alias("_by_name"))
    by_norm = authors.groupBy(F.col("normalized_name").alias("author")).agg(F.min("id").alias("_by_norm"))
    found = names.join(by_name, "author", "left").join(by_norm, "author", "left").withColumn("author_id", F.coalesce("_by_name", "_by_norm")).drop("_by_name", "_by_norm")
    return found.join(authors.select(F.col("id").alias("author_id"), F.col("name").alias("display"), "normalized_name"), "author_id")


def books_read(state: LibraryState) -> DataFrame:
    """author_id, books_by_author_count: loans under the normalised name and recommendations marked read under the
    display name."""
    loans = state.books.groupBy(F.col("author").alias("normalized_name")).agg(F.count("*").alias("_loans"))
    marked = state.recommendations.filter(on("already_read")).groupBy(F.lower("author").alias("_name")).agg(F.count("*").alias("_marked"))
    rows = state.authors.select(F.col("id").alias("author_id"), "normalized_name", F.lower("name").alias("_name"))
    return rows.join(loans, "normalized_name", "left").join(marked, "_name", "left").select("author_id", (F.coalesce("_loans", F.lit(0)) + F.coalesce("_marked", F.lit(0))).alias("books_by_author_count"))


def eligible(catalog: DataFrame) -> DataFrame:
    """Unread catalog rows with an English title: the ground of recommendations and of curation."""
    return catalog.filter(~on("is_read") & C.is_english(F.col("title")))
