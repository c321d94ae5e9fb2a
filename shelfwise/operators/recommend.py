"""Recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, assign_ids, on
from ..store import settled
from .matching import books_read, eligible, resolve_authors

#: Score and reason of each format.
OFFERS = {"audiobook": (0.95, "You've listened to other books by "), "ebook": (0.90, "You've read other books by ")}


def candidates(state: LibraryState, fmt: str, category: str | None = None) -> DataFrame:
    """Unread English books of authors in the history whose title isn't in it. audiobook: the history of that format;
    ebook: all. A history spelling that resolves to an author gives its books once each."""
    history = state.books.filter(F.col("format") == "audiobook") if fmt == "audiobook" else state.books
    chosen = resolve_authors(history.select("author").distinct(), state.authors)
    titles = history.select(F.lower("title").alias("_lt")).filter("_lt IS NOT NULL").distinct()
    fresh = eligible(state.catalog).withColumn("_lt", F.lower("title")).join(titles, "_lt", "left_anti")
    score, reason = OFFERS[fmt]
    rows = fresh.join(chosen, "author_id").join(books_read(state), "author_id").withColumn("_categories", X.category_list(F.col("categories")))
    if category is not None:
        rows = rows.filter(F.exists("_categories", lambda c: F.lower(c) == category.lower()))
    return rows.select(
        F.col("id").alias("catalog_id"), "author_id", "title", F.col("display").alias("author"), "isbn", F.lit("same_author").alias("recommendation_type"), F.lit(score).alias("similarity_score"),
        F.concat(F.lit(reason), F.col("display")).alias("reason"), F.col("_categories").alias("categories"), F.lit(fmt).alias("format"), X.preview(F.col("description")).alias("description"),
        "books_by_author_count", F.nullif("series_name", F.lit("")).alias("series_name"), F.nullif("series_position", F.lit(0)).alias("series_position"),
    )


def by_category(recs: DataFrame) -> DataFrame:
    """A10: a copy of each row for each of its categories."""
    return recs.withColumn("category", F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("Uncategorized")))))


def _kinds(recs: DataFrame) -> DataFrame:
    return recs.select("*", F.when(C.is_fiction(F.col("categories")), "Fiction").otherwise("Non-Fiction").alias("kind"), F.coalesce(F.get("categories", F.lit(0)), F.lit("Uncategorized")).alias("primary_category"))


def first_of_categories(recs: DataFrame, most: int = 10) -> DataFrame:
    """A11 for lists of any size: of each kind and category the first rows with their rank. No category is gathered: each task
    hands on its own first rows."""
    order = Window.partitionBy("kind", "primary_category").orderBy(F.desc("books_by_author_count"), "author", "title", "catalog_id")
    return _kinds(recs).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def categorized(recs: DataFrame) -> DataFrame:
    """Kind, category, size, and its rows by books read of the author, as one list a category (first_of_categories
    where that is too long)."""
    tagged = _kinds(recs)
    order = F.struct((-F.col("books_by_author_count")).alias("k"), "author", "title", "catalog_id")
    return tagged.groupBy("kind", "primary_category").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(order)), lambda s: F.struct(s["title"].alias("title"), s["author"].alias("author"), (-s["k"]).alias("books_by_author_count"))).alias("items")).orderBy("kind", F.desc("n"), "primary_category")


def _key(title: str = "title", author: str = "author") -> list[Column]:
    return [X.lower_trim(F.col(title)).alias("_t"), X.lower_trim(F.col(author)).alias("_a")]


def web_recommendations(state: LibraryState, fmt: str, distinct: bool = False) -> DataFrame:
    """Q15: what is shown: no row with feedback against it (J5), none of hidden authors (J6); thumbs_up marks (J8);
    ebooks come once per category unless distinct."""
    base = candidates(state, fmt)
    if fmt == "ebook" and not distinct:
        base = by_category(base)
    same = state.recommendations.filter(F.col("format") == fmt)
    bad = same.filter(on("thumbs_down") | on("non_english") | on("already_read") | on("duplicate")).select(*_key()).distinct()
    liked = same.filter(on("thumbs_up")).select(*_key()).distinct().withColumn("thumbs_up", F.lit(True))
    hidden = state.authors.filter(on("hidden")).select(X.lower_trim(F.col("name")).alias("_a")).distinct()
    keyed = base.select("*", *_key())
    shown = keyed.join(bad, ["_t", "_a"], "left_anti").join(hidden, "_a", "left_anti").join(liked, ["_t", "_a"], "left")
    return shown.withColumn("thumbs_up", F.coalesce("thumbs_up", F.lit(False))).drop("_t", "_a")


def hidden_section(state: LibraryState, fmt: str) -> DataFrame:
    """Per hidden author with any, the unfiltered recommendations."""
    base = candidates(state, fmt)
    hidden = state.authors.filter(on("hidden")).select(X.lower_trim(F.col("name")).alias("_a")).distinct()
    rows = base.withColumn("_a", X.lower_trim(F.col("author"))).join(hidden, "_a", "left_semi")
    return rows.groupBy("author").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("title")).alias("titles"))


def books_to_read(state: LibraryState) -> DataFrame:
    """Q16: liked, neither read nor duplicate, not in the history; author, then best score first."""
    wanted = state.recommendations.filter(on("thumbs_up") & ~on("already_read") & ~on("duplicate"))
    history = state.books.select(F.lower("title").alias("_t"), F.lower("author").alias("_a")).distinct()
    rows = wanted.withColumns({"_t": F.lower("title"), "_a": F.lower("author")}).join(history, ["_t", "_a"], "left_anti")
    score = F.coalesce("similarity_score", F.lit(0.0))
    return rows.select("author", "title", "format", score.alias("similarity_score"), X.or_empty(F.col("isbn")).alias("isbn"), X.or_empty(F.col("category")).alias("category"), X.or_empty(F.col("reason")).alias("reason"), "id").orderBy("author", F.desc("similarity_score"), "id")


def save(state: LibraryState, recs: DataFrame, now: Column) -> tuple[DataFrame, LibraryState]:
    """Upsert by title and author, whatever the format; plan: action (update, insert) of each. The saved recommendations are
    looked at several times, so they are settled: what they are made of is joined, and small tables are sent around, once."""
    one = recs.withColumn("__rn", F.row_number().over(Window.partitionBy("title", "author").orderBy(F.desc("similarity_score"), "catalog_id"))).filter("__rn = 1")
    new = settled(one.select(F.col("title").alias("n_title"), F.col("author").alias("n_author"), F.col("isbn").alias("n_isbn"), F.col("format").alias("n_format"), F.array_join("categories", ", ").alias("n_category"), F.col("recommendation_type").alias("n_type"), F.col("similarity_score").alias("n_score"), F.col("reason").alias("n_reason")))
    old = settled(state.recommendations)
    first = old.groupBy("title", "author").agg(F.min("id").alias("id"))
    hits = first.join(new, (first["title"] == new["n_title"]) & (first["author"] == new["n_author"])).select("id", "n_score", "n_reason", "n_category")
    updated = old.join(hits, "id", "left").withColumns({"similarity_score": F.coalesce("n_score", "similarity_score"), "reason": F.coalesce("n_reason", "reason"), "category": F.coalesce("n_category", "category")}).select(*old.columns)
    fresh = new.join(old.select(F.col("title").alias("n_title"), F.col("author").alias("n_author")).distinct(), ["n_title", "n_author"], "left_anti")
    rows = assign_ids(
        fresh.select(F.col("n_title").alias("title"), F.col("n_author").alias("author"), F.col("n_isbn").alias("isbn"), F.col("n_format").alias("format"), F.col("n_category").alias("category"), F.col("n_type").alias("recommendation_type"), F.col("n_score").alias("similarity_score"), F.col("n_reason").alias("reason"), now.alias("created_at")),
        old, F.col("author"), F.col("title"),
    )
    plan = hits.select("id", F.lit("update").alias("action")).unionByName(rows.select("id", F.lit("insert").alias("action")))
    return plan, state.with_(recommendations=updated.unionByName(rows, allowMissingColumns=True))
