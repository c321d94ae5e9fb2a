"""Ingest of a loan export (Q1): books, authors, read marks, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, assign_ids, on
from ..store import settled


def prepared(loans: DataFrame) -> DataFrame:
    """A loan as a book row."""
    return loans.select(
        "_bucket", "_pos", "title", F.col("author").alias("author_raw"), X.author_name(F.col("author")).alias("author"), "publisher", "isbn",
        C.loan_format(F.col("publisher")).alias("format"), F.col("cover").alias("cover_url"), "library",
        X.loan_date(F.col("timestamp")).alias("borrowed_date"), F.col("details").alias("loan_duration"),
    )


def first_of(rows: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def _leaders(rows: DataFrame) -> DataFrame:
    """Rows with _lead, the position of the row they repeat (or their own): first by isbn, then, among those that
    lead, by title and author. A chain that only holds together by both keys in turn is not followed further."""
    by_isbn = F.min("_pos").over(Window.partitionBy(F.coalesce("isbn", F.concat(F.lit("\x00"), F.col("_pos").cast("string")))))
    one = rows.withColumn("_a", by_isbn)
    heads = one.filter("_a = _pos").withColumn("_lead", F.min("_pos").over(Window.partitionBy("title", "author"))).select(F.col("_pos").alias("_a"), "_lead")
    return one.join(heads, "_a").drop("_a")


def ingest(state: LibraryState, loans: DataFrame, now: Column, update: bool = False) -> tuple[DataFrame, LibraryState]:
    """D1-D4. plan: one row of counters: books_added, books_updated, authors_added, marked_as_read, removed_from_to_read."""
    rows = _leaders(prepared(loans))
    old_isbn = state.books.filter("isbn IS NOT NULL AND isbn <> ''").groupBy("isbn").agg(F.min("id").alias("_by_isbn"))
    old_key = state.books.groupBy("title", "author").agg(F.min("id").alias("_by_key"))
    known = rows.join(old_isbn, "isbn", "left").join(old_key, ["title", "author"], "left").withColumn("_old", F.coalesce("_by_isbn", "_by_key"))
    # What a row of this file repeats may itself be known; all rows under one lead share its book.
    target = settled(known.withColumn("_book", F.min("_old").over(Window.partitionBy("_lead"))))
    fresh = target.filter("_book IS NULL AND _pos = _lead")
    added = assign_ids(fresh, state.books, F.col("_bucket"), F.col("_pos")).withColumns({"created_at": now, "already_read": F.lit(False)})
    columns = state.books.columns
    books = state.books.unionByName(added.select(*columns))
    touched = target.filter(F.col("_book").isNotNull() | (F.col("_pos") != F.col("_lead")))
    if update:
        ids = added.select(F.col("_pos").alias("_lead"), F.col("id").alias("_new"))
        later = touched.join(ids, "_lead", "left").withColumn("id", F.coalesce("_book", "_new"))
        kept = ["isbn", "cover_url", "library", "borrowed_date", "loan_duration"]
        last = [F.max_by(c, "_pos").alias(f"n_{c}") for c in ("publisher", "format")] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"n_{c}") for c in kept]
        changes = later.groupBy("id").agg(*last, F.lit(True).alias("_hit"))
        joined = books.join(changes, "id", "left")
        hit = F.col("_hit").isNotNull()
        books = joined.select(*(
            F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in ("publisher", "format") else F.coalesce(f"n_{c}", c).alias(c) if c in kept else F.col(c) for c in columns
        ))
    # Skipped rows never reach the authors; updated ones do.
    seen = target if update else fresh
    newcomers = first_of(seen.join(state.authors.select(F.col("normalized_name").alias("author")).distinct(), "author", "left_anti"), ["author"], F.col("_pos"))
    authors_added = assign_ids(newcomers.select("_bucket", "_pos", F.col("author_raw").alias("name"), F.col("author").alias("normalized_name")), state.authors, F.col("_bucket"), F.col("_pos")).withColumns(
        {"open_library_id": F.lit(None).cast("string"), "last_catalog_check": F.lit(None).cast("timestamp"), "hidden": F.lit(False), "hidden_at": F.lit(None).cast("timestamp"), "created_at": now}
    )
    authors = state.authors.unionByName(authors_added.select(*state.authors.columns))
    marked = mark_read(state.recommendations, books)
    counters = (
        added.agg(F.count("*").alias("books_added"))
        .crossJoin((touched if update else touched.limit(0)).agg(F.count("*").alias("books_updated")))
        .crossJoin(authors_added.agg(F.count("*").alias("authors_added")))
        .crossJoin(marked.agg(F.count_if(F.col("_read") & ~on("already_read")).alias("marked_as_read"), F.count_if(F.col("_read") & on("thumbs_up")).alias("removed_from_to_read")))
    )
    recommendations = marked.withColumns({"already_read": F.when(F.col("_read"), True).otherwise(F.col("already_read")), "thumbs_up": F.when(F.col("_read") & on("thumbs_up"), False).otherwise(F.col("thumbs_up"))})
    metadata = set_metadata(state.metadata, "last_libby_import", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), now)
    return counters, state.with_(books=books, authors=authors, recommendations=recommendations, metadata=metadata)


def mark_read(recommendations: DataFrame, books: DataFrame) -> DataFrame:
    """Recommendations with _read: title (F2) and author are in the loan history."""
    history = books.filter("title <> '' AND author <> ''").select(X.title_for_matching(F.col("title")).alias("_t"), X.lower_trim(F.col("author")).alias("_a")).distinct().withColumn("_hit", F.lit(True))
    keyed = recommendations.withColumns({"_t": X.title_for_matching(F.col("title")), "_a": X.lower_trim(X.author_name(F.col("author")))})
    return keyed.join(history, ["_t", "_a"], "left").withColumn("_read", F.coalesce("_hit", F.lit(False))).drop("_t", "_a", "_hit")


def set_values(metadata: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """D4 for many: values (key, value), a row a key; known keys keep their id, new ones get ids in the order of the keys."""
    old = metadata.select(F.col("key"), F.col("id").alias("_id"))
    rows = settled(values.join(old, "key", "left").select("_id", "key", "value", now.alias("updated_at")))
    known = rows.filter("_id IS NOT NULL").select(F.col("_id").alias("id"), "key", "value", "updated_at")
    new = assign_ids(rows.filter("_id IS NULL").drop("_id").withColumn("id", F.lit(None).cast("long")), metadata, F.col("key"))
    rest = metadata.join(values.select("key"), "key", "left_anti")
    return rest.select(*metadata.columns).unionByName(known.unionByName(new.select("id", "key", "value", "updated_at")))


def set_metadata(metadata: DataFrame, key: str, value: Column, now: Column) -> DataFrame:
    """The key's value and time, replaced or added."""
    spark = metadata.sparkSession
    new = spark.range(1).select(F.lit(key).alias("key"), value.alias("value"), now.alias("updated_at"))
    old = metadata.filter(F.col("key") == key).select("key", "id")
    next_id = metadata.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("_next"))
    row = new.join(old, "key", "left").crossJoin(F.broadcast(next_id)).select(F.coalesce("id", "_next").alias("id"), "key", "value", "updated_at")
    return metadata.filter(F.col("key") != key).unionByName(row)
