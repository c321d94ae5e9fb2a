"""Author catalogs: fetch (Q2, Q3), language cleanup (Q4), duplicate titles (Q5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, assign_ids
from ..store import settle, settled
from .authors import split_groups
from .ingest import set_metadata
from .matching import history_matches, with_matches


def due_authors(state: LibraryState, now: Column, force: bool = False, recheck_days: int = 7) -> DataFrame:
    """Authors with days since the last check (999: never) and whether they are fetched: not within the recheck
    window if they have a catalog."""
    n = state.catalog.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("catalog_books"))
    days = F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_catalog_check")) / 86400), F.lit(999))
    rows = state.authors.join(n, "id", "left").select("id", "name", F.coalesce("catalog_books", F.lit(0)).alias("catalog_books"), days.cast("long").alias("days_since"))
    return rows.withColumn("due", F.lit(force) | ~((F.col("days_since") < recheck_days) & (F.col("catalog_books") >= 1)))


def pick_works(works: DataFrame, editions: DataFrame, now: Column, state: LibraryState, recent_years: int | None = None, first_editions: int = 10) -> DataFrame:
    """The works that enter a catalog (X14): unknown key, a title, English by the first editions, recent enough if only
    recent ones are wanted (a year that isn't known is; authors without a catalog take all).

    works: author_id, key, title, languages, isbn, publication_date, series_name, series_position (read_works).
    editions: key, pos, title, languages, isbn, publication_date (read_editions)."""
    known = state.catalog.select("author_id", F.col("open_library_key").alias("key")).filter("key IS NOT NULL").distinct()
    fresh = works.filter("title <> ''").join(known, ["author_id", "key"], "left_anti")
    none = F.lit(None).cast("array<string>")
    some = editions.filter(F.col("pos") < first_editions).withColumn("english", C.languages_english(F.col("languages"), none, F.col("title")))
    per = some.groupBy("key").agg(
        F.count("*").alias("n"), F.min_by(F.struct(F.col("isbn").alias("isbn"), F.col("publication_date").alias("date")), F.when(F.col("english"), F.col("pos"))).alias("e")
    )
    rows = fresh.join(per, "key", "left")
    own = C.languages_english(none, F.col("languages"), F.col("title"))
    rows = rows.filter(F.when(F.coalesce("n", F.lit(0)) > 0, F.col("e").isNotNull() | own).otherwise(own))
    rows = rows.withColumns({"publication_date": F.coalesce("e.date", "publication_date"), "isbn": F.coalesce("e.isbn", "isbn")}).drop("e", "n")
    if recent_years is not None:
        with_catalog = state.catalog.select("author_id").distinct().withColumn("_has", F.lit(True))
        year = X.publication_year(F.col("publication_date"))
        rows = rows.join(with_catalog, "author_id", "left").filter(F.col("_has").isNull() | year.isNull() | (year >= F.year(now) - recent_years)).drop("_has")
    return rows


def fetch_catalog(state: LibraryState, works: DataFrame, editions: DataFrame, now: Column, recent_years: int | None = None) -> tuple[DataFrame, LibraryState]:
    """Q2 for any number of authors: picked works update the author's row with that title or isbn, skip what another
    author's catalog has by title or isbn, and are added otherwise; then new and updated rows (all rows of an author
    without any) are matched to the history and the author's check is stamped. plan: author_id, key, title, action."""
    works = settled(works.select("author_id", "key", "title", "languages", "isbn", "publication_date", "series_name", "series_position"))
    picked = pick_works(works, editions, now, state, recent_years).withColumn("_t", X.lower_trim(F.col("title")))
    keyed = state.catalog.select("id", "author_id", "isbn", "title").repartition("id")  # titles are stripped in all tasks
    cat = settled(keyed.select("id", "author_id", "isbn", X.lower_trim(F.col("title")).alias("_t")))
    by_title = cat.groupBy("author_id", "_t").agg(F.min("id").alias("_m1"))
    by_isbn = cat.filter("isbn <> ''").groupBy("author_id", "isbn").agg(F.min("id").alias("_m2"))
    own = settled(picked.join(by_title, ["author_id", "_t"], "left").join(by_isbn, ["author_id", "isbn"], "left").withColumn("id", F.coalesce("_m1", "_m2")))
    updates = settled(own.filter("id IS NOT NULL").withColumn("__rn", F.row_number().over(Window.partitionBy("id").orderBy("key"))).filter("__rn = 1").drop("__rn"))
    other_t = cat.select("_t").distinct()
    other_i = cat.filter("isbn <> ''").select("isbn").distinct()
    added = own.filter("id IS NULL").join(other_t, "_t", "left_anti").join(other_i, "isbn", "left_anti")
    added = settled(assign_ids(added.drop("id"), cat, F.col("author_id"), F.col("key")))
    new = added.select(
        "id", "author_id", "title", "isbn", "publication_date", "series_name", "series_position", F.lit("unknown").alias("format_available"), F.col("key").alias("open_library_key"), now.alias("fetched_at"), F.lit(False).alias("is_read"),
        F.col("author_id").isNotNull().alias("_scope"),
    )
    asked = works.select("author_id").distinct()
    idle = settled(asked.join(updates.select("author_id").unionByName(added.select("author_id")), "author_id", "left_anti").withColumn("_idle", F.lit(True)))
    u = updates.select("id", F.lit(True).alias("_updated"), F.col("key").alias("u_key"), F.col("isbn").alias("u_isbn"), F.col("publication_date").alias("u_date"), F.col("series_name").alias("u_series"), F.col("series_position").alias("u_pos"))
    kept = state.catalog.join(u, "id", "left").join(idle, "author_id", "left").withColumns({
        "open_library_key": F.coalesce("u_key", "open_library_key"), "isbn": F.coalesce("u_isbn", "isbn"), "publication_date": F.coalesce("u_date", "publication_date"),
        "series_name": F.coalesce("u_series", "series_name"), "series_position": F.coalesce("u_pos", "series_position"), "fetched_at": F.when(F.col("u_key").isNotNull(), now).otherwise(F.col("fetched_at")),
        "_scope": F.coalesce("_updated", "_idle", F.lit(False)),
    }).select(*state.catalog.columns, "_scope")
    catalog = kept.unionByName(new, allowMissingColumns=True)
    catalog = with_matches(catalog, history_matches(catalog.filter("_scope"), state.authors, state.books))
    authors = state.authors.join(asked.select(F.col("author_id").alias("id"), F.lit(True).alias("_hit")), "id", "left").withColumn("last_catalog_check", F.when(F.col("_hit"), now).otherwise(F.col("last_catalog_check")))
    plan = updates.select("author_id", "key", "title", F.lit("update").alias("action")).unionByName(added.select("author_id", "key", "title", F.lit("insert").alias("action")))
    return plan, state.with_(catalog=catalog, authors=authors)


def fetch_all(
    state: LibraryState, works: DataFrame, editions: DataFrame, now: Column, force: bool = False, recent_years: int | None = None, auto_cleanup: bool = False, names: DataFrame | None = None
) -> tuple[DataFrame, LibraryState]:
    """Q3: author groups are split, the authors that are due get their works, then the rows fetched are cleaned: with
    recent works only, titles first and then languages within the fetched rows; otherwise languages, then titles, over
    the whole catalog. plan: that of the fetch."""
    state = split_first(state, names)
    due = due_authors(state, now, force).filter("due").select(F.col("id").alias("author_id"))
    plan, new = fetch_catalog(state, works.join(due, "author_id", "left_semi"), editions, now, recent_years)
    metadata = set_metadata(new.metadata, "last_catalog_check", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), now)
    new = settle(new.with_(metadata=metadata))
    if auto_cleanup and recent_years is not None:
        fetched = new.catalog.filter(F.col("fetched_at") == now).select("id")
        new = settle(remove_duplicate_titles(new, ids=fetched)[1])
        new = cleanup_non_english(new, ids=fetched)[1]
    elif auto_cleanup:
        new = remove_duplicate_titles(settle(cleanup_non_english(new)[1]))[1]
    return plan, new


def split_first(state: LibraryState, names: DataFrame | None = None) -> LibraryState:
    """The library with its author groups taken apart, as a fetch begins."""
    return settle(split_groups(state, names)[1])


def with_author_keys(state: LibraryState, keys: DataFrame) -> LibraryState:
    """keys: author_id, author_key, as found for authors without an outside id."""
    found = keys.select(F.col("author_id").alias("id"), F.col("author_key").alias("_key")).dropDuplicates(["id"])
    return state.with_(authors=state.authors.join(found, "id", "left").withColumn("open_library_id", F.coalesce(F.nullif("open_library_id", F.lit("")), "_key")))


def sliced(catalog: DataFrame, limit: int | None = None, offset: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """O1: the rows with the given ids, else a slice by id."""
    if ids is not None:
        return catalog.join(ids.select("id").distinct(), "id", "left_semi")
    if limit is None and not offset:
        return catalog
    rows = catalog.orderBy("id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def cleanup_non_english(state: LibraryState, limit: int | None = None, offset: int = 0, ids: DataFrame | None = None, editions: DataFrame | None = None, volumes: DataFrame | None = None) -> tuple[DataFrame, LibraryState]:
    """Q4: rows whose title (C3), or failing that whose volume (by isbn; not when scoped by ids) or first five editions
    (C6) speak against English. editions: key, english per row; volumes: isbn, english. plan: id, title, cause."""
    rows = sliced(state.catalog, limit, offset, ids).withColumn("_by_title", C.cleanup_non_english(F.col("title")))
    cause = F.when(F.col("_by_title"), "title")
    if volumes is not None and ids is None:
        v = volumes.groupBy("isbn").agg(F.first("english").alias("_volume"))
        rows = rows.join(v, "isbn", "left")
        cause = cause.when(~F.coalesce("_volume", F.lit(True)), "volume")
    if editions is not None:
        e = editions.filter("pos < 5").groupBy(F.col("key").alias("open_library_key")).agg(F.bool_or("english").alias("_editions"))
        rows = rows.join(e, "open_library_key", "left")
        cause = cause.when(~F.coalesce("_editions", F.lit(True)), "editions")
    plan = rows.withColumn("cause", cause).filter("cause IS NOT NULL").select("id", "title", "cause")
    return plan, state.with_(catalog=state.catalog.join(plan.select("id"), "id", "left_anti"))


def duplicate_titles(state: LibraryState, author_limit: int | None = None, author_offset: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """Q5's plan: what repeats a title: table, id, keep_id. Catalog rows keep the fullest (C12), then the oldest of an
    author's title (F3); loans the oldest of author and title."""
    catalog, books = state.catalog, state.books
    scoped = ids is not None or author_limit is not None or author_offset
    if ids is not None:
        catalog = sliced(catalog, ids=ids)
    elif scoped:
        chunk = catalog.select("author_id").distinct().orderBy("author_id").offset(author_offset)
        catalog = catalog.join(chunk if author_limit is None else chunk.limit(author_limit), "author_id", "left_semi")
    keyed = catalog.select("id", "author_id", X.title_for_dedup(F.col("title")).alias("_k"), C.completeness().alias("_s")).filter("_k <> ''")
    w = Window.partitionBy("author_id", "_k")
    best = keyed.withColumn("keep_id", F.first("id").over(w.orderBy(F.desc("_s"), "id"))).filter("id <> keep_id").select(F.lit("catalog").alias("table"), "id", "keep_id")
    loans = books.select("id", X.lower_trim(F.col("author")).alias("_a"), X.lower_trim(F.col("title")).alias("_t")).filter("_a <> '' AND _t <> ''")
    if scoped:
        names = state.authors.join(catalog.select(F.col("author_id").alias("id")).distinct(), "id", "left_semi").select(X.lower_trim(F.col("name")).alias("_a"))
        loans = loans.join(names, "_a", "left_semi")
    again = loans.withColumn("keep_id", F.min("id").over(Window.partitionBy("_a", "_t"))).filter("id <> keep_id").select(F.lit("books").alias("table"), "id", "keep_id")
    return best.unionByName(again)


def remove_duplicate_titles(state: LibraryState, author_limit: int | None = None, author_offset: int = 0, ids: DataFrame | None = None) -> tuple[DataFrame, LibraryState]:
    plan = duplicate_titles(state, author_limit, author_offset, ids)

    def without(df: DataFrame, name: str) -> DataFrame:
        return df.join(plan.filter(F.col("table") == name).select("id"), "id", "left_anti")

    return plan, state.with_(catalog=without(state.catalog, "catalog"), books=without(state.books, "books"))
