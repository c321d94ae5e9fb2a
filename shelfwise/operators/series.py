"""Series (Q11, Q12, Q24, Q25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LibraryState, on, with_numbers

#: The order in which states are shown.
STATUS_ORDER = ("partial", "not_started", "complete")


def judged(state: LibraryState) -> DataFrame:
    """Catalog rows in a series with _read and _unread (neither: feedback speaks against the book)."""
    keys = [X.lower_trim(F.col("title")).alias("_t"), X.lower_trim(F.col("author")).alias("_a")]
    recs = state.recommendations
    read = recs.filter(on("already_read")).select(*keys).distinct().withColumn("_marked", F.lit(True))
    bad = recs.filter(on("thumbs_down") | on("duplicate") | on("non_english")).select(*keys).distinct().withColumn("_bad", F.lit(True))
    rows = state.catalog.filter("series_name <> ''").join(state.authors.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id")
    rows = rows.withColumns({"_t": X.lower_trim(F.col("title")), "_a": X.lower_trim(F.col("author"))})
    rows = rows.join(read, ["_t", "_a"], "left").join(bad, ["_t", "_a"], "left")
    return rows.withColumn("_read", on("is_read") | F.col("_marked").isNotNull()).withColumn("_unread", ~F.col("_read") & F.col("_bad").isNull())


def analyze_series(state: LibraryState) -> DataFrame:
    """Q11: per author and series: totals, share read, status, the books of both sides. Rows that feedback excludes
    count in the total. Ordered by author id, status, share, name."""
    spot = F.when(F.coalesce("series_position", F.lit(0)) == 0, 999).otherwise(F.col("series_position"))
    entry = F.struct(spot.alias("spot"), F.col("id"), "title", "isbn", F.col("series_position").alias("position"), "categories")
    grouped = judged(state).groupBy("author_id", "author", "series_name").agg(
        F.count("*").alias("total_books"), F.count_if("_read").alias("books_read"), F.count_if("_unread").alias("books_unread"),
        F.array_sort(F.collect_list(F.when(F.col("_unread"), entry))).alias("_unread_books"),
        F.array_sort(F.collect_list(F.when(F.col("_read"), F.struct("id", "title", "isbn", F.col("series_position").alias("position"))))).alias("_read_books"),
    )
    status = F.when(F.col("books_read") == 0, "not_started").when(F.col("books_unread") == 0, "complete").otherwise("partial")
    out = grouped.filter("books_read > 0 OR books_unread > 0").withColumn("status", status)
    rank = F.array_position(F.array(*(F.lit(s) for s in STATUS_ORDER)), F.col("status"))
    return out.select(
        "author_id", "author", "series_name", "total_books", "books_read", (F.col("books_read") / F.col("total_books") * 100).alias("completion_pct"), "status",
        F.transform("_unread_books", lambda b: F.struct(b["title"].alias("title"), b["isbn"].alias("isbn"), b["position"].alias("position"), b["categories"].alias("categories"))).alias("unread_books"),
        F.transform("_read_books", lambda b: F.struct(b["title"].alias("title"), b["isbn"].alias("isbn"), b["position"].alias("position"))).alias("read_books"),
    ).orderBy("author_id", rank, F.desc("completion_pct"), "series_name")


def standalone_unread(state: LibraryState) -> DataFrame:
    """Q12: unread catalog rows without a series."""
    rows = state.catalog.filter("series_name IS NULL OR series_name = ''").filter(~on("is_read"))
    return rows.join(state.authors.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id").select("id", "author_id", "author", "title", "isbn", "format_available", "categories")


def series_summary(state: LibraryState) -> DataFrame:
    """One row of totals by status and the standalone books."""
    s = analyze_series(state).agg(
        F.count("*").alias("total_series"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "partial").alias("partial"), F.count_if(F.col("status") == "not_started").alias("not_started")
    )
    return s.crossJoin(standalone_unread(state).agg(F.count("*").alias("standalone")))


def extract_series(state: LibraryState, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, LibraryState]:
    """Q24: series and position read from titles, where a catalog row has none."""
    rows = state.catalog.filter("series_name IS NULL OR series_name = ''").select("id", "title", X.series_from_title(F.col("title")).alias("s"))
    if limit is not None or offset:
        rows = rows.orderBy("id").offset(offset)
        rows = rows.limit(limit) if limit is not None else rows
    plan = rows.filter("s.name IS NOT NULL").select("id", "title", F.col("s.name").alias("new_series"), F.col("s.position").alias("new_position"))
    joined = state.catalog.join(plan.drop("title"), "id", "left")
    catalog = joined.withColumns({"series_name": F.coalesce("new_series", "series_name"), "series_position": F.when(F.col("new_series").isNotNull(), F.col("new_position")).otherwise(F.col("series_position"))})
    return plan, state.with_(catalog=catalog)


def consolidations(state: LibraryState) -> DataFrame:
    """Q25: spellings of one series per author (F8): the canonical one says `series`, starts with a capital, is short;
    high confidence if positions repeat or run on without a gap."""
    rows = state.catalog.filter("series_name IS NOT NULL").withColumn("series_key", X.series_key(F.col("series_name"))).filter("series_key <> ''")
    spelled = F.struct(
        (~F.contains(F.lower("series_name"), F.lit("series"))).alias("a"), F.substring("series_name", 1, 1).rlike(r"^\p{Ll}").alias("b"), F.length("series_name").alias("c"), F.col("series_name").alias("name")
    )
    position = F.when(F.col("series_position") != 0, F.col("series_position"))
    g = rows.groupBy("author_id", "series_key").agg(
        F.min(spelled)["name"].alias("canonical"), F.array_sort(F.collect_set("series_name")).alias("variants"), F.count("*").alias("books"),
        F.count(position).alias("_n"), F.count_distinct(position).alias("_d"), F.min(position).alias("_lo"), F.max(position).alias("_hi"),
    )
    sure = (F.col("_n") != F.col("_d")) | ((F.col("_d") > 1) & (F.col("_hi") - F.col("_lo") + 1 == F.col("_d")))
    return g.filter(F.size("variants") > 1).select("author_id", "series_key", "canonical", "variants", "books", F.when(sure, "high").otherwise("medium").alias("confidence"))


def numbered(found: DataFrame) -> DataFrame:
    """Consolidations with numbers, by author and series."""
    return with_numbers(found, F.col("author_id"), F.col("series_key"))


def consolidate(state: LibraryState, keep_numbers: list[int] | None = None, without: list[int] | None = None) -> tuple[DataFrame, LibraryState]:
    """Q25 applied; plan is numbered (W3), and only the numbers given (all, if none are), less those in `without`, take effect."""
    plan = numbered(consolidations(state))
    chosen = plan if keep_numbers is None else plan.filter(F.col("number").isin(keep_numbers))
    chosen = chosen.filter(~F.col("number").isin(without)) if without else chosen
    renamed = state.catalog.withColumn("_k", X.series_key(F.col("series_name"))).join(chosen.select("author_id", F.col("series_key").alias("_k"), "canonical"), ["author_id", "_k"], "left")
    return chosen, state.with_(catalog=renamed.withColumn("series_name", F.coalesce("canonical", "series_name")))
