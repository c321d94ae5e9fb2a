"""Curation of catalogs: omnibus volumes, children's books, non-English titles, user patterns (Q26-Q28, Q32)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, with_numbers
from ..store import settled
from .catalog import sliced
from .matching import eligible
from .parts import either_holding

#: Titles that the pattern filter takes by default.
DEFAULT_PATTERNS = (r"modern\s+principle", "macroeconomics", "microeconomics")


def composites(state: LibraryState) -> DataFrame:
    """Q26: eligible composite volumes of authors with two eligible rows or more: the parts' best standalone rows (1.0
    equal normalised titles, 0.8 equal base titles, 0.7 one holds the other; earliest row of the best), confidence high
    if all parts have one, medium if some, low if none or no part is named."""
    # Titles may lie in few row groups: they are dealt to all tasks before they are judged, and judged once.
    dealt = settled(state.catalog.select("id", "author_id", "title", "series_name", "series_position", "is_read").repartition("id"))
    english = settled(eligible(dealt).drop("is_read").withColumn("_c", C.is_composite(F.col("title"))))
    several = english.groupBy("author_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("author_id")
    rows = english.join(several, "author_id", "left_semi")
    whole = settled(rows.filter("_c").select(F.col("id").alias("composite_id"), "author_id", "title", "series_name", "series_position", X.composite_parts(F.col("title")).alias("parts")))
    single = settled(rows.filter("NOT _c").select(F.col("id").alias("standalone_id"), "author_id", F.lower("title").alias("_sl"), X.title_advanced(F.col("title")).alias("_sn"), F.lower(X.base_title(F.col("title"))).alias("_sb")))
    part = whole.select("composite_id", "author_id", F.posexplode("parts").alias("pos", "part"))
    # Parts and rows meet as different texts, a text of rows at its earliest one: copies make no pairs.
    texts = settled(part.select("author_id", "part").distinct().withColumns({"_pl": F.lower("part"), "_pn": X.title_advanced(F.col("part")), "_pb": F.lower(X.base_title(F.col("part")))}))

    def firsts(key: str) -> DataFrame:
        return single.filter(F.col(key).isNotNull()).groupBy("author_id", key).agg(F.min("standalone_id").alias("standalone_id"))

    keys = ["author_id", "part", "standalone_id"]
    equal = [
        texts.filter(f"{p} <> ''").join(firsts(q).withColumnRenamed(q, p), ["author_id", p]).select(*keys, F.lit(score).alias("score"))
        for p, q, score in (("_pn", "_sn", 1.0), ("_pb", "_sb", 0.8))
    ]
    scored = reduce(DataFrame.unionByName, [*equal, either_holding(texts, firsts("_sl"), ["author_id"], "_pl", "_sl").select(*keys, F.lit(0.7).alias("score"))])
    found = scored.groupBy("author_id", "part").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("standalone_id"))).alias("m"))
    best = part.join(found, ["author_id", "part"])
    per = best.groupBy("composite_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("m.standalone_id").alias("standalone_id"), (-F.col("m.s")).alias("score")))).alias("matches"))
    n, k = F.size("parts"), F.coalesce(F.size("matches"), F.lit(0))
    out = whole.join(per, "composite_id", "left")
    return out.select(
        "composite_id", "author_id", "title", "series_name", "series_position", "parts",
        F.when((n > 0) & (k == n), "high").when(k > 0, "medium").otherwise("low").alias("confidence"), F.coalesce("matches", F.array().cast("array<struct<pos:int,standalone_id:bigint,score:double>>")).alias("matches"),
    )


def numbered_composites(state: LibraryState) -> DataFrame:
    return numbered(composites(state), "composite_id")


def remove_composites(state: LibraryState, backfill: bool = True, keep_ids: list[int] | None = None, keep_numbers: list[int] | None = None) -> tuple[DataFrame, LibraryState]:
    """Q26 applied: listed composites go, whatever the confidence, but for those whose id or number is kept; their
    standalone rows take the composite's series and are numbered over the matched ones (W7)."""
    plan = composites(state)
    if keep_numbers:
        plan = numbered(plan, "composite_id").filter(~F.col("number").isin(keep_numbers)).drop("number")
    if keep_ids:
        plan = plan.filter(~F.col("composite_id").isin(keep_ids))
    plan = settled(plan)
    catalog = state.catalog.join(plan.select(F.col("composite_id").alias("id")), "id", "left_anti")
    if backfill:
        found = plan.filter("series_name <> ''").select("composite_id", "series_name", F.posexplode("matches").alias("i", "m"))
        fill = found.groupBy(F.col("m.standalone_id").alias("id")).agg(F.max(F.struct("composite_id", F.col("series_name").alias("s"), (F.col("i") + 1).alias("p"))).alias("f"))
        catalog = catalog.join(fill, "id", "left").withColumns({"series_name": F.coalesce("f.s", "series_name"), "series_position": F.coalesce("f.p", "series_position")})
    return plan, state.with_(catalog=catalog)


def childrens_books(state: LibraryState) -> DataFrame:
    """Q27: eligible rows that read as children's books, numbered, with reasons."""
    rows = eligible(state.catalog).withColumn("_c", C.childrens(F.col("title"), F.col("series_name"), F.col("categories"), F.col("description"))).filter("_c.flag")
    return rows.select("id", "author_id", "title", F.col("_c.reasons").alias("reasons"))


def numbered(plan: DataFrame, by: str = "id") -> DataFrame:
    """A preview list with numbers, by author and row; rows are numbered within their author, and only authors' counts
    meet in one task."""
    return with_numbers(plan, F.col("author_id"), F.col(by))


def delete_rows(state: LibraryState, plan: DataFrame, keep_numbers: list[int] | None = None) -> tuple[DataFrame, LibraryState]:
    """The planned catalog rows go, but for those whose number is kept."""
    chosen = numbered(plan).filter(~F.col("number").isin(keep_numbers)) if keep_numbers else plan
    return chosen, state.with_(catalog=state.catalog.join(chosen.select("id"), "id", "left_anti"))


def non_english_scan(state: LibraryState) -> DataFrame:
    """Q28: catalog rows whose title isn't English (C2), with the reasons."""
    rows = state.catalog.withColumn("_c", C.non_english(F.col("title"))).filter("_c.flag")
    return rows.select("id", "author_id", "title", F.col("_c.reasons").alias("reasons"))


def cleanup_review(state: LibraryState) -> DataFrame:
    """Q28, verify: rows that the review rule (C4) flags, with all its reasons."""
    rows = state.catalog.withColumn("_c", C.review_non_english(F.col("title"))).filter("_c.flag")
    return rows.select("id", "author_id", "title", F.col("_c.reasons").alias("reasons"))


def verify_cleanup(state: LibraryState, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Q28, verify: of a slice of the catalog, one row: how many books, how many the cleanup (C3) would take, and the share."""
    rows = sliced(state.catalog, limit, offset).agg(F.count("*").alias("checked"), F.count_if(C.cleanup_non_english(F.col("title"))).alias("flagged"))
    return rows.select("checked", "flagged", F.when(F.col("checked") > 0, 100.0 * F.col("flagged") / F.col("checked")).otherwise(0.0).alias("flagged_pct"))


def language_report(state: LibraryState, at_least: int = 0) -> DataFrame:
    """English and other titles per author with more than `at_least` catalog rows."""
    other = F.count_if(C.non_english(F.col("title"))["flag"])
    g = state.catalog.groupBy("author_id").agg(F.count("*").alias("books"), other.alias("non_english"))
    return g.filter(F.col("books") > at_least).select("author_id", "books", (F.col("books") - F.col("non_english")).alias("english"), "non_english", (100.0 * F.col("non_english") / F.col("books")).alias("non_english_pct")).orderBy(F.desc("books"), "author_id")


def filter_books(state: LibraryState, author_id: int | None = None, patterns: tuple[str, ...] = DEFAULT_PATTERNS) -> tuple[DataFrame, LibraryState]:
    """Q32: catalog rows (of one author, if given) whose title matches one of the user's patterns go."""
    hit = reduce(or_, (F.col("title").rlike(f"(?iU){p}") for p in patterns))
    rows = state.catalog if author_id is None else state.catalog.filter(F.col("author_id") == author_id)
    plan = rows.filter(hit).select("id", "author_id", "title")
    return plan, state.with_(catalog=state.catalog.join(plan.select("id"), "id", "left_anti"))
