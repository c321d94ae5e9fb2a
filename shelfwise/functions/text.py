"""Normalisers and extractors as column expressions: names, titles, series, identifiers, dates.

All are native (no Python per row). Patterns match Unicode letters, digits and spaces, as the domain's titles do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _u(pattern: str, any_case: bool = True) -> str:
    return ("(?iU)" if any_case else "(?U)") + pattern


def strip_pattern(c: Column, pattern: str, by: str = "", any_case: bool = True) -> Column:
    return F.regexp_replace(c, _u(pattern, any_case), by)


def strip_all(c: Column, patterns) -> Column:
    return reduce(strip_pattern, patterns, c)


def squeeze(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lower_trim(c: Column) -> Column:
    return F.lower(strip(c))


def blank_to_null(c: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def author_name(c: Column) -> Column:
    """the first of several names, without `et al.`; case stays."""
    return strip(strip_pattern(F.substring_index(squeeze(c), ",", 1), r"\s+et\s+al\.?$"))


def title_for_matching(c: Column) -> Column:
    """F2."""
    bare = strip_all(or_empty(c), (L.SERIES_PAREN, L.EDITION_PAREN, L.EDITION_BRACKET, L.LEADING_ARTICLE))
    return F.lower(squeeze(F.regexp_replace(bare, L.APOSTROPHES, "")))


def title_for_dedup(c: Column) -> Column:
    """F3."""
    parts = strip_pattern(or_empty(c), L.SPLIT_PART, " ")
    return squeeze(F.lower(strip_all(parts, (L.EDITION_PAREN_PLAIN, L.EDITION_BRACKET_PLAIN))))


def title_advanced(c: Column) -> Column:
    """F4."""
    bare = strip_all(or_empty(c), (L.SERIES_PAREN_STRICT, L.EDITION_PAREN, L.EDITION_BRACKET, L.EDITION_WORD, *L.VOLUME))
    bare = strip_pattern(strip_pattern(bare, L.SPLIT_PART, " "), L.LEADING_ARTICLE)
    return F.lower(squeeze(F.regexp_replace(bare, L.APOSTROPHES, "")))


def base_title(c: Column) -> Column:
    """case and a leading article stay."""
    bare = strip_pattern(or_empty(c), r"\s*\([^)]+\)\s*$")
    bare = strip_all(bare, (L.SERIES_PAREN_STRICT, *L.VOLUME, L.EDITION_WORD))
    return strip(F.regexp_replace(strip_pattern(bare, r"\s*\[[^\]]+\]\s*$"), L.APOSTROPHES, ""))


def title_and_series(c: Column) -> Column:
    """struct(base, series): the content of the first parenthesis, else of the first bracket."""
    inner = F.coalesce(F.nullif(F.regexp_extract(or_empty(c), r"\(([^)]+)\)", 1), F.lit("")), F.regexp_extract(or_empty(c), r"\[([^\]]+)\]", 1))
    return F.struct(base_title(c).alias("base"), inner.alias("series"))


def title_near(c: Column) -> Column:
    """white space inside stays."""
    return strip(F.lower(strip_all(or_empty(c), (L.EDITION_PAREN_PLAIN.removeprefix(r"\s*"), L.EDITION_BRACKET_PLAIN.removeprefix(r"\s*")))))


def series_key(c: Column) -> Column:
    """F8."""
    bare = strip_all(strip(F.lower(or_empty(c))), (L.LEADING_ARTICLE, r"\s*series\s*$"))
    return strip_pattern(squeeze(bare), r"[^\w\s]")


def isbn_key(c: Column) -> Column:
    """F9."""
    return F.regexp_replace(or_empty(c), "[- ]", "")


def series_from_title(c: Column) -> Column:
    """struct(name, position) of the first parenthesis; both null unless a name of three characters or more
    stands before a number."""
    inner = F.regexp_extract(or_empty(c), r"\(([^)]+)\)", 1)
    name = strip(strip_pattern(strip(F.regexp_extract(inner, _u(L.SERIES_NUMBER), 1)), r"\s+Book\s*$"))
    position = F.regexp_extract(inner, _u(L.SERIES_NUMBER), 2).try_cast("int")
    ok = (F.length(name) > 2) & position.isNotNull()
    return F.struct(F.when(ok, name).alias("name"), F.when(ok, position).alias("position"))


def subtitle_series(title: Column, subtitle: Column) -> Column:
    """F11 for volumes: the title is the series where the subtitle has a book number."""
    position = F.regexp_extract(F.lower(or_empty(subtitle)), r"(?U)(?:book|#)\s*(\d+)", 1).try_cast("int")
    return F.struct(F.when(position.isNotNull(), or_empty(title)).alias("name"), position.alias("position"))


def safe_filename(c: Column) -> Column:
    """F12."""
    flat = F.regexp_replace(F.regexp_replace(c, r"""[/\\'"<>|:*?&\x00-\x1F\x7F]""", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(flat, F.lit("_ ")), F.lit("")), F.lit("empty"))


def first_last(c: Column) -> Column:
    """struct(first, last), lower case, word characters only; '' where there is none."""
    parts = F.filter(F.split(squeeze(strip_pattern(or_empty(c), r"\([^)]*\)")), " "), lambda p: p != "")
    bare = lambda p: F.lower(strip_pattern(or_empty(p), r"[^\w]"))
    return F.struct(bare(F.get(parts, F.lit(0))).alias("first"), F.when(F.size(parts) > 1, bare(F.element_at(parts, -1))).otherwise("").alias("last"))


def author_group(c: Column) -> Column:
    """the names of a comma list with two names or more (longer than two characters), else null."""
    names = F.filter(F.transform(F.split(or_empty(c), ","), strip), lambda p: F.length(p) > 2)
    return F.when(F.size(names) >= 2, names)


def composite_parts(c: Column) -> Column:
    """the titles of a composite title by the first separator that gives two or more; else empty."""

    def parts(sep: str) -> Column:
        found = F.filter(F.transform(F.split(or_empty(c), f"\\Q{sep}\\E"), strip), lambda p: F.length(p) > 3)
        return F.when(F.size(found) > 1, found)

    return F.coalesce(*(parts(s) for s in L.COMPOSITE_SEPARATORS), F.array().cast("array<string>"))


def best_isbn(*groups: tuple[Column, Column]) -> Column:
    """F16: of each (isbn_13, isbn_10), the first that has any; a document's own come before the next's."""
    return F.coalesce(*(F.get(a, F.lit(0)) for pair in groups for a in pair))


def publication_year(c: Column) -> Column:
    """the first whole word 19xx or 20xx."""
    return F.regexp_extract(or_empty(c), r"(?U)\b(19\d{2}|20\d{2})\b", 1).try_cast("int")


def loan_date(c: Column) -> Column:
    """F18."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("MMMM d, yyyy H:mm")), F.try_to_timestamp(c, F.lit("MMMM d, yyyy")))


def since(c: Column, now: Column) -> Column:
    """how long ago a timestamp is, in words. Strings that are no timestamps: Unknown."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(c.try_cast("timestamp"))
    days = F.floor(seconds / 86400)
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(c.isNull() | (c.cast("string") == ""), "Never")
        .when(seconds.isNull(), "Unknown")
        .when((days < 1) & (hours < 1) & (minutes < 1), "Just now")
        .when((days < 1) & (hours < 1), ago(minutes, "minute"))
        .when(days < 1, F.when(hours == 1, "1 hour ago").otherwise(F.concat(hours.cast("string"), F.lit(" hours ago"))))
        .when(days == 1, "1 day ago")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 30, ago(F.floor(days / 7), "week"))
        .otherwise(ago(F.floor(days / 30), "month"))
    )


def author_key(c: Column) -> Column:
    """keys of authors as /authors/X."""
    return F.when(c.startswith("/authors/"), c).when(c.startswith("/"), F.concat(F.lit("/authors"), c)).otherwise(F.concat(F.lit("/authors/"), c))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((or_empty(a) == "") | (or_empty(b) == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def similar(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) >= least, by lengths first and by a distance that stops at what is allowed."""
    longest = F.greatest(F.length(a), F.length(b))
    near = F.abs(F.length(a) - F.length(b)) <= F.floor((1 - least) * longest + 1e-9)
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & near & (similarity(a, b) >= least), F.lit(False))


def category_list(c: Column) -> Column:
    """the categories of a joined string; empty for null and ''."""
    return F.when(or_empty(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ", "))


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
