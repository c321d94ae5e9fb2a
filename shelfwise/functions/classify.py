"""Classifiers as column expressions: format, language, audience, omnibus volumes, publishers, fiction, completeness.

Those that explain themselves give struct(flag, reasons)."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import text as X


def _any(tests) -> Column:
    return reduce(or_, tests)


def contains_any(c: Column, parts) -> Column:
    return _any(F.contains(c, F.lit(p)) for p in parts)


def _matches(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iU){pattern}")


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, f"(?iU){pattern}", 0)


def _quoted(label: str, what: Column) -> Column:
    return F.concat(F.lit(f"{label}: '"), what, F.lit("'"))


def _first_reason(cases: list[tuple[Column, Column]]) -> Column:
    """struct(flag, reasons): the reason of the first case that holds."""
    chain = reduce(lambda w, case: w.when(case[0], case[1]), cases[1:], F.when(cases[0][0], cases[0][1]))
    return F.struct(chain.isNotNull().alias("flag"), F.array_compact(F.array(chain)).alias("reasons"))


def loan_format(publisher: Column) -> Column:
    """C1."""
    return F.when(X.or_empty(publisher) == "", "unknown").when(contains_any(F.lower(publisher), L.AUDIO_PUBLISHERS), "audiobook").otherwise("ebook")


SCRIPT_CLASS = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in L.SCRIPTS) + "]"
LANGUAGE_NAMES = "(?:" + "|".join(L.LANGUAGES) + ")"
EDITION_OF = {
    "Language edition in parentheses": rf"\([^)]*{LANGUAGE_NAMES}\s*(?:edition|version|translation)?[^)]*\)",
    "Language edition in brackets": rf"\[[^\]]*{LANGUAGE_NAMES}\s*(?:edition|version|translation)?[^\]]*\]",
    "Standalone language edition": rf"\b{LANGUAGE_NAMES}\s+(?:edition|version|translation)\b",
}
SPANISH = rf"\b(?:{'|'.join(L.SPANISH_WORDS)})\b"
SPANISH_AUDIT = rf"\b(?:{'|'.join((*L.SPANISH_WORDS, *L.HOUSE_NAMES))})\b"
SCRIPT_REASON = "Non-English script detected (CJK/Cyrillic/Arabic/Hebrew)"


def _edition_cases(t: Column) -> list[tuple[Column, Column]]:
    return [(_matches(t, p), _quoted(label, _found(t, p))) for label, p in EDITION_OF.items()]


def _spanish_case(t: Column) -> tuple[Column, Column]:
    return ~F.contains(F.lower(t), F.lit("house edition")) & _matches(t, SPANISH), _quoted("Spanish text indicator", _found(t, SPANISH))


def non_english(title: Column) -> Column:
    """struct(flag, reasons); the first of seven rules that holds."""
    t = X.or_empty(title)
    words = F.filter(F.split(X.squeeze(t), " "), lambda w: w != "")

    def odd_case(w: Column) -> Column:
        plain = F.lower(w)
        rest = F.substring(w, 2, 4)
        mixed = w.rlike(r"^\p{Lu}") & rest.rlike(r"\p{Ll}") & rest.rlike(r"\p{Lu}")
        return F.length(w).between(3, 5) & mixed & ~plain.isin(*L.MIXED_CASE_WORDS) & ~F.rtrim(plain, F.lit("'s")).isin(*L.MIXED_CASE_WORDS)

    odd = F.filter(words, odd_case)
    cases = [
        (t.rlike(SCRIPT_CLASS), F.lit(SCRIPT_REASON)),
        (_any(_matches(t, p) for p in L.HEBREW_WORDS), F.lit("Hebrew transliteration pattern detected")),
        *_edition_cases(t),
        _spanish_case(t),
        (t.rlike("[¿¡]"), F.lit("Spanish punctuation (¿ or ¡)")),
        (t.rlike("ß"), F.lit("German ß character")),
        (_matches(t, r"^X[a-z]{2,}") & ~F.lower(F.get(words, F.lit(0))).isin(*L.X_WORDS), F.lit("Suspicious encoding pattern: X prefix")),
        (F.size(odd) > 0, _quoted("Suspicious capitalization pattern", F.get(odd, F.lit(0)))),
        (
            (F.size(words) > 2) & _any(F.regexp_count(t, F.lit(rf"(?iU)\b(?:{'|'.join(a)})\s+[A-Z]")) / F.size(words) > 0.3 for a in (L.ARTICLES, L.PARTICLES)),
            F.lit("Non-English article/preposition pattern detected"),
        ),
    ]
    return _first_reason(cases)


def is_english(title: Column) -> Column:
    return ~non_english(title)["flag"]


def _accents(t: Column, letters: str, any_case: bool, ratio: float, short: int) -> tuple[Column, Column, Column]:
    """(flagged, accented letters, letters)."""
    n = F.regexp_count(t, F.lit(("(?iu)" if any_case else "") + f"[{letters}]"))
    total = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (total > 0) & (n > 0) & ((n / F.nullif(total, F.lit(0)) > ratio) | ((F.length(t) < short) & (n >= 2)) | (n >= 3)), n, total


def cleanup_non_english(title: Column) -> Column:
    """The rule by which the cleanup removes titles (a plain flag)."""
    t = X.or_empty(title)
    accented, _, _ = _accents(t, L.ACCENTED_LOWER + L.ACCENTED_UPPER, False, 0.10, 20)
    return _any(c for c, _ in _edition_cases(t)) | _spanish_case(t)[0] | t.rlike(SCRIPT_CLASS) | t.rlike("[¿¡ß]") | F.coalesce(accented, F.lit(False))


def review_non_english(title: Column, ratio: float = 0.05, short: int = 15, spanish: str | None = None) -> Column:
    """C4: struct(flag, reasons) with all reasons that hold. `spanish` replaces the Spanish words' pattern and then
    also speaks for house editions (the audit's variant)."""
    t = X.or_empty(title)
    accented, n, total = _accents(t, L.ACCENTED_REVIEW, True, ratio, short)
    share = F.concat(F.lit("High accented character ratio ("), n.cast("string"), F.lit("/"), total.cast("string"), F.lit(", "), F.format_number(100.0 * n / F.nullif(total, F.lit(0)), 1), F.lit("%)"))
    spanish_case = (_matches(t, spanish), _quoted("Spanish text indicator", _found(t, spanish))) if spanish else _spanish_case(t)
    cases = [*_edition_cases(t), spanish_case, (t.rlike(SCRIPT_CLASS), F.lit(SCRIPT_REASON)), (t.rlike("[¿¡]"), F.lit("Spanish punctuation (¿ or ¡)")), (t.rlike("ß"), F.lit("German ß character")), (F.coalesce(accented, F.lit(False)), share)]
    reasons = F.array_compact(F.array(*(F.when(c, r) for c, r in cases)))
    return F.struct((F.size(reasons) > 0).alias("flag"), reasons.alias("reasons"))


def languages_english(edition: Column, work: Column, title: Column) -> Column:
    """C5 for works: the edition's languages decide, else the work's, else the title's script. Both are arrays of keys."""

    def verdict(langs: Column) -> Column:
        return F.when(F.coalesce(F.size(langs), F.lit(0)) > 0, F.exists(langs, lambda k: F.coalesce(F.contains(k, F.lit("/languages/eng")) | (k == "eng"), F.lit(False))))

    return F.coalesce(verdict(edition), verdict(work), ~X.or_empty(title).rlike(SCRIPT_CLASS))


def volume_english(language: Column, title: Column) -> Column:
    """C5 for volumes."""
    return F.when(X.or_empty(language) != "", F.lower(language).startswith("en")).otherwise(~X.or_empty(title).rlike(SCRIPT_CLASS))


def editions_english(editions: Column, work: Column, title: Column, first: int = 5) -> Column:
    """Whether one of the first editions, or else the work, is English. editions: array of arrays of language keys;
    without any the work decides."""
    some = F.slice(editions, 1, first)
    return F.when(F.coalesce(F.size(some), F.lit(0)) > 0, F.exists(some, lambda e: languages_english(e, F.lit(None).cast("array<string>"), title)) | languages_english(F.lit(None).cast("array<string>"), work, title)).otherwise(languages_english(F.lit(None).cast("array<string>"), work, title))


def childrens(title: Column, series_name: Column, categories: Column, description: Column) -> Column:
    """struct(flag, reasons); the first of six rule families that holds."""
    t, s, c, d = (F.lower(X.or_empty(x)) for x in (title, series_name, categories, description))
    everything = F.concat_ws(" ", t, c, d)
    cases = [(_matches(t, p), _quoted("Children's indicator in title", _found(t, p))) for p in L.CHILDRENS_TITLE]
    for p in L.CHILDRENS_SERIES:
        cases.append((_matches(t, p) & _matches(s, p), _quoted("Children's series name", _found(X.or_empty(series_name), p))))
        cases.append((_matches(t, p), _quoted("Children's series in title", _found(t, p))))
    cases += [(_matches(everything, p), _quoted("Age range indicator", _found(everything, p))) for p in L.AGE_RANGES]
    cases += [(F.contains(c, F.lit(x)), F.lit(f"Children's category: '{x}'")) for x in L.CHILDRENS_CATEGORIES]
    cases += [(F.contains(d, F.lit(x)), F.lit(f"Children's keyword in description: '{x}'")) for x in L.CHILDRENS_DESCRIPTION]
    cases.append((_any(_matches(everything, p) for p in L.KNOWN_CHILDRENS_SERIES) & contains_any(everything, L.CHILDRENS_CONTEXT), F.lit("Known children's series with children's context")))
    return _first_reason(cases)


def is_composite(title: Column) -> Column:
    """C8. (A first position with several titles implies a separator.)"""
    t = X.or_empty(title)
    return t.rlike("[/|]") | _any(_matches(t, p) for p in L.COMPOSITE_RANGES)


def is_publisher(name: Column) -> Column:
    """C9."""
    n = F.lower(X.or_empty(name))
    return _any(n.rlike(f"(?U){p}") for p in L.PUBLISHER_PATTERNS) | contains_any(n, L.PUBLISHER_NAMES)


def publisher_label(name: Column) -> Column:
    """C10."""
    n = F.lower(X.or_empty(name))
    chain = reduce(lambda w, x: w.when(contains_any(n, x[1]), x[0]), L.PUBLISHER_LABELS[1:], F.when(contains_any(n, L.PUBLISHER_LABELS[0][1]), L.PUBLISHER_LABELS[0][0]))
    upper = (F.upper(name) == name) & name.rlike(r"\p{Lu}") & (F.size(F.split(X.squeeze(name), " ")) <= 3)
    return chain.when(upper, "Acronyms").otherwise("Other")


def is_fiction(categories: Column) -> Column:
    """C11: no category holds a non-fiction word; without categories: fiction."""
    return ~F.exists(categories, lambda c: contains_any(F.lower(c), L.NON_FICTION))


def toggled_categories(categories: Column) -> Column:
    """categories moved to the other of fiction and non-fiction."""
    marked = F.when(F.array_contains(categories, "Non-Fiction"), categories).otherwise(F.array_append(categories, F.lit("Non-Fiction")))
    factual = F.when(F.exists(marked, lambda c: contains_any(F.lower(c), L.NON_FICTION_MARKS)), marked).otherwise(F.array_append(marked, F.lit("History")))
    rest = F.filter(categories, lambda c: ~contains_any(F.lower(c), L.NON_FICTION))
    fictional = F.when(F.array_contains(rest, "Fiction"), rest).otherwise(F.array_prepend(rest, F.lit("Fiction")))
    return F.when(is_fiction(categories), factual).otherwise(fictional)


def _filled(c: Column) -> Column:
    return X.or_empty(c.cast("string")) != ""


def completeness(with_volume_id: bool = True) -> Column:
    """C12 of a catalog row: how much of it is filled in."""
    points = [("isbn", 10), ("description", 5), ("open_library_key", 3), *([("google_books_id", 2)] if with_volume_id else []), ("publication_date", 1)]
    return reduce(add, (F.when(_filled(F.col(c)), n).otherwise(0) for c, n in points))


def recommendation_completeness() -> Column:
    """C12 of a recommendation."""
    flags = [(_filled(F.col("isbn")), 10), (~F.coalesce(F.col("duplicate"), F.lit(False)), 5), (F.col("catalog_book_id").isNotNull(), 3), (_filled(F.col("reason")), 2)]
    return reduce(add, (F.when(c, n).otherwise(0) for c, n in flags))


#: The tags of duplicate_reasons, in its order.
DUPLICATE_TAGS = (
    "exact_normalized", "base_title_match", "isbn_match", "fuzzy_match", "apostrophe_variations", "punctuation_variations",
    "series_variations", "edition_variations", "volume_variations",
)


def duplicate_reasons(kept: Column, other: Column, kept_isbn: Column, other_isbn: Column) -> Column:
    """Why a title counts as a duplicate of the kept one, as tags in fixed order."""
    ka, oa, kb, ob = X.title_advanced(kept), X.title_advanced(other), F.lower(X.base_title(kept)), F.lower(X.base_title(other))
    kl, ol = F.lower(kept), F.lower(other)
    differ, same_base = kept != other, kb == ob

    def bare(c: Column, pattern: str) -> Column:
        return X.strip_pattern(c, pattern, any_case=False)

    def without_volume(c: Column) -> Column:
        return X.title_advanced(X.strip_all(c, L.VOLUME))

    tags = [
        ("exact_normalized", ka == oa),
        ("base_title_match", same_base),
        ("isbn_match", _filled(kept_isbn) & _filled(other_isbn) & (X.isbn_key(kept_isbn) == X.isbn_key(other_isbn))),
        ("fuzzy_match", X.similar(ka, oa, 0.85)),
        ("apostrophe_variations", (bare(kl, L.APOSTROPHES) == bare(ol, L.APOSTROPHES)) & differ),
        ("punctuation_variations", (bare(kl, r"[^\w\s]") == bare(ol, r"[^\w\s]")) & differ),
        ("series_variations", (F.contains(kl, F.lit("(series")) | F.contains(ol, F.lit("(series"))) & same_base),
        ("edition_variations", (kl.rlike(r"(?U)\b(?:edition|ed\.)") | ol.rlike(r"(?U)\b(?:edition|ed\.)")) & same_base),
        ("volume_variations", (kl.rlike(r"(?U)\b(?:volume|vol\.?)") | ol.rlike(r"(?U)\b(?:volume|vol\.?)")) & (without_volume(kl) == without_volume(ol)) & differ),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in tags)))
