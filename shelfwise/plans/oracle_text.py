"""The functions and classifiers as SQL expressions for DuckDB."""

from __future__ import annotations

from ..functions import lexicon as L
from .queries import NOW


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def gone(x: str, pattern: str, by: str = "", flags: str = "gi") -> str:
    return f"regexp_replace({x}, '{_q(pattern)}', '{by}', '{flags}')"


def gone_all(x: str, *patterns: str) -> str:
    for p in patterns:
        x = gone(x, p)
    return x


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{_q(pattern)}', 'i')"


def any_of(x: str, patterns) -> str:
    return "(" + " OR ".join(has(x, p) for p in patterns) + ")"


def parts_of(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{_q(p)}')" for p in parts) + ")"


def lt(x: str) -> str:
    return f"lower({strip(x)})"


def f2(x: str) -> str:
    return f"lower({squeeze(gone(gone_all(x, L.SERIES_PAREN, L.EDITION_PAREN, L.EDITION_BRACKET, L.LEADING_ARTICLE), L.APOSTROPHES))})"


def f3(x: str) -> str:
    return squeeze(f"lower({gone_all(gone(x, L.SPLIT_PART, ' '), L.EDITION_PAREN_PLAIN, L.EDITION_BRACKET_PLAIN)})")


def f4(x: str) -> str:
    y = gone(gone_all(x, L.SERIES_PAREN_STRICT, L.EDITION_PAREN, L.EDITION_BRACKET, L.EDITION_WORD, *L.VOLUME), L.SPLIT_PART, " ")
    return f"lower({squeeze(gone(gone(y, L.LEADING_ARTICLE), L.APOSTROPHES))})"


def f5(x: str) -> str:
    y = gone_all(gone(x, r"\s*\([^)]+\)\s*$"), L.SERIES_PAREN_STRICT, *L.VOLUME, L.EDITION_WORD)
    return strip(gone(gone(y, r"\s*\[[^\]]+\]\s*$"), L.APOSTROPHES))


def f7(x: str) -> str:
    return strip(f"lower({gone_all(x, L.EDITION_PAREN_PLAIN[3:], L.EDITION_BRACKET_PLAIN[3:])})")


def f8(x: str) -> str:
    y = gone_all(strip(f"lower(coalesce({x}, ''))"), L.LEADING_ARTICLE, r"\s*series\s*$")
    return gone(squeeze(y), r"[^\w\s]")


def f15(x: str) -> str:
    """The parts by slash (the titles have no bar)."""
    some = f"list_filter(list_transform(string_split({x}, '/'), lambda y: trim(y)), lambda y: length(y) > 3)"
    return f"(CASE WHEN contains({x}, '/') AND len({some}) > 1 THEN {some} ELSE CAST([] AS VARCHAR[]) END)"


def f10(x: str) -> tuple[str, str]:
    inner = rf"regexp_extract({x}, '\(([^)]+)\)', 1)"
    name = strip(gone(strip(f"regexp_extract({inner}, '{L.SERIES_NUMBER}', 1, 'i')"), r"\s+Book\s*$"))
    number = f"TRY_CAST(regexp_extract({inner}, '{L.SERIES_NUMBER}', 2, 'i') AS INTEGER)"
    ok = f"length({name}) > 2 AND {number} IS NOT NULL"
    return f"CASE WHEN {ok} THEN {name} END", f"CASE WHEN {ok} THEN {number} END"


NAMES = "(?:" + "|".join(L.LANGUAGES) + ")"
EDITIONS = (rf"\([^)]*{NAMES}\s*(?:edition|version|translation)?[^)]*\)", rf"\[[^\]]*{NAMES}\s*(?:edition|version|translation)?[^\]]*\]", rf"\b{NAMES}\s+(?:edition|version|translation)\b")
SPANISH = rf"\b(?:{'|'.join(L.SPANISH_WORDS)})\b"
SCRIPTS = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in L.SCRIPTS) + "]"


def c2_reason(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({squeeze(x)}, ' '), lambda w: w <> '')"
    mixed = ", ".join(f"'{w}'" for w in L.MIXED_CASE_WORDS)
    odd = rf"list_filter({words}, lambda w: length(w) BETWEEN 3 AND 5 AND regexp_matches(w, '^[A-Z]') AND regexp_matches(w[2:], '[a-z]') AND regexp_matches(w[2:], '[A-Z]') AND lower(w) NOT IN ({mixed}) AND rtrim(lower(w), '''s') NOT IN ({mixed}))"
    articles = " OR ".join(rf"len(regexp_extract_all({x}, '\b(?:{'|'.join(a)})\s+[A-Z]', 0, 'i')) / len({words}) > 0.3" for a in (L.ARTICLES, L.PARTICLES))
    heb = any_of(x, [p for p in L.HEBREW_WORDS if "x{" not in p])
    first = f"lower({words}[1]) NOT IN ({', '.join(repr(w) for w in L.X_WORDS)})"
    labels = ("Language edition in parentheses", "Language edition in brackets", "Standalone language edition")
    eds = " ".join(f"WHEN {has(x, p)} THEN '{label}: ''' || regexp_extract({x}, '{_q(p)}', 0, 'i') || ''''" for label, p in zip(labels, EDITIONS))
    return f"""CASE WHEN regexp_matches({x}, '{SCRIPTS}') THEN 'Non-English script detected (CJK/Cyrillic/Arabic/Hebrew)'
      WHEN {heb} THEN 'Hebrew transliteration pattern detected' {eds}
      WHEN NOT contains(lower({x}), 'house edition') AND {has(x, SPANISH)} THEN 'Spanish text indicator: ''' || regexp_extract({x}, '{SPANISH}', 0, 'i') || ''''
      WHEN regexp_matches({x}, '[¿¡]') THEN 'Spanish punctuation (¿ or ¡)' WHEN contains({x}, 'ß') THEN 'German ß character'
      WHEN {has(x, '^X[a-z]{2,}')} AND {first} THEN 'Suspicious encoding pattern: X prefix'
      WHEN len({odd}) > 0 THEN 'Suspicious capitalization pattern: ''' || {odd}[1] || ''''
      WHEN len({words}) > 2 AND ({articles}) THEN 'Non-English article/preposition pattern detected' END"""


def c3(x: str) -> str:
    """The titles are plain letters, so accents never decide."""
    return f"({any_of(x, EDITIONS)} OR (NOT contains(lower({x}), 'house edition') AND {has(x, SPANISH)}))"


def c4(x: str) -> str:
    """Compared in any case, the dotless i of the review rule also stands for i: with plain titles, only that counts."""
    n, letters = f"len(regexp_extract_all({x}, '[iI]'))", f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    return f"({c3(x)} OR ({n} > 0 AND ({n} / {letters} > 0.05 OR (length({x}) < 15 AND {n} >= 2) OR {n} >= 3)))"


def c4_reasons(x: str) -> str:
    """All reasons of the review rule, as a list; of accents only the dotless i, as in c4."""
    n, letters = f"len(regexp_extract_all({x}, '[iI]'))", f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    labels = ("Language edition in parentheses", "Language edition in brackets", "Standalone language edition")
    quote = "''''"
    cases = [f"CASE WHEN {has(x, p)} THEN '{label}: ''' || regexp_extract({x}, '{_q(p)}', 0, 'i') || {quote} END" for label, p in zip(labels, EDITIONS)]
    cases.append(f"CASE WHEN NOT contains(lower({x}), 'house edition') AND {has(x, SPANISH)} THEN 'Spanish text indicator: ''' || regexp_extract({x}, '{SPANISH}', 0, 'i') || {quote} END")
    cases.append(
        f"CASE WHEN {n} > 0 AND ({n} / {letters} > 0.05 OR (length({x}) < 15 AND {n} >= 2) OR {n} >= 3) "
        f"THEN 'High accented character ratio (' || CAST({n} AS VARCHAR) || '/' || CAST({letters} AS VARCHAR) || ', ' || printf('%.1f', 100.0 * {n} / {letters}) || '%)' END"
    )
    return f"list_filter([{', '.join(cases)}], lambda r: r IS NOT NULL)"


def c7(t: str, s: str, c: str, d: str) -> str:
    t, s, c, d = (f"lower(coalesce({x}, ''))" for x in (t, s, c, d))
    every = f"concat_ws(' ', {t}, {c}, {d})"
    known = f"({any_of(every, L.KNOWN_CHILDRENS_SERIES)} AND {parts_of(every, L.CHILDRENS_CONTEXT)})"
    return f"({any_of(t, L.CHILDRENS_TITLE)} OR {any_of(t, L.CHILDRENS_SERIES)} OR {any_of(every, L.AGE_RANGES)} OR {parts_of(c, L.CHILDRENS_CATEGORIES)} OR {parts_of(d, L.CHILDRENS_DESCRIPTION)} OR {known})"


def c8(x: str) -> str:
    return f"(regexp_matches({x}, '[/|]') OR {any_of(x, L.COMPOSITE_RANGES)})"


def c9(x: str) -> str:
    return f"({any_of(f'lower({x})', L.PUBLISHER_PATTERNS)} OR {parts_of(f'lower({x})', L.PUBLISHER_NAMES)})"


def c10(x: str) -> str:
    cases = " ".join(f"WHEN {parts_of(f'lower({x})', parts)} THEN '{label}'" for label, parts in L.PUBLISHER_LABELS)
    return f"CASE {cases} WHEN upper({x}) = {x} AND regexp_matches({x}, '[A-Z]') AND len(string_split({x}, ' ')) <= 3 THEN 'Acronyms' ELSE 'Other' END"


CATS = "(CASE WHEN coalesce(categories, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(categories, ', ') END)"
FICTION = f"(len(list_filter({CATS}, lambda c: {parts_of('lower(c)', L.NON_FICTION)})) = 0)"
C12 = "(CASE WHEN coalesce(isbn, '') <> '' THEN 10 ELSE 0 END + CASE WHEN coalesce(description, '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(open_library_key, '') <> '' THEN 3 ELSE 0 END + CASE WHEN coalesce(google_books_id, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(publication_date, '') <> '' THEN 1 ELSE 0 END)"
_MARKED = f"(CASE WHEN list_contains({CATS}, 'Non-Fiction') THEN {CATS} ELSE list_append({CATS}, 'Non-Fiction') END)"
_FACT = f"(CASE WHEN len(list_filter({_MARKED}, lambda c: {parts_of('lower(c)', L.NON_FICTION_MARKS)})) > 0 THEN {_MARKED} ELSE list_append({_MARKED}, 'History') END)"
_REST = f"list_filter({CATS}, lambda c: NOT {parts_of('lower(c)', L.NON_FICTION)})"
F20 = f"array_to_string(CASE WHEN {FICTION} THEN {_FACT} WHEN list_contains({_REST}, 'Fiction') THEN {_REST} ELSE list_prepend('Fiction', {_REST}) END, ', ')"

BAD = "(coalesce(thumbs_down, false) OR coalesce(non_english, false) OR coalesce(already_read, false) OR coalesce(duplicate, false))"
VISIBLE = f"NOT {BAD}"


def candidates(fmt: str) -> str:
    only = "WHERE format = 'audiobook'" if fmt == "audiobook" else ""
    score, why = ("CAST(0.95 AS DOUBLE)", "listened to") if fmt == "audiobook" else ("CAST(0.9 AS DOUBLE)", "read")
    return f"""hist AS (SELECT * FROM books {only}),
chosen AS (SELECT h.author, coalesce((SELECT min(id) FROM authors a WHERE a.name = h.author), (SELECT min(id) FROM authors a WHERE a.normalized_name = h.author)) AS author_id FROM (SELECT DISTINCT author FROM hist) h),
readn AS (SELECT a.id AS author_id, (SELECT count(*) FROM books b WHERE b.author = a.normalized_name) + (SELECT count(*) FROM recommendations r WHERE r.already_read AND lower(r.author) = lower(a.name)) AS books_by_author_count FROM authors a),
eligible AS (SELECT * FROM catalog WHERE NOT is_read AND ({c2_reason('title')}) IS NULL),
cand AS (SELECT c.id AS catalog_id, c.author_id, c.title, a.name AS author, {score} AS similarity_score, 'You''ve {why} other books by ' || a.name AS reason, {CATS} AS categories,
  CASE WHEN length(description) > 200 THEN substr(description, 1, 200) || '...' ELSE description END AS description, n.books_by_author_count, nullif(c.series_name, '') AS series_name, nullif(c.series_position, 0) AS series_position
  FROM eligible c JOIN chosen ch ON ch.author_id = c.author_id JOIN authors a ON a.id = c.author_id JOIN readn n ON n.author_id = c.author_id
  WHERE lower(c.title) NOT IN (SELECT lower(title) FROM hist WHERE title IS NOT NULL))"""


JUDGED = f"""judged AS (
  SELECT c.*, a.name AS author, c.is_read OR EXISTS (SELECT 1 FROM recommendations r WHERE r.already_read AND {lt('r.title')} = {lt('c.title')} AND {lt('r.author')} = {lt('a.name')}) AS rd,
         EXISTS (SELECT 1 FROM recommendations r WHERE (r.thumbs_down OR r.duplicate OR r.non_english) AND {lt('r.title')} = {lt('c.title')} AND {lt('r.author')} = {lt('a.name')}) AS bad
  FROM catalog c JOIN authors a ON a.id = c.author_id WHERE c.series_name <> ''
), rolled AS (
  SELECT author_id, author, series_name, count(*) AS total_books, count(*) FILTER (rd) AS books_read, count(*) FILTER (NOT rd AND NOT bad) AS un,
         coalesce(string_agg(CASE WHEN NOT rd AND NOT bad THEN title END, '|' ORDER BY CASE WHEN coalesce(series_position, 0) = 0 THEN 999 ELSE series_position END, id), '') AS unread_titles
  FROM judged GROUP BY ALL
), series AS (
  SELECT author_id, author, series_name, total_books, books_read, books_read / total_books * 100 AS completion_pct,
         CASE WHEN books_read = 0 THEN 'not_started' WHEN un = 0 THEN 'complete' ELSE 'partial' END AS status, CAST(un AS INTEGER) AS unread, unread_titles
  FROM rolled WHERE books_read > 0 OR un > 0
)"""

STANDALONE = "SELECT c.id, a.name AS author, c.title FROM catalog c JOIN authors a ON a.id = c.author_id WHERE coalesce(c.series_name, '') = '' AND NOT c.is_read"

MATCH = f"""cm AS (SELECT c.id, c.isbn, {lt('c.title')} AS t, a.normalized_name AS author FROM catalog c JOIN authors a ON a.id = c.author_id),
bm AS (SELECT id, isbn, author, {lt('title')} AS t, lower(title) AS raw FROM books),
m AS (SELECT cm.id, (SELECT max(b.id) FROM bm b WHERE b.author = cm.author AND b.isbn = cm.isbn AND b.isbn <> '') AS m1, (SELECT max(b.id) FROM bm b WHERE b.author = cm.author AND b.t = cm.t) AS m2,
  (SELECT min(b.id) FROM bm b WHERE b.author = cm.author AND (contains(b.raw, cm.t) OR contains(cm.t, b.raw))) AS m3 FROM cm)"""


def _similar(a: str, b: str) -> str:
    return f"(length({a}) > 0 AND length({b}) > 0 AND 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) >= 0.85)"


def _since(x: str) -> str:
    sec = f"date_diff('second', {x}, TIMESTAMP '{NOW}')"
    d, h, mi = f"({sec} // 86400)", f"({sec} // 3600)", f"(({sec} % 3600) // 60)"
    ago = lambda n, u: f"CAST({n} AS VARCHAR) || ' {u}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END || ' ago'"
    return f"""CASE WHEN {x} IS NULL THEN 'Never' WHEN {d} < 1 AND {h} < 1 AND {mi} < 1 THEN 'Just now' WHEN {d} < 1 AND {h} < 1 THEN {ago(mi, 'minute')} WHEN {d} < 1 THEN CASE WHEN {h} = 1 THEN '1 hour ago' ELSE CAST({h} AS VARCHAR) || ' hours ago' END
      WHEN {d} = 1 THEN '1 day ago' WHEN {d} < 7 THEN CAST({d} AS VARCHAR) || ' days ago' WHEN {d} < 30 THEN {ago(f'({d} // 7)', 'week')} ELSE {ago(f'({d} // 30)', 'month')} END"""
