"""SQL for DuckDB of the duplicate groups (Q19-Q21): equal keys by windows, the greedy stars by recursion over an owner's
rows, one row a step, with lists of what is used and of who is in which group."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.classify import DUPLICATE_TAGS
from .oracle_text import C12, VISIBLE, _similar, f4, f5, gone, gone_all, has

#: A member of a group is kept as group * SPAN + place of the row.
SPAN = 1_000_000


def groups(rows: str, contained: bool) -> str:
    """CTEs from rw (owner, id, title, isbn, score), given as a query, to duplicates (owner, group_key, n, id, keep_id)."""
    none = "CAST([] AS BIGINT[])"
    base = f"""rw AS ({rows}),
ky AS (SELECT owner, id, score, {f4('title')} AS norm, lower({f5('title')}) AS base, regexp_replace(coalesce(isbn, ''), '[- ]', '', 'g') AS ik FROM rw),
g1 AS (SELECT *, CASE WHEN norm <> '' AND count(*) OVER (PARTITION BY owner, norm) > 1 THEN 'exact:' || norm END AS k1 FROM ky),
g2 AS (SELECT *, CASE WHEN k1 IS NULL AND base <> '' AND count(*) FILTER (k1 IS NULL) OVER (PARTITION BY owner, base) > 1 THEN 'base:' || base END AS k2 FROM g1),
g3 AS (SELECT *, CASE WHEN k1 IS NULL AND k2 IS NULL AND ik <> '' AND count(*) FILTER (k1 IS NULL AND k2 IS NULL) OVER (PARTITION BY owner, ik) > 1 THEN 'isbn:' || ik END AS k3 FROM g2),
ea AS MATERIALIZED (SELECT owner, id, score, norm, base, coalesce(k1, k2, k3) AS gk, CASE WHEN k1 IS NOT NULL THEN 1 WHEN k2 IS NOT NULL THEN 2 ELSE 3 END AS kind, row_number() OVER (PARTITION BY owner ORDER BY id) AS i FROM g3),
eg AS MATERIALIZED (SELECT owner, gk, row_number() OVER (PARTITION BY owner ORDER BY kind, min(id)) AS g FROM ea WHERE gk IS NOT NULL GROUP BY owner, gk, kind),
ne AS MATERIALIZED (SELECT owner, count(*) AS n FROM eg GROUP BY owner),
nb AS MATERIALIZED (SELECT a.owner, a.i, list(b.i ORDER BY b.i) AS js FROM ea a JOIN ea b ON a.owner = b.owner AND a.i < b.i
       WHERE ({_similar('a.norm', 'b.norm')} OR {_similar('a.base', 'b.base')}) AND coalesce(a.gk <> b.gk, true) GROUP BY a.owner, a.i),
fz AS (SELECT owner, CAST(0 AS BIGINT) AS i, {none} AS used, {none} AS star, max(i) AS last_i FROM ea GROUP BY owner
       UNION ALL
       SELECT owner, i + 1, CASE WHEN len(st) > 0 THEN list_concat(used, list_prepend(i + 1, st)) ELSE used END, st, last_i FROM (
         SELECT f.owner, f.i, f.used, f.last_i, CASE WHEN n.js IS NULL OR list_contains(f.used, f.i + 1) THEN {none} ELSE list_filter(n.js, lambda j: NOT list_contains(f.used, j)) END AS st
         FROM fz f LEFT JOIN nb n ON n.owner = f.owner AND n.i = f.i + 1 WHERE f.i < f.last_i)),
fs AS (SELECT owner, i, list_prepend(i, star) AS whole, row_number() OVER (PARTITION BY owner ORDER BY i) AS o FROM fz WHERE len(star) > 0),
m0 AS MATERIALIZED (SELECT ea.owner, eg.g, eg.gk, ea.i, row_number() OVER (PARTITION BY ea.owner, eg.g ORDER BY ea.i) AS place FROM ea JOIN eg ON ea.owner = eg.owner AND ea.gk = eg.gk
       UNION ALL
       SELECT owner, g, gk, unnest(whole) AS i, unnest(range(1, len(whole) + 1)) AS place FROM (
         SELECT fs.owner, coalesce(ne.n, 0) + fs.o AS g, 'fuzzy:' || CAST(ea.id AS VARCHAR) AS gk, fs.whole FROM fs JOIN ea ON ea.owner = fs.owner AND ea.i = fs.i LEFT JOIN ne ON ne.owner = fs.owner))"""
    every = "m0"
    if contained:
        every = "m1"
        base += f""",
cn AS MATERIALIZED (SELECT a.owner, a.i, list(b.i ORDER BY b.i) AS js FROM ea a JOIN ea b ON a.owner = b.owner AND a.i < b.i
       WHERE a.base <> '' AND b.base <> '' AND (a.base = b.base OR ((contains(a.base, b.base) OR contains(b.base, a.base)) AND abs(length(a.base) - length(b.base)) < 30 AND least(length(a.base), length(b.base)) >= 3)) GROUP BY a.owner, a.i),
ct AS (SELECT f.owner, CAST(0 AS BIGINT) AS i, f.last_i, f.used, coalesce(m.mem, {none}) AS mem, coalesce(m.top, 0) + 1 AS next_g, CAST(0 AS BIGINT) AS g, {none} AS adds, false AS fresh
       FROM fz f LEFT JOIN (SELECT owner, list(g * {SPAN} + i) AS mem, max(g) AS top FROM m0 GROUP BY owner) m ON m.owner = f.owner WHERE f.i = f.last_i
       UNION ALL
       SELECT owner, i + 1, last_i, list_concat(used, st), list_concat(mem, list_transform(ad, lambda j: to_g * {SPAN} + j)), CASE WHEN is_new THEN next_g + 1 ELSE next_g END, to_g, ad, is_new FROM (
         SELECT *, CASE WHEN len(st) = 0 THEN {none} ELSE list_filter(list_prepend(i + 1, st), lambda j: NOT list_contains(mem, to_g * {SPAN} + j)) END AS ad FROM (
           SELECT *, coalesce(touched, next_g) AS to_g, touched IS NULL AND len(st) > 0 AS is_new FROM (
             SELECT *, list_min(list_transform(list_filter(mem, lambda m: list_contains(list_prepend(i + 1, st), m % {SPAN})), lambda m: m // {SPAN})) AS touched FROM (
               SELECT *, CASE WHEN js IS NULL OR list_contains(used, i + 1) THEN {none} ELSE list_filter(js, lambda j: NOT list_contains(used, j) AND NOT list_contains(mates, j)) END AS st FROM (
                 SELECT *, list_transform(list_filter(mem, lambda m: list_contains(mine, m // {SPAN})), lambda m: m % {SPAN}) AS mates FROM (
                   SELECT c.owner, c.i, c.last_i, c.used, c.mem, c.next_g, n.js, list_transform(list_filter(c.mem, lambda m: m % {SPAN} = c.i + 1), lambda m: m // {SPAN}) AS mine
                   FROM ct c LEFT JOIN cn n ON n.owner = c.owner AND n.i = c.i + 1 WHERE c.i < c.last_i))))))),
m1 AS (SELECT * FROM m0
       UNION ALL
       SELECT x.owner, x.g, CASE WHEN x.is_own THEN 'contained:' || CAST(ea.id AS VARCHAR) ELSE k.gk END AS gk, x.j AS i, x.place FROM (
         SELECT owner, i, g, unnest(adds) AS j, 1000000 + i * 1000 + unnest(range(len(adds))) AS place, fresh AS is_own FROM ct WHERE len(adds) > 0) x
       JOIN ea ON ea.owner = x.owner AND ea.i = x.i
       LEFT JOIN (SELECT owner, g, any_value(gk) AS gk FROM (SELECT owner, g, gk FROM m0 UNION ALL SELECT ct.owner, ct.g, 'contained:' || CAST(ea.id AS VARCHAR) FROM ct JOIN ea ON ea.owner = ct.owner AND ea.i = ct.i WHERE ct.fresh) GROUP BY owner, g) k ON k.owner = x.owner AND k.g = x.g)"""
    return base + f""",
duplicates AS (SELECT m.owner, m.gk AS group_key, CAST(count(*) OVER (PARTITION BY m.owner, m.g) AS INTEGER) AS n, ea.id, first_value(ea.id) OVER (PARTITION BY m.owner, m.g ORDER BY ea.score DESC, m.place) AS keep_id
               FROM {every} m JOIN ea ON ea.owner = m.owner AND ea.i = m.i)"""


def reasons(k: str, o: str) -> str:
    """C13 between the rows k and o (title, isbn), as a list."""
    kt, ot = f"lower({k}.title)", f"lower({o}.title)"
    same_base = f"lower({f5(k + '.title')}) = lower({f5(o + '.title')})"
    differ = f"{k}.title <> {o}.title"
    volume = lambda x: f4(gone_all(x, *L.VOLUME))
    bare = lambda x, p: gone(x, p, flags="g")
    cases = (
        f"{f4(k + '.title')} = {f4(o + '.title')}",
        same_base,
        f"coalesce({k}.isbn, '') <> '' AND coalesce({o}.isbn, '') <> '' AND regexp_replace({k}.isbn, '[- ]', '', 'g') = regexp_replace({o}.isbn, '[- ]', '', 'g')",
        _similar(f4(k + ".title"), f4(o + ".title")),
        f"{bare(kt, L.APOSTROPHES)} = {bare(ot, L.APOSTROPHES)} AND {differ}",
        f"regexp_replace({kt}, '[^\\w\\s]', '', 'g') = regexp_replace({ot}, '[^\\w\\s]', '', 'g') AND {differ}",
        f"(contains({kt}, '(series') OR contains({ot}, '(series')) AND {same_base}",
        f"({has(kt, chr(92) + 'b(?:edition|ed' + chr(92) + '.)')} OR {has(ot, chr(92) + 'b(?:edition|ed' + chr(92) + '.)')}) AND {same_base}",
        f"({has(kt, chr(92) + 'b(?:volume|vol' + chr(92) + '.?)')} OR {has(ot, chr(92) + 'b(?:volume|vol' + chr(92) + '.?)')}) AND {volume(kt)} = {volume(ot)} AND {differ}",
    )
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in zip(DUPLICATE_TAGS, cases)) + "], lambda x: x IS NOT NULL)"


def recommendations(least: int) -> str:
    score = "CASE WHEN coalesce(isbn, '') <> '' THEN 10 ELSE 0 END + CASE WHEN NOT coalesce(duplicate, false) THEN 5 ELSE 0 END + CASE WHEN catalog_book_id IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(reason, '') <> '' THEN 2 ELSE 0 END"
    return f"SELECT author AS owner, id, title, isbn, {score} AS score FROM recommendations WHERE {VISIBLE} AND author IN (SELECT author FROM recommendations WHERE {VISIBLE} GROUP BY author HAVING count(*) >= {least})"


def catalog(least: int) -> str:
    score = C12.replace(" + CASE WHEN coalesce(google_books_id, '') <> '' THEN 2 ELSE 0 END", "")
    return f"SELECT author_id AS owner, id, title, isbn, {score} AS score FROM catalog WHERE author_id IN (SELECT author_id FROM catalog GROUP BY author_id HAVING count(*) >= {least})"


def explained(table: str) -> str:
    return f"SELECT d.owner, d.group_key, d.keep_id, d.id, {reasons('k', 'o')} AS why FROM duplicates d JOIN {table} k ON k.id = d.keep_id JOIN {table} o ON o.id = d.id WHERE d.id <> d.keep_id"


def texts() -> dict[str, tuple[str, str]]:
    counts = ", ".join(f"count(*) FILTER (list_contains(why, '{t}')) AS {t}" for t in DUPLICATE_TAGS)
    zeros = ", ".join(f"coalesce({t}, 0) AS {t}" for t in DUPLICATE_TAGS)
    return {
        "q19_recommendation_duplicates": (groups(recommendations(10), True), "SELECT * FROM duplicates"),
        "q20_catalog_duplicates": (groups(catalog(10), False), f"SELECT owner, group_key, keep_id, id, array_to_string(why, ',') AS reasons FROM ({explained('catalog')})"),
        "q21_recommendation_reasons": (groups(recommendations(10), True), f"SELECT owner, group_key, keep_id, id, array_to_string(why, ',') AS reasons FROM ({explained('recommendations')})"),
        "q21_prolific_report": (
            groups(recommendations(100), True),
            f"""SELECT a.owner, a.total_recommendations, coalesce(p.duplicate_groups, 0) AS duplicate_groups, coalesce(p.total_duplicates, 0) AS total_duplicates, {zeros}, 0 AS non_english_detected
            FROM (SELECT author AS owner, count(*) AS total_recommendations FROM recommendations WHERE {VISIBLE} GROUP BY author HAVING count(*) >= 100) a
            LEFT JOIN (SELECT owner, count(DISTINCT group_key) AS duplicate_groups, count(*) FILTER (id <> keep_id) AS total_duplicates FROM duplicates GROUP BY owner) p USING (owner)
            LEFT JOIN (SELECT owner, {counts} FROM ({explained('recommendations')}) GROUP BY owner) t USING (owner)""",
        ),
    }
