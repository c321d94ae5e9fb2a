"""SQL for DuckDB that gives the registered queries' rows, written against the shared views."""

from __future__ import annotations

from ..functions import lexicon as L
from . import oracle_groups, oracle_more
from .oracle_text import (
    _since, BAD, C12, CATS, F20, FICTION, JUDGED, MATCH, STANDALONE, _similar, c2_reason, c3, c4, c7, c8, c9, c10, candidates, f2, f3, f4, f5, f7, f8, f10, f15, gone, has, lt, parts_of, squeeze, strip,
)
from .views import shared_sql


def _texts() -> dict[str, str]:
    t = "title"
    name10, pos10 = f10(t)
    with_ = shared_sql()
    plain = {
        "f_title_keys": f"""SELECT id, {f2(t)} AS f2, {f3(t)} AS f3, {f4(t)} AS f4, {f5(t)} AS f5, {f7(t)} AS f7,
            coalesce(nullif(regexp_extract(title, '\\(([^)]+)\\)', 1), ''), regexp_extract(title, '\\[([^\\]]+)\\]', 1)) AS f6_series,
            coalesce(nullif(trim(regexp_replace(regexp_replace(title, '[/\\\\''"<>|:*?&]', '_', 'g'), '_+', '_', 'g'), '_ '), ''), 'empty') AS f12, array_to_string({f15(t)}, '+') AS f15 FROM catalog""",
        "f_series_and_dates": f"""SELECT id, {f8('series_name')} AS f8, {name10} AS f10_name, {pos10} AS f10_position, TRY_CAST(regexp_extract(coalesce(publication_date, ''), '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1) AS INTEGER) AS f17,
            CASE WHEN length(description) > 200 THEN substr(description, 1, 200) || '...' ELSE description END AS f23 FROM catalog""",
        "f_names": f"""SELECT id, {strip(gone(f"split_part({squeeze('name')}, ',', 1)", r'\s+et\s+al\.?$'))} AS f1, lower(regexp_replace(list_extract(p, 1), '\\W', '', 'g')) AS f13_first,
            CASE WHEN len(p) > 1 THEN lower(regexp_replace(list_extract(p, -1), '\\W', '', 'g')) ELSE '' END AS f13_last,
            CASE WHEN contains(name, ',') THEN array_to_string(list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: length(x) > 2), '+') END AS f14, {c9('name')} AS c9, {c10('name')} AS c10
            FROM (SELECT *, string_split({squeeze('name')}, ' ') AS p FROM authors)""",
        "f_since": f"SELECT id, {_since('borrowed_date')} AS f19 FROM books",
        "c_titles": f"SELECT id, ({c2_reason(t)}) IS NOT NULL AS c2, {c3(t)} AS c3, {c4(t)} AS c4, {c8(t)} AS c8, {FICTION} AS c11, {C12} AS c12, {F20} AS f20 FROM catalog",
        "c_childrens": f"SELECT id, {c7('title', 'series_name', 'categories', 'description')} AS c7 FROM catalog",
        "c_loan_format": f"SELECT CASE WHEN coalesce(publisher, '') = '' THEN 'unknown' WHEN {parts_of('lower(publisher)', L.AUDIO_PUBLISHERS)} THEN 'audiobook' ELSE 'ebook' END AS format, count(*) AS n FROM books GROUP BY 1",
        "q1_read_marks": f"""SELECT count(*) FILTER (hit AND NOT already_read) AS marked_as_read, count(*) FILTER (hit AND thumbs_up) AS removed_from_to_read
            FROM (SELECT r.*, EXISTS (SELECT 1 FROM books b WHERE {f2('b.title')} = {f2('r.title')} AND {lt('b.author')} = lower({strip("split_part(" + squeeze('r.author') + ", ',', 1)")}) AND b.title <> '' AND b.author <> '') AS hit FROM recommendations r)""",
        "q3_due_authors": f"""SELECT id, n AS catalog_books, d AS days_since, NOT (d < 7 AND n >= 1) AS due
            FROM (SELECT a.id, (SELECT count(*) FROM catalog c WHERE c.author_id = a.id) AS n, CASE WHEN a.id % 2 = 0 THEN a.id ELSE 999 END AS d FROM authors a)""",
        "q4_cleanup": f"SELECT id, title, 'title' AS cause FROM catalog WHERE {c3(t)}",
        "q5_duplicate_titles": f"""SELECT * FROM (SELECT 'catalog' AS "table", id, first_value(id) OVER (PARTITION BY author_id, {f3(t)} ORDER BY {C12} DESC, id) AS keep_id FROM catalog WHERE {f3(t)} <> '') WHERE id <> keep_id
            UNION ALL SELECT * FROM (SELECT 'books' AS "table", id, min(id) OVER (PARTITION BY {lt('author')}, {lt(t)}) AS keep_id FROM books WHERE {lt('author')} <> '' AND {lt(t)} <> '') WHERE id <> keep_id""",
        "q6_merge_authors": f"""SELECT author_id, count(*) AS n FROM (
              SELECT CASE WHEN author_id = 2 THEN 1 ELSE author_id END AS author_id FROM catalog c
              WHERE author_id <> 2 OR ({lt('c.title')} NOT IN (SELECT lower(title) FROM catalog WHERE author_id = 1) AND id = (SELECT min(id) FROM catalog d WHERE d.author_id = 2 AND {lt('d.title')} = {lt('c.title')}))) GROUP BY 1""",
        "q12_standalone": STANDALONE,
        "q16_books_to_read": """SELECT author, title, format, coalesce(similarity_score, 0.0) AS similarity_score, coalesce(isbn, '') AS isbn, coalesce(category, '') AS category, coalesce(reason, '') AS reason, id FROM recommendations r
            WHERE thumbs_up AND NOT already_read AND NOT duplicate AND NOT EXISTS (SELECT 1 FROM books b WHERE lower(b.title) = lower(r.title) AND lower(b.author) = lower(r.author))""",
        "q18_list_authors": "SELECT id, name, (SELECT count(*) FROM catalog c WHERE c.author_id = a.id) AS catalog_books, (SELECT count(*) FROM books b WHERE b.author = a.normalized_name) AS loans FROM authors a WHERE contains(lower(name), 'e') OR contains(lower(normalized_name), 'e')",
        "q20_similar_titles": f"""SELECT x.author_id AS owner, x.id AS a, y.id AS b FROM (SELECT author_id, id, {f4(t)} AS k FROM catalog) x JOIN (SELECT author_id, id, {f4(t)} AS k FROM catalog) y ON x.author_id = y.author_id AND x.id < y.id WHERE {_similar('x.k', 'y.k')}""",
        "q20_contained_titles": f"""SELECT x.author_id AS owner, x.id AS a, y.id AS b FROM (SELECT author_id, id, lower({f5(t)}) AS k FROM catalog) x JOIN (SELECT author_id, id, lower({f5(t)}) AS k FROM catalog) y ON x.author_id = y.author_id AND x.id < y.id
            WHERE x.k <> '' AND y.k <> '' AND (x.k = y.k OR ((contains(x.k, y.k) OR contains(y.k, x.k)) AND abs(length(x.k) - length(y.k)) < 30 AND least(length(x.k), length(y.k)) >= 3))""",
        "q24_extract_series": f"SELECT id, {name10} AS new_series, {pos10} AS new_position FROM catalog WHERE ({name10}) IS NOT NULL",
        "q25_consolidations": f"""SELECT author_id, k AS series_key, arg_min(series_name, (NOT contains(lower(series_name), 'series'), regexp_matches(series_name, '^[a-z]'), length(series_name), series_name)) AS canonical, string_agg(DISTINCT series_name, '|' ORDER BY series_name) AS variants, count(*) AS books,
            CASE WHEN count(p) <> count(DISTINCT p) OR (count(DISTINCT p) > 1 AND max(p) - min(p) + 1 = count(DISTINCT p)) THEN 'high' ELSE 'medium' END AS confidence
            FROM (SELECT *, {f8('series_name')} AS k, nullif(series_position, 0) AS p FROM catalog WHERE series_name IS NOT NULL) WHERE k <> '' GROUP BY author_id, k HAVING count(DISTINCT series_name) > 1""",
        "q27_childrens_books": f"SELECT id, author_id FROM catalog WHERE NOT is_read AND ({c2_reason(t)}) IS NULL AND {c7('title', 'series_name', 'categories', 'description')}",
        "q28_non_english": f"SELECT id, ({c2_reason(t)}) AS reasons FROM catalog WHERE ({c2_reason(t)}) IS NOT NULL",
        "q28_language_report": f"""SELECT author_id, count(*) AS books, count(*) - count({c2_reason(t)}) AS english, count({c2_reason(t)}) AS non_english, 100.0 * count({c2_reason(t)}) / count(*) AS non_english_pct FROM catalog GROUP BY 1 HAVING count(*) > 3""",
        "q29_publisher_authors": f"""SELECT id, name, CASE WHEN {c9('name')} THEN {c10('name')} ELSE 'Many books' END AS label, n AS catalog_books FROM (SELECT a.*, (SELECT count(*) FROM catalog c WHERE c.author_id = a.id) AS n FROM authors a) WHERE {c9('name')} OR n > 50""",
        "q29_remove_authors": """SELECT 'authors' AS "table", id FROM authors WHERE contains(lower(name), 'press') OR contains(lower(normalized_name), 'press')
            UNION ALL SELECT 'catalog', id FROM catalog WHERE author_id IN (SELECT id FROM authors WHERE contains(lower(name), 'press') OR contains(lower(normalized_name), 'press'))
            UNION ALL SELECT 'books', id FROM books WHERE author IN (SELECT normalized_name FROM authors WHERE contains(lower(name), 'press') OR contains(lower(normalized_name), 'press'))
            UNION ALL SELECT 'recommendations', id FROM recommendations WHERE lower(author) IN (SELECT lower(name) FROM authors WHERE contains(lower(name), 'press') OR contains(lower(normalized_name), 'press'))""",
        "q30_name_mismatches": f"""SELECT id, trim(split_part(name, ',', 1)) AS fixed_name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS overlap, n AS catalog_books
            FROM (SELECT id, name, list_distinct(string_split(lower({squeeze('name')}), ' ')) AS a, list_distinct(string_split(lower({squeeze('normalized_name')}), ' ')) AS b, (SELECT count(*) FROM catalog c WHERE c.author_id = x.id) AS n FROM authors x)
            WHERE n > 0 AND len(a) > 1 AND len(b) > 1 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) < 0.3""",
        "q31_reassign": """SELECT 'catalog' AS "table", id FROM catalog WHERE author_id = 3 UNION ALL SELECT 'books', id FROM books WHERE author = (SELECT normalized_name FROM authors WHERE id = 3)
            UNION ALL SELECT 'recommendations', id FROM recommendations WHERE lower(author) = (SELECT lower(name) FROM authors WHERE id = 3)""",
        "q32_filter_books": f"SELECT id FROM catalog WHERE {has(t, 'widget' + chr(92) + 'b')} OR {has(t, '^the' + chr(92) + 's')}",
        "q33_inspect": "SELECT 'books' AS what, count(*) AS n FROM books UNION ALL SELECT 'authors', count(*) FROM authors UNION ALL SELECT 'catalog', count(*) FROM catalog UNION ALL SELECT 'series', 0 UNION ALL SELECT 'recommendations', count(*) FROM recommendations UNION ALL SELECT 'metadata', 0 UNION ALL SELECT 'authors_with_catalog', count(DISTINCT author_id) FROM catalog",
        "q33_top_authors": "SELECT author_id, count(*) AS n, name FROM catalog c JOIN authors a ON a.id = c.author_id GROUP BY author_id, name ORDER BY n DESC, author_id LIMIT 10",
        "q34_feedback": f"""SELECT title, author, format, u AS thumbs_up, d AS thumbs_down, coalesce(ne, false) AS non_english, coalesce(ar, false) AS already_read, coalesce(du, false) AS duplicate FROM (
            SELECT arg_max(title, id) AS title, arg_max(author, id) AS author, format, arg_max(thumbs_up, id) FILTER (thumbs_up OR thumbs_down) AS u, arg_max(thumbs_down, id) FILTER (thumbs_up OR thumbs_down) AS d, max(true) FILTER (non_english) AS ne, max(true) FILTER (already_read) AS ar, max(true) FILTER (duplicate) AS du
            FROM recommendations WHERE thumbs_up OR thumbs_down OR non_english OR already_read OR duplicate GROUP BY {lt('title')}, {lt('author')}, format)""",
        "q34_feedback_stream": f"""SELECT title, author, format, u AS thumbs_up, d AS thumbs_down, coalesce(ne, false) AS non_english, coalesce(ar, false) AS already_read, coalesce(du, false) AS duplicate FROM (
            SELECT arg_max(title, id) AS title, arg_max(author, id) AS author, format, arg_max(thumbs_up, id) FILTER (thumbs_up OR thumbs_down) AS u, arg_max(thumbs_down, id) FILTER (thumbs_up OR thumbs_down) AS d, max(true) FILTER (non_english) AS ne, max(true) FILTER (already_read) AS ar, max(true) FILTER (duplicate) AS du
            FROM recommendations WHERE thumbs_up OR thumbs_down OR non_english OR already_read OR duplicate GROUP BY {lt('title')}, {lt('author')}, format)""",
        "q34_feedback_onto_rows": f"""SELECT r.id, u AS thumbs_up, d AS thumbs_down, ne AS non_english, ar AS already_read, du AS duplicate FROM recommendations r LEFT JOIN (
            SELECT f.id, e.* FROM (SELECT {lt('title')} AS t, {lt('author')} AS a, format, min(id) AS id FROM recommendations GROUP BY ALL) f JOIN (
              SELECT {lt('title')} AS t, {lt('author')} AS a, format, arg_max(thumbs_up, id) FILTER (thumbs_up OR thumbs_down) AS u, arg_max(thumbs_down, id) FILTER (thumbs_up OR thumbs_down) AS d, max(true) FILTER (non_english) AS ne, max(true) FILTER (already_read) AS ar, max(true) FILTER (duplicate) AS du
              FROM recommendations WHERE thumbs_up OR thumbs_down OR non_english OR already_read OR duplicate GROUP BY ALL) e USING (t, a, format)) x ON x.id = r.id""",
        "q34_unhide_authors": f"SELECT id, {lt('name')} NOT IN (SELECT {lt('name')} FROM authors WHERE id % 2 = 0) AS hidden FROM authors",
        "q34_hide_authors": "SELECT true AS hidden, count(*) AS n FROM authors",
        "q34_recategorize": f"""SELECT id, categories AS old_categories, {F20} AS new_categories FROM (SELECT c.*, row_number() OVER (PARTITION BY {lt('c.title')}, {lt('a.name')} ORDER BY c.id) AS rn FROM catalog c JOIN authors a ON a.id = c.author_id) WHERE rn = 1""",
        "q9_mixed_identities": "SELECT author_id, '/authors/OL' || CAST(id % 3 AS VARCHAR) || 'A' AS author_key, count(*) AS books FROM catalog WHERE open_library_key IS NOT NULL AND author_id IN (SELECT author_id FROM catalog WHERE open_library_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id % 3) > 1) GROUP BY ALL",
        "q23_audit": f"""SELECT id, {C12} AS score, count(*) OVER (PARTITION BY author_id, {f3(t)}) AS same_title, count(*) OVER (PARTITION BY author_id, {f7(t)}) AS near_title, {c4(t)} AS non_english FROM catalog""",
    }
    chained = {
        "q2_match_history": (MATCH, "SELECT id, coalesce(m1, m2, m3) IS NOT NULL AS is_read, coalesce(m1, m2, m3) AS matched_book_id FROM m"),
        "q11_series": (JUDGED, "SELECT * FROM series"),
        "q11_series_kept_up": (JUDGED, "SELECT author_id, author, series_name, total_books, books_read, completion_pct, status, unread FROM series"),
        "q11_series_summary": (JUDGED, f"SELECT count(*) AS total_series, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'not_started') AS not_started, (SELECT count(*) FROM ({STANDALONE})) AS standalone FROM series"),
        "q17_status": (JUDGED, f"""SELECT (SELECT count(*) FROM books) AS books, (SELECT count(*) FROM books WHERE format = 'audiobook') AS audiobooks, (SELECT count(*) FROM books WHERE format = 'ebook') AS ebooks, (SELECT count(*) FROM authors) AS authors,
            (SELECT count(*) FROM catalog) AS catalog_books, (SELECT count(*) FROM recommendations) AS recommendations, count(*) AS total_series, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'partial') AS partial,
            count(*) FILTER (status = 'not_started') AS not_started, (SELECT count(*) FROM ({STANDALONE})) AS standalone FROM series"""),
        "q13_audiobooks": (candidates("audiobook"), "SELECT catalog_id, title, author, similarity_score, reason, books_by_author_count, series_name, series_position FROM cand"),
        "q14_new_books": (candidates("ebook"), "SELECT catalog_id, title, author, unnest(CASE WHEN len(categories) > 0 THEN categories ELSE ['Uncategorized'] END) AS category, description, books_by_author_count FROM cand"),
        "q14_by_category": (candidates("ebook"), f"""SELECT CASE WHEN len(list_filter(categories, lambda c: {parts_of('lower(c)', L.NON_FICTION)})) = 0 THEN 'Fiction' ELSE 'Non-Fiction' END AS kind, coalesce(categories[1], 'Uncategorized') AS primary_category, count(*) AS n,
            string_agg(CAST(books_by_author_count AS VARCHAR), ',' ORDER BY books_by_author_count DESC) AS counts FROM cand GROUP BY 1, 2"""),
        "q14_first_of_categories": (candidates("ebook"), f"""SELECT kind, primary_category, CAST(rank AS INTEGER) AS rank, catalog_id, title FROM (
            SELECT *, row_number() OVER (PARTITION BY kind, primary_category ORDER BY books_by_author_count DESC, author, title, catalog_id) AS rank FROM (
              SELECT *, CASE WHEN len(list_filter(categories, lambda c: {parts_of('lower(c)', L.NON_FICTION)})) = 0 THEN 'Fiction' ELSE 'Non-Fiction' END AS kind, coalesce(categories[1], 'Uncategorized') AS primary_category FROM cand)) WHERE rank <= 10"""),
        "q15_recommendations": (candidates("ebook"), f"""SELECT catalog_id, title, author, unnest(CASE WHEN len(categories) > 0 THEN categories ELSE ['Uncategorized'] END) AS category, similarity_score,
            EXISTS (SELECT 1 FROM recommendations r WHERE r.format = 'ebook' AND r.thumbs_up AND {lt('r.title')} = {lt('cand.title')} AND {lt('r.author')} = {lt('cand.author')}) AS thumbs_up FROM cand
            WHERE NOT EXISTS (SELECT 1 FROM recommendations r WHERE r.format = 'ebook' AND {BAD} AND {lt('r.title')} = {lt('cand.title')} AND {lt('r.author')} = {lt('cand.author')})
            AND {lt('author')} NOT IN (SELECT {lt('name')} FROM authors WHERE hidden)"""),
        "q15_hidden_authors": (candidates("ebook"), f"SELECT author, count(*) AS n, string_agg(title, '|' ORDER BY title) AS titles FROM cand WHERE {lt('author')} IN (SELECT {lt('name')} FROM authors WHERE hidden) GROUP BY author"),
        "q7_duplicate_authors": (
            f"""pa AS (SELECT id, name, open_library_id AS k, lower(regexp_replace(p[1], '\\W', '', 'g')) AS f, CASE WHEN len(p) > 1 THEN lower(regexp_replace(p[-1], '\\W', '', 'g')) ELSE '' END AS l FROM (SELECT *, string_split({squeeze('name')}, ' ') AS p FROM authors)),
            tt AS (SELECT DISTINCT author_id, {lt('title')} AS t FROM catalog), one AS (SELECT * FROM pa JOIN tt ON pa.id = tt.author_id WHERE f <> '' AND l <> '')""",
            """SELECT x.id AS id1, x.name AS name1, y.id AS id2, y.name AS name2, count(*) AS overlap, array_to_string(list_slice(list(x.t ORDER BY x.t), 1, 5), '|') AS sample_titles,
            CASE WHEN coalesce(x.k = y.k, false) OR count(*) >= 3 OR x.k IS NOT NULL OR y.k IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN coalesce(x.k = y.k, false) THEN 'same_open_library_id' ELSE 'name_match_with_overlapping_books' END AS reason
            FROM one x JOIN one y ON x.f = y.f AND x.l = y.l AND x.t = y.t AND x.id < y.id GROUP BY x.id, x.name, y.id, y.name, x.k, y.k""",
        ),
        "q1_ingest": (
            f"""lo AS (SELECT id, {squeeze('title')} AS title, {strip("split_part(" + squeeze("author") + ", ',', 1)")} AS author, isbn, publisher, borrowed_date FROM books),
            g1 AS (SELECT *, min(id) OVER (PARTITION BY coalesce(isbn, 'x' || CAST(id AS VARCHAR))) AS a FROM lo), g2 AS (SELECT *, min(id) OVER (PARTITION BY title, author) AS b FROM g1 WHERE a = id)""",
            f"""SELECT row_number() OVER (ORDER BY id) AS id, title, author, isbn, CASE WHEN coalesce(publisher, '') = '' THEN 'unknown' WHEN {parts_of('lower(publisher)', L.AUDIO_PUBLISHERS)} THEN 'audiobook' ELSE 'ebook' END AS format, borrowed_date FROM g2 WHERE b = id""",
        ),
        "q10_split_groups": (
            f"""gr AS (SELECT id AS group_id, normalized_name AS gn, list_filter(list_transform(string_split(name, ','), lambda x: trim(x)), lambda x: length(x) > 2) AS members FROM authors WHERE contains(name, ',')),
            ev AS (SELECT 'catalog' AS "table", c.id, {lt('c.title')} AS t, group_id, members FROM catalog c JOIN gr ON c.author_id = gr.group_id UNION ALL SELECT 'books', b.id, {lt('b.title')}, group_id, members FROM books b JOIN gr ON b.author = gr.gn)""",
            """SELECT "table", id, group_id, coalesce(hit, members[1]) AS member, CASE WHEN hit IS NOT NULL THEN 'last_name' ELSE 'first' END AS how
            FROM (SELECT *, list_filter(members, lambda m: contains(t, lower(string_split(m, ' ')[-1])))[1] AS hit FROM ev)""",
        ),
    }
    out = {k: f"{with_} {v}" for k, v in plain.items()}
    out |= {k: f"{with_}, {a} {b}" for k, (a, b) in (chained | oracle_more.texts()).items()}
    recursive = with_.replace("WITH", "WITH RECURSIVE", 1)
    return out | {k: f"{recursive}, {a} {b}" for k, (a, b) in oracle_groups.texts().items()}


def oracle_sql() -> dict[str, str]:
    return _texts()
