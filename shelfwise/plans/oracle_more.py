"""SQL for DuckDB of the queries about sources, fetching, fixing and approving: (CTEs, query) by name."""

from __future__ import annotations

from ..functions import lexicon as L
from .documents import EDITION_FIELDS, WORK_FIELDS
from .oracle_text import C12, CATS, c2_reason, c3, c4_reasons, c7, c8, c9, candidates, f3, f4, f5, f10, f15, lt, parts_of, squeeze, strip

ENGLISH = "coalesce({} = '/languages/eng', true)"
_SERIES = f"CASE WHEN w.series <> '' THEN w.series ELSE {f10('w.title')[0]} END AS series_name, CASE WHEN w.series <> '' THEN w.series_position ELSE {f10('w.title')[1]} END AS series_position"
FORMAT = f"CASE WHEN coalesce(publisher, '') = '' THEN 'unknown' WHEN {parts_of('lower(publisher)', L.AUDIO_PUBLISHERS)} THEN 'audiobook' ELSE 'ebook' END"
FIRST_NAME = strip("split_part(" + squeeze("author") + ", ',', 1)")
DOUBLES = f"dt AS (SELECT * FROM (SELECT id, author_id, first_value(id) OVER (PARTITION BY author_id, {f3('title')} ORDER BY {C12} DESC, id) AS keep_id FROM catalog WHERE {f3('title')} <> '') WHERE id <> keep_id)"
CHILDREN = f"ch AS (SELECT id, author_id, CAST(row_number() OVER (ORDER BY author_id, id) AS INTEGER) AS number FROM catalog WHERE NOT is_read AND ({c2_reason('title')}) IS NULL AND {c7('title', 'series_name', 'categories', 'description')})"

#: Q2: the works that enter a catalog.
PICKED = f"""w AS ({WORK_FIELDS}), e AS ({EDITION_FIELDS}),
pe AS (SELECT key, min(k) FILTER ({ENGLISH.format('language')}) AS k FROM e GROUP BY key),
pw AS (SELECT w.author_id, w.key, w.title, coalesce(x.isbn_13, x.isbn_10, w.isbn_13, w.isbn_10) AS isbn, coalesce(x.publish_date, w.first_publish_date, w.first_publish_year) AS publication_date, {_SERIES}
       FROM w LEFT JOIN pe ON pe.key = w.key LEFT JOIN e x ON x.key = w.key AND x.k = pe.k
       WHERE w.title <> '' AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c.author_id = w.author_id AND c.open_library_key = w.key) AND (pe.k IS NOT NULL OR {ENGLISH.format('w.language')}))"""

#: Q26: of each part of a composite the best standalone row and ten times its score.
PARTS = f"""el AS (SELECT *, count(*) OVER (PARTITION BY author_id) AS cnt FROM catalog WHERE NOT is_read AND ({c2_reason('title')}) IS NULL), ee AS (SELECT *, {c8('title')} AS comp FROM el WHERE cnt > 1),
wh AS (SELECT id, author_id, {f15('title')} AS parts FROM ee WHERE comp), pt AS (SELECT id, author_id, unnest(range(1, len(parts) + 1)) AS pos, parts FROM wh),
sg AS (SELECT id, author_id, lower(title) AS sl, {f4('title')} AS sn, lower({f5('title')}) AS sb FROM ee WHERE NOT comp),
sc AS (SELECT p.id, p.pos, s.id AS sid, CASE WHEN pn <> '' AND pn = sn THEN 10 WHEN pb <> '' AND pb = sb THEN 8 WHEN contains(sl, pl) OR contains(pl, sl) THEN 7 END AS score
       FROM (SELECT id, author_id, pos, lower(parts[pos]) AS pl, {f4('parts[pos]')} AS pn, lower({f5('parts[pos]')}) AS pb FROM pt) p JOIN sg s ON s.author_id = p.author_id),
mt AS (SELECT id, pos, arg_min(sid, (-score, sid)) AS sid, max(score) AS score FROM sc WHERE score IS NOT NULL GROUP BY id, pos)"""

SAVED = f"""{candidates('ebook')}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, author ORDER BY similarity_score DESC, catalog_id) AS rn FROM cand) WHERE rn = 1),
fi AS (SELECT title, author, min(id) AS id FROM recommendations GROUP BY title, author),
fr AS (SELECT *, (SELECT max(id) FROM recommendations) + row_number() OVER (ORDER BY author, title) AS id FROM k WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.title = k.title AND fi.author = k.author))"""

IDENTITIES = f"""mx AS (SELECT author_id, ak, count(*) AS books FROM (SELECT author_id, '/authors/OL' || CAST(id % 3 AS VARCHAR) || 'A' AS ak FROM catalog WHERE open_library_key IS NOT NULL) GROUP BY ALL),
mm AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY author_id) AS k FROM mx) WHERE k > 1),
ln AS (SELECT DISTINCT author AS nn, {lt('title')} AS t FROM books),
ct AS (SELECT id, author_id, open_library_key, '/authors/OL' || CAST(id % 3 AS VARCHAR) || 'A' AS ak, {lt('title')} AS t FROM catalog),
pts AS (SELECT m.author_id, m.ak, m.books, a.name AS own, 10 * (SELECT count(*) FROM ct JOIN ln ON ln.t = ct.t WHERE ln.nn = a.normalized_name AND ct.ak = m.ak)
        + 5 * (SELECT count(*) FROM ct JOIN ln ON ln.t = ct.t WHERE ln.nn = a.normalized_name AND ct.ak = m.ak AND ct.author_id = m.author_id AND ct.open_library_key IS NOT NULL) AS score FROM mm m JOIN authors a ON a.id = m.author_id),
ot AS (SELECT *, CASE ak WHEN '/authors/OL1A' THEN 'Outside One' WHEN '/authors/OL2A' THEN 'Outside Two' ELSE own END AS target FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY score DESC, books DESC, ak) AS r FROM pts) WHERE r > 1),
pl AS (SELECT *, coalesce((SELECT min(id) FROM authors a WHERE a.open_library_id = ot.ak), (SELECT min(id) FROM authors a WHERE a.name = ot.target)) AS known FROM ot),
nw AS (SELECT target, (SELECT max(id) FROM authors) + row_number() OVER (ORDER BY target, min(ak)) AS id FROM pl WHERE known IS NULL GROUP BY target)"""

NAMES = f"""fa AS (SELECT id, string_split(name, ' ')[1] AS nn FROM authors), many AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY nn) AS k FROM fa) WHERE k > 1),
ln AS (SELECT DISTINCT string_split(a.name, ' ')[1] AS nn, {lt('b.title')} AS t FROM books b JOIN authors a ON a.normalized_name = b.author),
rr AS (SELECT c.id, c.author_id, m.nn, {lt('c.title')} AS t FROM catalog c JOIN many m ON m.id = c.author_id),
sc AS (SELECT author_id, nn, 5 * count(*) AS score FROM rr WHERE EXISTS (SELECT 1 FROM ln WHERE ln.nn = rr.nn AND ln.t = rr.t) GROUP BY author_id, nn),
bs AS (SELECT nn, arg_min(author_id, (-score, author_id)) AS to_id FROM sc GROUP BY nn),
mv AS (SELECT rr.*, bs.to_id FROM rr JOIN bs ON bs.nn = rr.nn WHERE rr.author_id <> bs.to_id)"""

MERGED = f"""st AS (SELECT a.*, (SELECT count(*) FROM catalog c WHERE c.author_id = a.id) AS n FROM authors a WHERE id IN (3, 4)),
kp AS (SELECT arg_min(id, (-n, CASE WHEN open_library_id IS NOT NULL THEN 0 ELSE 1 END, id)) AS keep_id, arg_max(id, (-n, CASE WHEN open_library_id IS NOT NULL THEN 0 ELSE 1 END, id)) AS remove_id FROM st),
kc AS (SELECT lower(title) AS t FROM catalog, kp WHERE author_id = keep_id), kn AS (SELECT normalized_name AS nn FROM authors, kp WHERE id = keep_id), rn AS (SELECT normalized_name AS nn FROM authors, kp WHERE id = remove_id),
kb AS (SELECT {lt('title')} AS t, isbn FROM books WHERE author IN (SELECT nn FROM kn))"""


def texts() -> dict[str, tuple[str, str]]:
    year = "TRY_CAST(regexp_extract(coalesce(publication_date, ''), '\\b(19\\d{2}|20\\d{2})\\b', 1) AS INTEGER)"
    doubled = "SELECT author_id, CAST(keep_id AS VARCHAR) AS group_key, keep_id, id AS remove_id, 'exact_normalized' AS reasons FROM dt"
    part_of = lambda n: f"CASE WHEN name = '{n}' THEN 1 WHEN lower(name) = '{n.lower()}' THEN 2 WHEN lower(normalized_name) = '{n.lower()}' THEN 3 WHEN contains(lower(name), '{n.lower()}') THEN 4 END"
    one = lambda n: f"SELECT '{n}' AS who, arg_min(id, (r, id)) AS id FROM (SELECT id, {part_of(n)} AS r FROM authors) WHERE r IS NOT NULL HAVING count(*) > 0"
    return {
        "s1_loans": (
            "nothing AS (SELECT 1)",
            f"""SELECT {strip("title || ', \"vol\"'")} AS title, {FIRST_NAME} AS author, isbn, publisher, {FORMAT} AS format, borrowed_date FROM books WHERE id % 9 <> 0""",
        ),
        "s4_author_search": (
            f"""f AS (SELECT author, author_key, min(rank) AS rank FROM (SELECT normalized_name AS author, '/authors/OL' || CAST(id + 1 AS VARCHAR) || 'A' AS author_key, 0 AS rank FROM authors UNION ALL SELECT normalized_name, '/authors/OL' || CAST(id AS VARCHAR) || 'A', 1 FROM authors) GROUP BY author, author_key),
            h AS (SELECT f.*, EXISTS (SELECT 1 FROM catalog c JOIN books b ON {lt('b.title')} = {lt('c.title')} WHERE c.id % 40 < 20 AND '/authors/OL' || CAST(c.author_id AS VARCHAR) || 'A' = f.author_key AND b.author = f.author) AS sure FROM f)""",
            "SELECT author, arg_min(author_key, (NOT sure, rank, author_key)) AS author_key, bool_or(sure) AS certain FROM h GROUP BY author",
        ),
        "s6_works": (
            f"w AS ({WORK_FIELDS})",
            f"SELECT author_id, key, title, {_SERIES}, coalesce(isbn_13, isbn_10) AS isbn, coalesce(first_publish_date, first_publish_year) AS publication_date, coalesce(language, '') AS languages, '/authors/' || author_key AS author_keys FROM w",
        ),
        "s6_editions": (f"e AS ({EDITION_FIELDS})", "SELECT key, CAST(k AS INTEGER) AS pos, title, coalesce(language, '') AS languages, coalesce(isbn_13, isbn_10) AS isbn, publish_date AS publication_date FROM e"),
        "s7_volumes": (
            "nothing AS (SELECT 1)",
            "SELECT CAST(id AS VARCHAR) AS key, 0 AS pos, CAST(id AS VARCHAR) AS google_books_id, CASE WHEN id % 3 = 0 THEN title END AS series_name, CASE WHEN id % 3 = 0 THEN CAST(id % 9 AS INTEGER) END AS series_position, id % 4 <> 0 AS english FROM catalog",
        ),
        "s10_report": (DOUBLES, doubled),
        "c6_editions_english": (
            f"w AS ({WORK_FIELDS}), e AS ({EDITION_FIELDS}), en AS (SELECT e.id, bool_or({ENGLISH.format('e.language')} OR {ENGLISH.format('w.language')}) AS ok FROM e JOIN w ON w.key = e.key GROUP BY e.id)",
            f"SELECT c.id, CASE WHEN {c3('c.title')} THEN 'title' ELSE 'editions' END AS cause FROM catalog c LEFT JOIN en ON en.id = c.id WHERE {c3('c.title')} OR NOT coalesce(en.ok, true)",
        ),
        "q2_pick_works": (PICKED, f"SELECT author_id, key, title, isbn, publication_date FROM pw WHERE author_id NOT IN (SELECT author_id FROM catalog) OR {year} IS NULL OR {year} >= 1996"),
        "q2_fetch_catalog": (
            f"""{PICKED}, cl AS (SELECT id, author_id, isbn, {lt('title')} AS t FROM catalog),
            own AS (SELECT pw.*, coalesce((SELECT min(id) FROM cl WHERE cl.author_id = pw.author_id AND cl.t = {lt('pw.title')}), (SELECT min(id) FROM cl WHERE cl.author_id = pw.author_id AND cl.isbn = pw.isbn AND cl.isbn <> '')) AS id FROM pw),
            up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY key) AS r FROM own WHERE id IS NOT NULL) WHERE r = 1),
            ad AS (SELECT * FROM own WHERE id IS NULL AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.t = {lt('own.title')}) AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.isbn = own.isbn AND cl.isbn <> ''))""",
            """SELECT c.id, c.author_id, u.key AS open_library_key, c.title, coalesce(u.isbn, c.isbn) AS isbn, coalesce(u.publication_date, c.publication_date) AS publication_date, coalesce(u.series_name, c.series_name) AS series_name, coalesce(u.series_position, c.series_position) AS series_position FROM catalog c JOIN up u ON u.id = c.id
            UNION ALL SELECT (SELECT max(id) FROM catalog) + row_number() OVER (ORDER BY author_id, key), author_id, key, title, isbn, publication_date, series_name, series_position FROM ad""",
        ),
        "q8_fix_identities": (IDENTITIES, "SELECT pl.author_id, pl.ak AS author_key, pl.score, coalesce(pl.known, nw.id) AS to_id, pl.target, CAST(pl.books AS INTEGER) AS n FROM pl LEFT JOIN nw ON nw.target = pl.target"),
        "q8_fix_names": (NAMES, "SELECT author_id, to_id, id, CASE WHEN EXISTS (SELECT 1 FROM rr o WHERE o.author_id = mv.to_id AND o.t = mv.t) OR again > 1 THEN 'delete' ELSE 'move' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY to_id, t ORDER BY id) AS again FROM mv) mv"),
        "q22_approve": (DOUBLES, "SELECT DISTINCT id AS remove_id, CAST(keep_id AS VARCHAR) AS group_key, author_id FROM dt WHERE author_id IN (3, 6) OR keep_id IN (11, 12)"),
        "q22_approved_state": (DOUBLES, 'SELECT count(*) AS "rows", count(*) FILTER (duplicate OR catalog_book_id IN (SELECT id FROM dt)) AS flagged, (SELECT count(*) FROM catalog WHERE id NOT IN (SELECT id FROM dt)) AS "left" FROM recommendations'),
        "q27_numbered": (CHILDREN, "SELECT * FROM ch"),
        "q27_kept": (CHILDREN, "SELECT id FROM catalog WHERE id NOT IN (SELECT id FROM ch WHERE number NOT IN (1, 2, 3))"),
        "q28_verify_all": (f"sl AS (SELECT {c3('title')} AS bad FROM catalog)", "SELECT count(*) AS checked, count(*) FILTER (bad) AS flagged, CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (bad) / count(*) ELSE 0.0 END AS flagged_pct FROM sl"),
        "q28_verify_cleanup": (f"sl AS (SELECT {c3('title')} AS bad FROM (SELECT * FROM catalog ORDER BY id LIMIT 1000 OFFSET 50))", "SELECT count(*) AS checked, count(*) FILTER (bad) AS flagged, CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (bad) / count(*) ELSE 0.0 END AS flagged_pct FROM sl"),
        "q28_reason_histogram": ("nothing AS (SELECT 1)", f"SELECT tag, count(*) AS n FROM (SELECT unnest({c4_reasons('title')}) AS tag FROM catalog) GROUP BY tag"),
        "q1_ingest_authors": (
            f"""lo AS (SELECT id, {squeeze('title')} AS title, author || ', Else Who' AS raw, {FIRST_NAME} AS author, isbn FROM books),
            h1 AS (SELECT *, min(id) OVER (PARTITION BY coalesce(isbn, 'x' || CAST(id AS VARCHAR))) AS a FROM lo), h2 AS (SELECT *, min(id) OVER (PARTITION BY title, author) AS b FROM h1 WHERE a = id)""",
            "SELECT row_number() OVER (ORDER BY min(id)) AS id, arg_min(raw, id) AS name, author AS normalized_name FROM h2 WHERE b = id GROUP BY author",
        ),
        "d4_metadata": ("nothing AS (SELECT 1)", "SELECT CAST(id AS BIGINT) AS id, key, value FROM (VALUES (1, 'a', '3'), (2, 'b', '2')) AS m(id, key, value)"),
        "d13_conformed": ("nothing AS (SELECT 1)", "SELECT id, name, CAST(NULL AS VARCHAR) AS normalized_name, false AS hidden FROM authors"),
        "p4_resolved": ("nothing AS (SELECT 1)", " UNION ALL ".join(one(n) for n in ("Karen B. Eason", "karen b. eason", "someone else 7", "eason", "nobody"))),
        "p11_category": (candidates("ebook"), "SELECT catalog_id FROM cand WHERE len(list_filter(categories, lambda c: lower(c) = 'history')) > 0"),
        "a5_author_chunk": ("nothing AS (SELECT 1)", "SELECT DISTINCT author_id FROM catalog ORDER BY author_id LIMIT 10 OFFSET 5"),
        "a12_subtotals": ("nothing AS (SELECT 1)", f"SELECT author_id, tag, count(*) AS n, CAST(bit_count(GROUPING_ID(author_id, tag)) AS INTEGER) AS level FROM (SELECT author_id, unnest({CATS}) AS tag FROM catalog) GROUP BY ROLLUP (author_id, tag)"),
        "a18_subtotals": ("nothing AS (SELECT 1)", f"SELECT author_id, tag, count(*) AS n, CAST(bit_count(GROUPING_ID(author_id, tag)) AS INTEGER) AS level FROM (SELECT author_id, unnest({c4_reasons('title')}) AS tag FROM catalog) GROUP BY ROLLUP (author_id, tag)"),
        "d4_table_counts": (
            "counted AS (SELECT 'books' AS key, count(*) AS n FROM books UNION ALL SELECT 'authors', count(*) FROM authors UNION ALL SELECT 'catalog', count(*) FROM catalog UNION ALL SELECT 'series', 0 UNION ALL SELECT 'recommendations', count(*) FROM recommendations UNION ALL SELECT 'metadata', 0 UNION ALL SELECT 'authors_with_catalog', count(DISTINCT author_id) FROM catalog)",
            "SELECT row_number() OVER (ORDER BY key >= 'c', key) AS id, key, CAST(n AS VARCHAR) AS value FROM counted",
        ),
        "a12_histogram": ("nothing AS (SELECT 1)", f"SELECT tag, count(*) AS n FROM (SELECT unnest({CATS}) AS tag FROM catalog) GROUP BY tag ORDER BY n DESC, tag LIMIT 10"),
        "a13_shares": ("nothing AS (SELECT 1)", "SELECT format, n, 100.0 * n / CAST(sum(n) OVER () AS BIGINT) AS pct FROM (SELECT format, count(*) AS n FROM books GROUP BY format)"),
        "o1_slice": ("nothing AS (SELECT 1)", f"SELECT id, title, 'title' AS cause FROM (SELECT * FROM catalog ORDER BY id LIMIT 100 OFFSET 30) WHERE {c3('title')}"),
        "o4_first_recommendations": (candidates("audiobook"), "SELECT catalog_id FROM cand ORDER BY similarity_score DESC, author, title, catalog_id LIMIT 20"),
        "q29_samples": (
            "nothing AS (SELECT 1)",
            f"SELECT a.id, coalesce(array_to_string((SELECT list(title ORDER BY title) FROM catalog c WHERE c.author_id = a.id)[1:5], '|'), '') AS samples FROM authors a WHERE {c9('a.name')} OR (SELECT count(*) FROM catalog c WHERE c.author_id = a.id) > 50",
        ),
        "q6_merge_plan": (
            MERGED,
            f"""SELECT keep_id, remove_id, 'catalog' AS "table", id, CASE WHEN EXISTS (SELECT 1 FROM kc WHERE kc.t = x.t) OR again > 1 THEN 'delete' ELSE 'move' END AS action
              FROM (SELECT c.id, {lt('c.title')} AS t, row_number() OVER (PARTITION BY {lt('c.title')} ORDER BY c.id) AS again FROM catalog c, kp WHERE c.author_id = kp.remove_id) x, kp
            UNION ALL SELECT keep_id, remove_id, 'books', id, CASE WHEN EXISTS (SELECT 1 FROM kb WHERE kb.t = x.t OR (kb.isbn = x.isbn AND x.isbn <> '')) OR t1 > 1 OR (x.isbn <> '' AND t2 > 1) THEN 'delete' ELSE 'move' END
              FROM (SELECT id, isbn, {lt('title')} AS t, row_number() OVER (PARTITION BY {lt('title')} ORDER BY id) AS t1, row_number() OVER (PARTITION BY isbn ORDER BY id) AS t2 FROM books WHERE author IN (SELECT nn FROM rn)) x, kp WHERE (SELECT nn FROM kn) <> (SELECT nn FROM rn)""",
        ),
        "q26_composites": (
            PARTS,
            """SELECT wh.id AS composite_id, CASE WHEN len(parts) > 0 AND coalesce(k, 0) = len(parts) THEN 'high' WHEN coalesce(k, 0) > 0 THEN 'medium' ELSE 'low' END AS confidence, CAST(len(parts) AS INTEGER) AS n_parts, coalesce(found, '') AS found
            FROM wh LEFT JOIN (SELECT id, count(*) AS k, string_agg(CAST(pos - 1 AS VARCHAR) || ':' || CAST(sid AS VARCHAR) || ':' || CAST(score AS VARCHAR), '|' ORDER BY pos) AS found FROM mt GROUP BY id) m ON m.id = wh.id""",
        ),
        "q26_backfilled": (
            f"{PARTS}, fl AS (SELECT sid, max((id, p)) AS best FROM (SELECT id, sid, row_number() OVER (PARTITION BY id ORDER BY pos) AS p FROM mt) GROUP BY sid)",
            f"""SELECT sid AS id, 'Of ' || CAST(best[1] AS VARCHAR) AS series_name, CAST(best[2] AS INTEGER) AS series_position FROM fl
            UNION ALL SELECT id, 'Of ' || CAST(id AS VARCHAR), series_position FROM catalog WHERE {c8('title')} AND id NOT IN (SELECT id FROM wh)""",
        ),
        "d6_save_recommendations": (SAVED, "SELECT fi.id, 'update' AS action FROM fi JOIN k ON k.title = fi.title AND k.author = fi.author UNION ALL SELECT id, 'insert' FROM fr"),
        "d6_saved_values": (
            SAVED,
            """SELECT r.id, r.title, r.author, coalesce(k.similarity_score, r.similarity_score) AS similarity_score, coalesce(k.reason, r.reason) AS reason, CASE WHEN k.title IS NOT NULL THEN coalesce(array_to_string(k.categories, ', '), '') ELSE r.category END AS category, r.format
            FROM recommendations r LEFT JOIN fi ON fi.id = r.id LEFT JOIN k ON k.title = fi.title AND k.author = fi.author
            UNION ALL SELECT id, title, author, similarity_score, reason, coalesce(array_to_string(categories, ', '), ''), 'ebook' FROM fr""",
        ),
    }
