"""A library's tables derived from the driver's tables, in SQL that Spark and DuckDB both read.

{part}, {lineitem} and {events} stand for the source tables; the texts are shared by the plans and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import LibraryState

BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INT)"

VIEWS: dict[str, str] = {
    "authors": f"""
SELECT CAST(n AS BIGINT) AS id, name, CASE WHEN n % 7 = 0 THEN concat('Someone Else ', CAST(n AS STRING)) ELSE name END AS normalized_name,
       CASE WHEN n % 3 = 0 THEN concat('/authors/OL', CAST(n % 6 AS STRING), 'A') END AS open_library_id, n % 8 = 3 AS hidden
FROM (SELECT n, CASE WHEN n % 5 = 0 THEN concat('House ', CAST(n AS STRING), ' Press')
                     WHEN n % 11 = 4 THEN concat('Ann Lee', CAST(n AS STRING), ', Bob Ray', CAST(n AS STRING))
                     ELSE concat(CASE n % 4 WHEN 0 THEN 'Julia ' WHEN 1 THEN 'Karen ' WHEN 2 THEN 'Lynette ' ELSE 'Tracie ' END, chr(65 + n % 26), '. ',
                                 CASE n % 3 WHEN 0 THEN 'Kelly' WHEN 1 THEN 'Eason' ELSE 'Peterson' END) END AS name
      FROM (SELECT DISTINCT {BRAND} AS n FROM {{part}}) AS b) AS named
""",
    "titles": f"""
SELECT CAST(p_partkey AS BIGINT) AS id, CAST({BRAND} AS BIGINT) AS author_id, p_name, p_type, p_size, p_retailprice,
       CASE p_partkey % 10 WHEN 0 THEN concat(p_name, ' (', p_type, ' Book #', CAST(p_size AS STRING), ')')
                           WHEN 1 THEN concat('The ', p_name)
                           WHEN 2 THEN concat(p_name, ' (French Edition)')
                           WHEN 3 THEN concat(p_name, ' Volume ', CAST(p_size AS STRING))
                           WHEN 4 THEN concat(p_name, ' / the ', p_type, ' tale')
                           WHEN 5 THEN concat(p_name, ' (', p_type, ' Series)')
                           WHEN 6 THEN concat(p_name, ' of McGeeX')
                           WHEN 7 THEN concat(p_name, ' for ages 8-12')
                           WHEN 8 THEN concat(p_name, ' [1/2]')
                           ELSE p_name END AS title,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(9780000000000 + p_partkey % 500 AS STRING) END AS isbn
FROM {{part}}
""",
    "catalog": """
SELECT id, author_id, title, isbn, CASE WHEN id % 4 = 1 THEN concat('January ', CAST(1900 + id % 150 AS STRING)) END AS publication_date,
       CASE WHEN id % 10 IN (0, 5) THEN concat(CASE WHEN id % 20 = 5 THEN 'The ' ELSE '' END, p_type, CASE id % 4 WHEN 0 THEN ' Series' ELSE '' END) END AS series_name,
       CASE WHEN id % 10 IN (0, 5) THEN p_size END AS series_position, CASE WHEN id % 2 = 0 THEN concat('/works/OL', CAST(id AS STRING), 'W') END AS open_library_key,
       CASE WHEN id % 5 = 2 THEN CAST(id AS STRING) END AS google_books_id, CASE WHEN p_retailprice > 950 THEN repeat(concat(p_name, ' '), 20) END AS description,
       CASE id % 4 WHEN 1 THEN p_type WHEN 2 THEN concat(p_type, ', History') WHEN 3 THEN concat(p_type, ', Fiction, Juvenile Fiction') END AS categories, id % 9 = 0 AS is_read
FROM titles
""",
    "books": """
SELECT t.id, CASE t.id % 4 WHEN 0 THEN t.title WHEN 1 THEN t.p_name WHEN 2 THEN concat(' ', upper(t.p_name)) ELSE concat(t.p_name, ' retold') END AS title,
       a.normalized_name AS author, CASE t.id % 3 WHEN 0 THEN 'Tantor Media' WHEN 1 THEN 'Orbit' END AS publisher, CASE WHEN t.id % 6 = 0 THEN t.isbn END AS isbn,
       CASE t.id % 3 WHEN 0 THEN 'audiobook' WHEN 1 THEN 'ebook' ELSE 'unknown' END AS format, l.borrowed_date
FROM (SELECT l_partkey, min(l_shipdate) AS borrowed_date FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY l_partkey) AS l
JOIN titles AS t ON t.id = l.l_partkey JOIN authors AS a ON a.id = t.author_id
""",
    "recommendations": """
SELECT e.event_id AS id, CASE WHEN e.event_id % 3 = 0 THEN t.id END AS catalog_book_id, t.title, a.name AS author, t.isbn, CASE WHEN e.event_id % 2 = 0 THEN 'audiobook' ELSE 'ebook' END AS format,
       t.p_type AS category, 'same_author' AS recommendation_type, e.value AS similarity_score, CASE WHEN e.event_id % 4 = 0 THEN 'because' END AS reason,
       e.event_type = 'click' AS thumbs_up, e.event_type = 'signup' AS thumbs_down, e.event_type = 'view' AND e.event_id % 16 = 0 AS non_english, e.event_type = 'purchase' AND e.event_id % 8 = 0 AS already_read,
       e.event_type = 'error' AND e.event_id % 4 = 0 AS duplicate
FROM {events} AS e JOIN titles AS t ON t.id = e.event_id % (SELECT count(*) FROM {part}) JOIN authors AS a ON a.id = t.author_id
""",
}


def shared_sql(names: tuple[str, ...] = tuple(VIEWS)) -> str:
    """The views as the start of a WITH query over tables of their own names."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(part='part', lineitem='lineitem', events='events')})" for n in names)


def library(spark: SparkSession, sf_dir: str) -> LibraryState:
    """The derived library over a driver folder."""
    source = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "events")}

    def view(name: str, *uses: str) -> DataFrame:
        with_ = ", ".join(f"{u} AS ({VIEWS[u]})" for u in uses)
        return spark.sql(f"WITH {with_} {VIEWS[name]}" if uses else VIEWS[name], **source)

    return LibraryState.of(
        spark, authors=view("authors"), catalog=view("catalog", "titles"), books=view("books", "authors", "titles"), recommendations=view("recommendations", "authors", "titles"),
    )
