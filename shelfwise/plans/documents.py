"""Documents of the two book APIs derived from the driver's titles: their fields in SQL that Spark and DuckDB both read, and
the JSON that an API would give for them, which the sources then parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LibraryState
from ..sources.book_api import register
from ..sources.documents import read_editions, read_search, read_volumes, read_works
from ..store import shared_folder

#: Over the view `catalog`. Some works are known by key, some by title, some are another author's, some have no title.
WORK_FIELDS = """
SELECT id, CASE WHEN id % 5 = 0 THEN author_id % 25 + 1 ELSE author_id END AS author_id, concat('/works/OL', CAST(id AS STRING), CASE WHEN id % 4 = 0 THEN 'W' ELSE 'N' END) AS key,
       CASE WHEN id % 7 = 0 THEN '' WHEN id % 3 = 0 THEN title ELSE concat(title, ' anew ', CAST(id AS STRING)) END AS title,
       CASE id % 6 WHEN 1 THEN '/languages/fre' WHEN 2 THEN '/languages/eng' END AS language,
       CASE WHEN id % 4 = 1 THEN CAST(9790000000000 + id AS STRING) END AS isbn_13, CASE WHEN id % 4 IN (1, 2) THEN CAST(1000000000 + id % 300 AS STRING) END AS isbn_10,
       CASE WHEN id % 2 = 0 THEN concat('May ', CAST(1990 + id % 36 AS STRING)) END AS first_publish_date, CAST(1990 + id % 30 AS STRING) AS first_publish_year,
       CASE WHEN id % 8 < 2 THEN concat('Line ', CAST(id % 12 AS STRING)) END AS series, CAST(id % 12 AS INT) AS series_position, concat('OL', CAST(id % 40 AS STRING), 'A') AS author_key
FROM catalog
"""

#: Editions k = 0, 1, 2 of a work, as many as id % 4.
EDITION_FIELDS = f"""
SELECT w.id, w.key, e.k, concat(w.title, ' e') AS title, CASE WHEN (w.id + e.k) % 4 = 3 THEN NULL WHEN (w.id + e.k) % 3 = 0 THEN '/languages/eng' ELSE '/languages/fre' END AS language,
       CASE WHEN e.k = 1 THEN concat('979', CAST(w.id AS STRING), '1') END AS isbn_13, concat('1', CAST(w.id AS STRING), CAST(e.k AS STRING)) AS isbn_10,
       CASE WHEN e.k < 2 THEN CAST(1980 + (w.id + e.k) % 50 AS STRING) END AS publish_date
FROM ({WORK_FIELDS}) AS w JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS e ON e.k < w.id % 4
"""


def _fields(state: LibraryState, sql: str) -> DataFrame:
    """The fields, dealt by id: titles lie in one or two row groups, and a mirror is read by as many tasks as have written it."""
    return state.spark.sql(sql.replace("FROM catalog", "FROM {catalog}"), catalog=state.catalog.repartition("id"))


def served(state: LibraryState, kind: str, payloads: DataFrame, limit: int | None = None) -> DataFrame:
    """key, payload as the data source of the APIs serves them, from a mirror of their documents in Parquet."""
    root = shared_folder(state.spark)
    payloads.select(F.lit(kind).alias("kind"), "key", "payload").write.parquet(root)
    found = state.spark.read.format(register(state.spark)).option("mirror", root).load().filter(F.col("kind") == kind)
    return (found if limit is None else found.filter(F.col("limit") == limit)).select("key", "payload")


def _some(c: str):
    return F.when(F.col(c).isNotNull(), F.array(F.col(c)))


def works(state: LibraryState) -> DataFrame:
    """The works as parsed documents, with their author_id. Keys, series and authors come in the shapes an API uses."""
    f = _fields(state, WORK_FIELDS)
    shapes = (F.col("id") % 3).cast("int")
    named = F.to_json(F.struct(F.array(F.struct(F.col("series").alias("name"))).alias("series")))
    plain = F.to_json(F.struct(F.array("series").alias("series")))
    series = F.when(F.col("series").isNull(), "{}").when(F.col("id") % 8 == 0, named).otherwise(plain)
    author = (
        F.when(shapes == 0, F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("/authors/"), "author_key").alias("key")).alias("author"))).alias("authors"))))
        .when(shapes == 1, F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("/"), "author_key").alias("key"))).alias("authors"))))
        .otherwise(F.to_json(F.struct(F.array("author_key").alias("authors"))))
    )
    languages = F.to_json(F.struct(F.when(F.col("language").isNotNull(), F.array(F.struct(F.col("language").alias("key")))).alias("languages")))
    rest = F.to_json(F.struct("title", _some("isbn_13").alias("isbn_13"), _some("isbn_10").alias("isbn_10"), "first_publish_date", "first_publish_year", "series_position"))
    inner = lambda j: F.expr(f"substring({j}, 2, length({j}) - 2)")
    parts = f.select("author_id", "key", series.alias("a"), author.alias("b"), languages.alias("c"), rest.alias("d"))
    joined = F.concat(F.lit("{"), F.concat_ws(",", *(F.nullif(inner(x), F.lit("")) for x in "abcd")), F.lit("}"))
    payloads = parts.select("author_id", "key", joined.alias("payload"))
    keys = payloads.select("author_id", "key").hint("merge")  # a small file may hold millions of keys, too many to send around
    return keys.join(read_works(served(state, "work", payloads)), "key")


def editions(state: LibraryState) -> DataFrame:
    f = _fields(state, EDITION_FIELDS)
    entry = F.struct("k", "title", F.when(F.col("language").isNotNull(), F.array(F.struct(F.col("language").alias("key")))).alias("languages"), _some("isbn_13").alias("isbn_13"), _some("isbn_10").alias("isbn_10"), "publish_date")
    lists = f.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # three at most
    return read_editions(served(state, "editions", lists.select("key", F.to_json(F.struct("entries")).alias("payload")), 100))


def volumes(state: LibraryState) -> DataFrame:
    """One volume for each catalog row, its subtitle with a book number for some."""
    language = F.when(F.col("id") % 4 == 0, "fr").when(F.col("id") % 4 == 1, "en-GB")
    info = F.struct("title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Tales Book "), (F.col("id") % 9).cast("string"))).alias("subtitle"), language.alias("language"), F.array(F.lit("Fiction")).alias("categories"), "description")
    item = F.struct(F.col("id").cast("string").alias("id"), info.alias("volumeInfo"))
    return read_volumes(served(state, "volumes_by_isbn", state.catalog.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload")), 1))


def found_authors(state: LibraryState) -> DataFrame:
    """Search results: each author's own key second, another's first."""
    own, other = F.concat(F.lit("OL"), F.col("id").cast("string"), F.lit("A")), F.concat(F.lit("/authors/OL"), (F.col("id") + 1).cast("string"), F.lit("A"))
    docs = F.array(F.struct(other.alias("key")), F.struct(own.alias("key")))
    found = read_search(served(state, "author_search", state.authors.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(docs.alias("docs"))).alias("payload")), 2))
    names = state.authors.select(F.col("id").cast("string").alias("key"), F.col("normalized_name").alias("author"))
    return found.join(names, "key").groupBy("author", "author_key").agg(F.min("rank").alias("rank"))


def listed_works(state: LibraryState) -> DataFrame:
    """author_key, pos, title: each author's catalog as the outside author's list of works."""
    return state.catalog.select(F.concat(F.lit("/authors/OL"), F.col("author_id").cast("string"), F.lit("A")).alias("author_key"), (F.col("id") % 40).alias("pos"), "title")
