"""Catalog documents of two book APIs, and the JSON files of reviews.

Responses come through DocumentClient: a cache table first, then the network, by the data source of book_api.py. Parsed
documents are DataFrames with explicit schemas; fields that come in two shapes (a string or an object) are read as
variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..store import _remove, settled, shared_folder
from .book_api import CALLS, HostDown, Limits, http_get, register, request, time

__all__ = ["DocumentClient", "HostDown", "Limits", "request"]

RESPONSES = "host string, endpoint string, params string, payload string"


class DocumentClient:
    """Answers requests (host, endpoint, params) from the cache, and the rest from the network."""

    def __init__(self, spark: SparkSession, cache_path: str | None = None, limits: Limits = Limits(), get: Callable = http_get, sleep: Callable = time.sleep):
        self.spark, self.cache_path, self.limits, self.get, self.sleep = spark, cache_path, limits, get, sleep

    def cached(self) -> DataFrame:
        """One payload per request; empty ones count as missing."""
        if self.cache_path is None:
            return self.spark.createDataFrame([], RESPONSES)
        try:
            found = self.spark.read.schema(RESPONSES).parquet(self.cache_path)
        except Exception as e:  # no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], RESPONSES)
        full = found.filter(~F.coalesce(F.trim("payload"), F.lit("")).isin("", "{}", "[]", "null"))
        return full.groupBy("host", "endpoint", "params").agg(F.max("payload").alias("payload"))

    def fetch(self, requests: DataFrame) -> DataFrame:
        """requests: host, endpoint, params (a JSON object). Gives RESPONSES; new ones are added to the cache. One job asks all
        of them, dealt to `Limits.tasks` tasks that share one pace and one count of errors a host (book_api.py). Tasks never
        raise for a host's sake; where a host was given up, HostDown comes once all answers are kept. Of a fetch whose
        driver dies the answers are in the spool beside the cache, from where the next one takes them."""
        keys = ["host", "endpoint", "params"]
        root = shared_folder(self.spark)
        spool = f"{self.cache_path}-spool" if self.cache_path is not None else f"{root}-spool"
        self._keep_spooled(spool)
        known = self.cached()
        wanted = settled(requests.select(*keys).distinct())
        task = F.pmod(F.xxhash64(*keys), F.lit(self.limits.tasks)).cast("int")
        missing = settled(wanted.join(known, keys, "left_anti"))
        fresh = self.spark.createDataFrame([], RESPONSES)
        if not missing.isEmpty():
            missing.withColumn("task", task).repartition(self.limits.tasks, "task").write.partitionBy("task").parquet(root)
            source = self.spark.read.format(register(self.spark, self.get, self.sleep)).options(**self.limits.options())
            answers = settled(source.option("requests", self._qualified(root)).option("spool", self._qualified(spool)).load().select(*keys, "payload"))
            fresh = answers.filter("payload IS NOT NULL")
            if self.cache_path is not None:
                fresh.write.mode("append").parquet(self.cache_path)
            _remove(self.spark, spool)
            down = answers.filter("payload IS NULL").select("host").first()
            if down is not None:
                raise HostDown(f"{down[0]} gave no answer to {self.limits.errors} calls in a row; what came before is kept")
        return wanted.join(known.unionByName(fresh).groupBy(*keys).agg(F.max("payload").alias("payload")), keys, "left").select(*keys, F.coalesce("payload", F.lit("{}")).alias("payload"))

    def _qualified(self, path: str) -> str:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(where).toString()

    def _keep_spooled(self, spool: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{spool}/answers")
        if self.cache_path is not None and where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            found = self.spark.read.schema(RESPONSES).json(where.toString()).filter("payload IS NOT NULL AND params IS NOT NULL")
            found.write.mode("append").parquet(self.cache_path)
        _remove(self.spark, spool)

    # The calls of the two APIs; `host` is where they are served.
    def search_author(self, name: str) -> tuple[str, dict]:
        return CALLS["author_search"](name, None)

    def author_works(self, key: str, limit: int = 100) -> tuple[str, dict]:
        return CALLS["author_works"](key, limit)

    def work(self, key: str) -> tuple[str, dict]:
        return CALLS["work"](key, None)

    def editions(self, key: str, limit: int = 100) -> tuple[str, dict]:
        return CALLS["editions"](key, limit)

    def by_isbn(self, isbn: str) -> tuple[str, dict]:
        return CALLS["isbn"](isbn, None)

    def volumes_by_author(self, name: str) -> tuple[str, dict]:
        return CALLS["volumes_by_author"](name, None)

    def volume_by_isbn(self, isbn: str) -> tuple[str, dict]:
        return CALLS["volumes_by_isbn"](isbn, None)

    def volumes_by_title(self, title: str) -> tuple[str, dict]:
        return CALLS["volumes_by_title"](title, None)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _keys(v: Column, path: str) -> Column:
    """An array of strings, or of objects with a key."""
    items = F.try_variant_get(v, path, "array<variant>")
    return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$.key", "string"), F.try_variant_get(x, "$", "string")))


def read_works(payloads: DataFrame) -> DataFrame:
    """payloads: key, payload of works. Columns as the catalog needs them."""
    d = payloads.select("key", F.try_parse_json("payload").alias("v"))
    v = F.col("v")
    title = _get(v, "$.title")
    from_title = X.series_from_title(title)
    explicit = F.coalesce(_get(v, "$.series[0].name"), _get(v, "$.series[0]"))
    has = X.or_empty(explicit) != ""
    return d.select(
        "key",
        title.alias("title"),
        F.when(has, explicit).otherwise(from_title["name"]).alias("series_name"),
        F.when(has, _get(v, "$.series_position", "int")).otherwise(from_title["position"]).alias("series_position"),
        X.best_isbn((_strings(v, "$.isbn_13"), _strings(v, "$.isbn_10"))).alias("isbn"),
        F.coalesce(_get(v, "$.first_publish_date"), _get(v, "$.first_publish_year")).alias("publication_date"),
        _keys(v, "$.languages").alias("languages"),
        F.transform(
            F.coalesce(F.try_variant_get(v, "$.authors", "array<variant>"), F.array().cast("array<variant>")),
            lambda x: X.author_key(F.coalesce(F.try_variant_get(x, "$.author.key", "string"), F.try_variant_get(x, "$.key", "string"), F.try_variant_get(x, "$", "string"))),
        ).alias("author_keys"),
    )


def read_editions(payloads: DataFrame) -> DataFrame:
    """payloads: key, payload of edition lists: one row per edition, in order."""
    entry = "array<struct<title:string,languages:array<variant>,isbn_13:array<string>,isbn_10:array<string>,publish_date:string,publish_year:string>>"
    rows = payloads.select("key", F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$.entries", entry)).alias("pos", "e"))
    return rows.select(
        "key", "pos", "e.title",
        F.transform(F.coalesce("e.languages", F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$.key", "string"), F.try_variant_get(x, "$", "string"))).alias("languages"),
        X.best_isbn((F.coalesce("e.isbn_13", F.array().cast("array<string>")), F.coalesce("e.isbn_10", F.array().cast("array<string>")))).alias("isbn"),
        F.coalesce("e.publish_date", "e.publish_year").alias("publication_date"),
    )


def read_volumes(payloads: DataFrame) -> DataFrame:
    """payloads: key, payload of volume searches: one row per volume, in order."""
    item = "array<struct<id:string,volumeInfo:struct<title:string,subtitle:string,language:string,categories:array<string>,description:string>>>"
    rows = payloads.select("key", F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$.items", item)).alias("pos", "item"))
    i = "item.volumeInfo"
    series = X.subtitle_series(F.col(f"{i}.title"), F.col(f"{i}.subtitle"))
    return rows.select(
        "key", "pos", F.col("item.id").alias("google_books_id"), F.col(f"{i}.title").alias("title"),
        F.coalesce(F.col(f"{i}.categories"), F.array().cast("array<string>")).alias("categories"), F.col(f"{i}.description").alias("description"),
        series["name"].alias("series_name"), series["position"].alias("series_position"), C.volume_english(F.col(f"{i}.language"), F.col(f"{i}.title")).alias("english"),
    )


def read_search(payloads: DataFrame) -> DataFrame:
    """payloads: key, payload of author searches: one row per result with an author key, in order."""
    rows = payloads.select("key", F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$.docs", "array<variant>")).alias("rank", "v"))
    return rows.select("key", "rank", X.author_key(F.try_variant_get("v", "$.key", "string")).alias("author_key")).filter("author_key <> ''")


def read_author_works(payloads: DataFrame) -> DataFrame:
    """payloads: key (of an author), payload of their works: work key and title, in order."""
    rows = payloads.select("key", F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$.entries", "array<variant>")).alias("pos", "v"))
    return rows.select(F.col("key").alias("author_key"), "pos", F.try_variant_get("v", "$.key", "string").alias("key"), F.try_variant_get("v", "$.title", "string").alias("title"))


def read_names(payloads: DataFrame) -> DataFrame:
    """payloads: key, payload of authors: author_key, name."""
    return payloads.select(F.col("key").alias("author_key"), F.try_variant_get(F.try_parse_json("payload"), "$.name", "string").alias("name")).filter("name <> ''")


def read_works_from(spark: SparkSession, path: str) -> DataFrame:
    """Work documents in JSON lines (author_id, key, payload), with their author."""
    raw = spark.read.schema("author_id long, key string, payload string").json(path)
    return raw.select("author_id", "key").distinct().join(read_works(raw.select("key", "payload").distinct()), "key")


def read_editions_from(spark: SparkSession, path: str) -> DataFrame:
    """Edition lists in JSON lines (key, editions)."""
    return read_editions(spark.read.schema("key string, editions string").json(path).select("key", F.col("editions").alias("payload")).filter("payload IS NOT NULL"))


REPORT = (
    "analysis_date string, min_books int, authors array<struct<author_id:long,author_name:string,duplicate_details:array<struct<group_key:string,"
    "keep:struct<id:long,title:string,isbn:string>,remove:array<struct<id:long,title:string,isbn:string,reasons:array<string>>>,pattern_types:array<string>,count:int>>>>"
)


def read_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A duplicate report (one document, or a document a line), one row per row to remove."""
    groups = spark.read.schema(REPORT).json(path, multiLine=not lines).select(F.explode("authors").alias("a")).select("a.author_id", "a.author_name", F.explode("a.duplicate_details").alias("g"))
    return groups.select("author_id", "author_name", "g.group_key", F.col("g.keep.id").alias("keep_id"), "g.pattern_types", F.explode("g.remove").alias("r")).select("author_id", "author_name", "group_key", "keep_id", "pattern_types", F.col("r.id").alias("remove_id"), "r.reasons")


def read_approvals(spark: SparkSession, path: str) -> DataFrame:
    """An approval file: author_ids, group_keys, approve_all."""
    return spark.read.schema("author_ids array<long>, group_keys array<string>, approve_all boolean").json(path, multiLine=True)
