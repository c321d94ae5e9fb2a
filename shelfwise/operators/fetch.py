"""What the catalog operators need from the network, as DataFrames (S4-S7): one fetch for each kind of document, for all
authors and works at once. Every fetch goes through the client's cache."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState
from ..sources.documents import DocumentClient, read_author_works, read_editions, read_names, read_search, read_volumes, read_works
from ..store import settled
from .authors import pick_candidates
from .catalog import due_authors

WORKS, VOLUMES = "https://openlibrary.org", "https://www.googleapis.com/books/v1"


def _params(given: dict) -> Column:
    """The parameters as JSON; a value may be a column."""
    if not any(isinstance(v, Column) for v in given.values()):
        return F.lit(json.dumps(given))
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in given.items())))


def ask(client: DocumentClient, host: str, keys: DataFrame, endpoint: Callable[[Column], Column], params: Callable[[Column], dict]) -> DataFrame:
    """key, payload of one call for each key."""
    k = F.col("key")
    calls = settled(keys.filter("key <> ''").select("key").distinct().select("key", F.lit(host).alias("host"), endpoint(k).alias("endpoint"), _params(params(k)).alias("params")))
    return settled(client.fetch(calls.drop("key")).join(calls, ["host", "endpoint", "params"]).select("key", "payload"))


def _id(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def search_authors(client: DocumentClient, host: str, names: DataFrame) -> DataFrame:
    return ask(client, host, names, lambda k: F.lit("/search/authors.json"), lambda k: {"q": k})


def author_works(client: DocumentClient, host: str, keys: DataFrame, limit: int) -> DataFrame:
    return read_author_works(ask(client, host, keys, lambda k: F.concat(F.lit("/authors/"), _id(k), F.lit("/works.json")), lambda k: {"limit": limit}))


def works(client: DocumentClient, host: str, keys: DataFrame) -> DataFrame:
    return read_works(ask(client, host, keys, lambda k: F.concat(F.lit("/works/"), _id(k), F.lit(".json")), lambda k: {}))


def editions(client: DocumentClient, host: str, keys: DataFrame) -> DataFrame:
    return read_editions(ask(client, host, keys, lambda k: F.concat(F.lit("/works/"), _id(k), F.lit("/editions.json")), lambda k: {"limit": 100}))


def names(client: DocumentClient, host: str, keys: DataFrame) -> DataFrame:
    return read_names(ask(client, host, keys, lambda k: F.concat(F.lit("/authors/"), _id(k), F.lit(".json")), lambda k: {}))


def author_keys(client: DocumentClient, host: str, state: LibraryState, due: DataFrame) -> DataFrame:
    """author_id, author_key of authors: the key they have, else the candidate whose works were read."""
    rows = state.authors.join(due, state.authors["id"] == due["author_id"], "left_semi").select(F.col("id").alias("author_id"), "name", "normalized_name", X.author_key(F.col("open_library_id")).alias("author_key"))
    known = rows.filter("author_key <> ''").select("author_id", "author_key")
    unknown = settled(rows.filter("author_key IS NULL OR author_key = ''").select("author_id", "name", "normalized_name"))
    found = settled(read_search(search_authors(client, host, unknown.select(F.col("name").alias("key")))).join(unknown.select(F.col("name").alias("key"), F.col("normalized_name").alias("author")), "key"))
    some = author_works(client, host, found.select(F.col("author_key").alias("key")), 20)
    picked = pick_candidates(found.select("author", "rank", "author_key"), some, state.books)
    return known.unionByName(unknown.select("author_id", F.col("normalized_name").alias("author")).join(picked.select("author", "author_key"), "author").select("author_id", "author_key"))


def catalog_documents(client: DocumentClient, host: str, state: LibraryState, now: Column, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, editions, author keys) of the authors that are due, as catalog.fetch_all takes them: works that the author's
    catalog has are not asked for; a work without a title in its own document has that of the author's list."""
    due = due_authors(state, now, force).filter("due").select(F.col("id").alias("author_id"))
    keys = settled(author_keys(client, host, state, due))
    listed = author_works(client, host, keys.select(F.col("author_key").alias("key")), 200).filter("key <> ''").join(keys, "author_key").select("author_id", "key", F.col("title").alias("listed_title"))
    had = state.catalog.select("author_id", F.col("open_library_key").alias("key")).filter("key IS NOT NULL").distinct()
    new = settled(listed.join(had, ["author_id", "key"], "left_anti"))
    found = works(client, host, new.select("key")).drop("author_keys")
    every = new.join(found, "key").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "listed_title")).drop("listed_title").dropDuplicates(["author_id", "key"])
    return settled(every), editions(client, host, new.select("key")), keys


def mismatch_documents(client: DocumentClient, host: str, state: LibraryState) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(work_authors, author_works, names), as Q8 takes them: the first author of each catalog work, the first 50 works of
    these authors and of the library's own, and their names."""
    found = works(client, host, state.catalog.select(F.col("open_library_key").alias("key")))
    work_authors = settled(found.select("key", F.get("author_keys", F.lit(0)).alias("author_key")).filter("author_key <> ''"))
    own = state.authors.select(X.author_key(F.col("open_library_id")).alias("key")).filter("key <> ''")
    outside = settled(work_authors.select(F.col("author_key").alias("key")).unionByName(own).distinct())
    return work_authors, author_works(client, host, outside, 50).select("author_key", "title"), names(client, host, outside)


def language_documents(client: DocumentClient, host: str, volumes_host: str, state: LibraryState, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(editions, volumes), as catalog.cleanup_non_english takes them: key, pos, english of the first editions of each work
    of the catalog (a work that is English counts for all its editions), isbn, english of the volume of each isbn."""
    rows = state.catalog if ids is None else state.catalog.join(ids.select("id").distinct(), "id", "left_semi")
    keys = settled(rows.select(F.col("open_library_key").alias("key")).filter("key <> ''").distinct())
    own = works(client, host, keys).select("key", C.languages_english(F.lit(None).cast("array<string>"), F.col("languages"), F.col("title")).alias("_own"))
    parts = editions(client, host, keys).join(own, "key", "left").select("key", "pos", (C.languages_english(F.col("languages"), F.lit(None).cast("array<string>"), F.col("title")) | F.coalesce("_own", F.lit(False))).alias("english"))
    isbns = rows.select(F.col("isbn").alias("key")).filter("key <> ''")
    found = read_volumes(ask(client, volumes_host, isbns, lambda k: F.lit("/volumes"), lambda k: {"q": F.concat(F.lit("isbn:"), k), "maxResults": 1}))
    return parts, found.filter("pos = 0").select(F.col("key").alias("isbn"), "english")
