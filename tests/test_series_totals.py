"""Series totals kept up by signed counts against the analysis of the whole library."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import series
from shelfwise.operators.series_totals import SeriesTotals, changes, counted, shown
from shelfwise.schema import LibraryState
from shelfwise.store import Conflict


@pytest.fixture
def library(spark):
    rnd = random.Random(3)
    catalog = [(i, 1 + i % 4, f"Book {i % 60}", f"Line {i % 9}" if i % 5 else "", i % 7 == 0) for i in range(120)]
    authors = [(k, f"Author {k}", f"Author {k}") for k in range(1, 5)]
    recs = [(i, f" book {rnd.randrange(60)}", f"author {1 + rnd.randrange(4)} ", *(rnd.random() < 0.3 for _ in range(4))) for i in range(90)]
    return LibraryState.of(
        spark, catalog=spark.createDataFrame(catalog, "id long, author_id long, title string, series_name string, is_read boolean"), authors=spark.createDataFrame(authors, "id long, name string, normalized_name string"),
        recommendations=spark.createDataFrame(recs, "id long, title string, author string, already_read boolean, thumbs_down boolean, duplicate boolean, non_english boolean"),
    )


def rows(df):
    return sorted(map(repr, df.collect()))


def test_batches_equal_the_whole(spark, library, tmp_path):
    recs = library.recommendations
    flags = ("already_read", "thumbs_down", "duplicate", "non_english")
    # Batch k sets the flags of its rows; the last one takes those of the first back.
    def after(on):
        return library.with_(recommendations=recs.withColumns({f: F.when(F.col("id").isin(on), F.col(f)) for f in flags}))

    parts = [[i for i in range(90) if i % 3 == k] for k in range(3)]
    states = [after([]), after(parts[0]), after(parts[0] + parts[1]), after(parts[1] + parts[2])]
    store = SeriesTotals(spark, str(tmp_path / "t"), buckets=8)
    store.apply("start", counted(states[0]))
    for k, part in enumerate((parts[0], parts[1], parts[0] + parts[2])):
        keys = recs.filter(F.col("id").isin(part)).select("title", "author")
        signed = changes(states[k], states[k + 1], keys)
        store.apply(f"b{k}", signed)
        assert store.apply(f"b{k}", signed) == []  # delivered again
        want = series.analyze_series(states[k + 1]).select("author_id", "author", "series_name", "total_books", "books_read", "completion_pct", "status", F.size("unread_books").cast("long").alias("unread"))
        assert rows(shown(store.totals())) == rows(want)


def test_a_batch_reads_and_writes_its_own_buckets(spark, tmp_path):
    store = SeriesTotals(spark, str(tmp_path / "t"), buckets=16)
    row = lambda k, n: spark.createDataFrame([(1, "A", f"Line {k}", n, 0, n)], "author_id long, author string, series_name string, total_books long, books_read long, books_unread long")
    many = row(0, 1)
    for k in range(1, 40):
        many = many.unionByName(row(k, 1))
    store.apply("start", many)
    before = store._current()["folders"]
    (touched,) = store.apply("one", row(3, 2))
    after = store._current()["folders"]
    assert {b for b in before if before[b] != after.get(b)} == {str(touched)}
    assert store.totals().filter("series_name = 'Line 3'").first()["total_books"] == 3 and store.totals().count() == 40
    store.apply("gone", row(3, -3))  # a series without books leaves no row
    assert store.totals().count() == 39
    assert store.apply("nothing", row(3, 1).limit(0)) == []


def test_two_writers(spark, tmp_path):
    store = SeriesTotals(spark, str(tmp_path / "t"))
    row = spark.createDataFrame([(1, "A", "Line", 1, 0, 1)], "author_id long, author string, series_name string, total_books long, books_read long, books_unread long")
    stale = store._current()
    store.apply("a", row)
    store._current = lambda: stale
    with pytest.raises(Conflict):
        store.apply("b", row)
    del store._current
    assert store.totals().count() == 1 and store.totals().first()["total_books"] == 1
