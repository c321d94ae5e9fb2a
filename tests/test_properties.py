"""Properties that hold for any titles: normalisers that settle, changes that are done once."""

import random

from pyspark.sql import functions as F

from shelfwise.functions import text as X
from shelfwise.operators import catalog, recommend
from shelfwise.schema import LibraryState

PARTS = ["The ", "A ", "Sea", "sea", " (Saga Book #2)", " [1/2]", " (French Edition)", " Volume 3", "'s", "  ", "/", " | ", "é", "ß", "日本", "Series", ", ", "#4", "(", ")", "ed.", "\t"]


def titles(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 7))) for _ in range(n)]


def test_normalisers_settle(spark):
    df = spark.createDataFrame([(t,) for t in titles(400, 1)], "t string")
    for f in (X.squeeze, X.strip, X.isbn_key, X.safe_filename, X.lower_trim):
        twice = df.select(f(F.col("t")).alias("a")).withColumn("b", f(F.col("a")))
        assert twice.filter("NOT a <=> b").count() == 0, f.__name__
    for f in (X.title_for_matching, X.title_for_dedup, X.title_advanced):
        assert df.select(f(F.col("t")).alias("a")).filter("a <> lower(a) OR a <> trim(a)").count() == 0, f.__name__


def test_similarity_is_symmetric_and_bounded(spark):
    a, b = titles(200, 2), titles(200, 3)
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    s = df.select(X.similarity(F.col("a"), F.col("b")).alias("x"), X.similarity(F.col("b"), F.col("a")).alias("y"), X.similar(F.col("a"), F.col("b"), 0.85).alias("near"))
    assert s.filter("x <> y OR x < 0 OR x > 1 OR near <> (x >= 0.85)").count() == 0


def test_duplicates_go_once_and_saving_twice_adds_nothing(spark):
    rows = [(i, i % 3 + 1, t, i % 5 == 0) for i, t in enumerate(titles(150, 4), 1)]
    state = LibraryState.of(
        spark,
        authors=spark.createDataFrame([(i, f"Name {i}", f"Name {i}") for i in (1, 2, 3)], "id long, name string, normalized_name string"),
        books=spark.createDataFrame([(i, t, f"Name {i % 3 + 1}") for i, t in enumerate(titles(60, 5), 1)], "id long, title string, author string"),
        catalog=spark.createDataFrame(rows, "id long, author_id long, title string, is_read boolean"),
    )
    clean = catalog.remove_duplicate_titles(state)[1]
    keys = clean.catalog.select("author_id", X.title_for_dedup(F.col("title")).alias("k")).filter("k <> ''")
    assert keys.count() == keys.distinct().count()
    before = state.catalog.select("author_id", X.title_for_dedup(F.col("title")).alias("k")).filter("k <> ''").distinct()
    assert before.count() == keys.count()
    now = F.to_timestamp(F.lit("2026-01-31 12:00:00"))
    recs = recommend.candidates(state, "ebook")
    once = recommend.save(state, recs, now)[1]
    plan, twice = recommend.save(once, recs, now)
    assert plan.filter("action = 'insert'").isEmpty() and twice.recommendations.count() == once.recommendations.count()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_keyed_title_joins_miss_no_pair(spark):
    """Similar, contained and matching titles against all pairs, with short, repeated and long titles."""
    from shelfwise.operators import dedupe, matching

    rnd = random.Random(31)
    titles = ["", "a", "ab", "abc", "aaaa", "aaaaa", "aaaaaaaa", "aaaaaaaab"]
    for _ in range(60):
        t = "".join(rnd.choice("abc ") for _ in range(rnd.choice([2, 5, 8, 15, 30, 45]))).strip()
        titles += [t, t[rnd.randrange(3) :], t + rnd.choice("abc")]
        changed = list(t)
        for _ in range(rnd.randint(0, max(1, len(t) // 6))):
            if changed:
                changed[rnd.randrange(len(changed))] = rnd.choice(["", "x", "ab"])
        titles.append("".join(changed))
    data = [(i % 2, i, t, t) for i, t in enumerate(titles)]
    rows_ = spark.createDataFrame(data, "owner int, id long, norm string, base string")
    near, held = set(), set()
    for o, i, s, _ in data:
        for p, j, t, _ in data:
            if o == p and i < j and s and t:
                n = max(len(s), len(t))
                if 1 - edit_distance(s, t) / n >= 0.85:
                    near.add((o, i, j))
                if s == t or ((s in t or t in s) and abs(len(s) - len(t)) < 30 and min(len(s), len(t)) >= 3):
                    held.add((o, i, j))
    assert {tuple(r)[:3] for r in dedupe.similar_pairs(rows_, "norm").collect()} == near
    got = [tuple(r) for r in dedupe.contained_pairs(rows_).collect()]
    assert len(got) == len(set(got)) and set(got) == held
    half = len(titles) // 2
    authors = spark.createDataFrame([(1, "A")], "id long, normalized_name string")
    catalog = spark.createDataFrame([(i, 1, None, t, False, None) for i, t in enumerate(titles[:half])], "id long, author_id long, isbn string, title string, is_read boolean, matched_book_id long")
    loans = [(1000 + i, t) for i, t in enumerate(titles[half:]) if len(t) > 3]
    books = spark.createDataFrame([(i, "A", None, t) for i, t in loans], "id long, author string, isbn string, title string")
    want = {}
    for i, t in enumerate(titles[:half]):
        equal = [b for b, s in loans if s.strip() == t.strip()]
        part = [b for b, s in loans if t.strip() in s or s in t.strip()]
        want[i] = max(equal) if equal else min(part, default=None)
    assert {r["id"]: r["matched_book_id"] for r in matching.match_to_history(catalog, authors, books).collect()} == want
