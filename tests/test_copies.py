"""Rows that repeat a title: their classes are compared once, and all their pairs come back."""

import random

from pyspark.sql import functions as F

from shelfwise.operators import catalog, curation, dedupe, matching
from shelfwise.operators.parts import either_holding
from shelfwise.plans import documents, queries
from shelfwise.schema import LibraryState
from shelfwise.store import settled


def catalog_rows(spark, copies: int):
    """Two owners' titles, each so many times; some are near others, some hold others, some are empty."""
    rnd = random.Random(5)
    titles = ["", "ab", "large ring", "large rings", "large ring of old", "hot plate", "the hot plate"]
    titles += ["".join(rnd.choice("abc ") for _ in range(rnd.choice([6, 9, 14]))).strip() for _ in range(20)]
    data = [(i % 2, i, t, t) for i, t in enumerate(titles * copies)]
    return spark.createDataFrame(data, "owner int, id long, norm string, base string")


def spread(got) -> set:
    """The pairs of rows that members and links stand for."""
    of, links = {}, []
    for owner, kind, a, b in got:
        if kind == "member":
            of.setdefault((owner, a), []).append(b)
        else:
            links.append((owner, a, b))
    pairs = {(o, x, y) for (o, _), rows in of.items() for x in rows for y in rows if x < y}
    return pairs | {(o, min(x, y), max(x, y)) for o, a, b in links for x in of[o, a] for y in of[o, b]}


def test_similar_classes_hold_every_pair(spark):
    rows = catalog_rows(spark, 3)
    find = lambda firsts: dedupe.similar_pairs(firsts, "norm")
    got = [tuple(r) for r in dedupe.in_classes(rows, "norm", find).collect()]
    assert len(got) == len(set(got)) and spread(got) == {tuple(r)[:3] for r in dedupe.similar_pairs(rows, "norm").collect()}
    links = lambda n: dedupe.in_classes(catalog_rows(spark, n), "norm", find).filter("kind = 'link'").count()
    assert 0 < links(9) == links(27)  # rows of one owner's title are one class however many they are


def test_similar_titles_give_every_pair_of_rows(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "PIECE", 4)  # large classes meet in pieces
    titles = ["The Large Ring", "large ring", "Large Rings", "Hot Plate", "Sea"] * 7 + ["Sea"] * 20
    rows = spark.createDataFrame([(i, 1 + i % 2, t) for i, t in enumerate(titles)], "id long, author_id long, title string")
    got = [tuple(r) for r in queries.q20_similar_titles(LibraryState.of(spark, catalog=rows)).select("owner", "a", "b").collect()]
    word = lambda t: "large ring" if "ring" in t.lower() else t
    want = [(1 + i % 2, i, j) for i, t in enumerate(titles) for j, u in enumerate(titles) if i < j and i % 2 == j % 2 and word(t) == word(u)]
    assert sorted(got) == sorted(want)


def test_contained_classes_hold_every_pair(spark):
    rows = catalog_rows(spark, 3)
    got = [tuple(r) for r in dedupe.in_classes(rows, "base", dedupe.contained_pairs).collect()]
    assert len(got) == len(set(got)) and spread(got) == {tuple(r) for r in dedupe.contained_pairs(rows).collect()}
    links = lambda n: dedupe.in_classes(catalog_rows(spark, n), "base", dedupe.contained_pairs).filter("kind = 'link'").count()
    assert 0 < links(9) == links(27)


def test_contained_titles_give_every_pair_of_rows(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "PIECE", 4)
    titles = ["Ring", "ring (Sea Series)", "large ring", "Sea", "ab"] * 7 + ["Sea"] * 20 + ["ring " + "of old " * 6]
    rows = spark.createDataFrame([(i, 1 + i % 2, t) for i, t in enumerate(titles)], "id long, author_id long, title string")
    got = [tuple(r) for r in queries.q20_contained_titles(LibraryState.of(spark, catalog=rows)).select("owner", "a", "b").collect()]
    base = [t.lower().split(" (")[0].strip() for t in titles]
    holds = lambda x, y: x == y or (x in y or y in x) and abs(len(x) - len(y)) < 30 and min(len(x), len(y)) >= 3
    want = [(1 + i % 2, i, j) for i, x in enumerate(base) for j, y in enumerate(base) if i < j and i % 2 == j % 2 and holds(x, y)]
    assert sorted(got) == sorted(want)


def test_loans_are_read_in_parts(spark, monkeypatch):
    """An export is written and read by more than one task, and no row is lost between its files."""
    loans = spark.range(60).selectExpr("id", "concat('T', id) AS title", "'An Author' AS author", "'1' AS isbn", "'P' AS publisher", "timestamp'2024-05-06 07:08:00' AS borrowed_date")
    monkeypatch.setattr(queries, "EXPORT_ROWS", 5)
    state = LibraryState.of(spark, books=loans.repartition(3))
    got = queries.s1_loans(state)
    assert len(got.inputFiles()) >= 12
    assert sorted(r["title"] for r in got.collect()) == sorted(f'T{i}, "vol"' for i in range(60) if i % 9)


def test_numbered_rows_are_computed_once(spark):
    """Rows that get numbers are written before their ranges are found."""
    from pyspark.sql import functions as F

    from shelfwise.schema import with_numbers

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = with_numbers(spark.range(500).mapInArrow(count, "id long"), F.col("id"))
    assert sorted((r["id"], r["number"]) for r in got.collect()) == [(k, k + 1) for k in range(500)] and seen.value == 500


def test_each_pair_of_titles_is_compared_once_and_dealt_out(spark, monkeypatch):
    titles = ["large ring"] * 5 + ["large rings", "hot plate"]
    rows = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(titles)], "author_id long, id long, title string, isbn string")
    keyed = dedupe.keyed(rows, "author_id", F.lit(0))
    groups, written = dedupe.duplicate_groups(keyed, False), []
    monkeypatch.setattr(dedupe, "settled", lambda df: (written.append(df), settled(df))[1])
    got = dedupe.explained(groups, rows)
    assert {(r["keep_id"], r["id"]) for r in got.collect()} == {(0, i) for i in range(1, 6)} and written[-1].count() == 2
    for df in (written[-1], keyed):
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_composites_and_their_parts_make_no_pairs(spark, monkeypatch):
    met = []

    def meet(a, b, *rest):
        met.append((a.count(), b.count()))
        return either_holding(a, b, *rest)

    monkeypatch.setattr(curation, "either_holding", meet)
    titles = ["large ring / hot plate", "Large Ring", "hot plate", "the hot plate of old"]
    for copies in (2, 8):
        data = [(i, 1, t) for i, t in enumerate(titles * copies)] + [(1000, 2, "large ring / hot plate")]
        got = curation.composites(LibraryState.of(spark, catalog=spark.createDataFrame(data, "id long, author_id long, title string")))
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert [(r["composite_id"], r["confidence"], [(m["pos"], m["standalone_id"], m["score"]) for m in r["matches"]]) for r in got.orderBy("composite_id").collect()] == [
            (4 * k, "high", [(0, 1, 1.0), (1, 2, 1.0)]) for k in range(copies)
        ]
    assert met == [(2, 3)] * 2  # texts, not rows


def test_copies_of_titles_and_loans_make_no_pairs(spark, monkeypatch):
    met = []

    def meet(a, b, *rest):
        met.append((a.count(), b.count()))
        return either_holding(a, b, *rest)

    monkeypatch.setattr(matching, "either_holding", meet)
    authors = spark.createDataFrame([(1, "A", "A"), (2, "B", "B")], "id long, name string, normalized_name string")
    for copies in (2, 8):
        titles = spark.createDataFrame([(3 * k + i, 1, t) for k in range(copies) for i, t in enumerate(["large ring anew", "ring", "plate"])] + [(1000, 2, "ring")], "id long, author_id long, title string")
        loans = spark.createDataFrame([(100 + k, "Large Ring", "A") for k in range(copies)] + [(50, "large ring of old", "A")], "id long, title string, author string")
        state = LibraryState.of(spark, authors=authors, catalog=titles, books=loans)
        got = {r["id"]: r["matched_book_id"] for r in matching.match_to_history(state.catalog, state.authors, state.books).collect()}
        assert got == {3 * k + i: m for k in range(copies) for i, m in enumerate([100, 50, None])} | {1000: None}
    assert met == [(4, 2)] * 2  # texts, not rows


def test_a_fetch_computes_its_works_once(spark):
    """Works are parsed once; an author whose fetch changes nothing gets all its rows matched, one that isn't asked none."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    fields = "author_id long, key string, title string, languages array<string>, isbn string, publication_date string, series_name string, series_position int"
    works = spark.createDataFrame([(1, "w1", "Sea", None, None, None, None, None), (1, "w2", "New", None, None, None, None, None), (2, "w3", "Neuf", ["fre"], None, None, None, None), (None, "w4", "Nobody", None, None, None, None, None)], fields)
    editions = spark.createDataFrame([], "key string, pos int, title string, languages array<string>, isbn string, publication_date string")
    state = LibraryState.of(
        spark,
        authors=spark.createDataFrame([(i, n, n) for i, n in enumerate("ABC", 1)], "id long, name string, normalized_name string"),
        catalog=spark.createDataFrame([(1, 1, "sea", False), (2, 1, "Lake", False), (3, 2, "Hill", False), (4, 2, "Moor", True), (5, 3, "Fen", False)], "id long, author_id long, title string, is_read boolean"),
        books=spark.createDataFrame([(10, "Sea", "A"), (11, "Lake", "A"), (12, "Hill", "B"), (13, "Fen", "C"), (14, "New", "A")], "id long, title string, author string"),
    )
    plan, new = catalog.fetch_catalog(state, works.mapInArrow(count, works.schema), editions, queries.now())
    assert sorted((r["key"], r["action"]) for r in plan.collect()) == [("w1", "update"), ("w2", "insert"), ("w4", "insert")]
    got = sorted((r["id"], r["open_library_key"], r["is_read"], r["matched_book_id"], r["fetched_at"] is not None) for r in new.catalog.collect())
    assert got == [(1, "w1", True, 10, True), (2, None, False, None, False), (3, None, True, 12, False), (4, None, False, None, False), (5, None, False, None, False), (6, "w4", False, None, True), (7, "w2", True, 14, True)]
    assert sorted((r["id"], r["last_catalog_check"] is not None) for r in new.authors.collect()) == [(1, True), (2, True), (3, False)]
    assert seen.value == 4


def test_documents_are_dealt_and_their_keys_stay_in_the_tasks(spark, monkeypatch):
    written, served = [], documents.served
    monkeypatch.setattr(documents, "served", lambda state, kind, payloads, *rest: (written.append(payloads), served(state, kind, payloads, *rest))[1])
    rows = spark.createDataFrame([(i, 1, f"T{i}") for i in range(40)], "id long, author_id long, title string").coalesce(1)
    state = LibraryState.of(spark, catalog=rows)
    works, editions = documents.works(state), documents.editions(state)
    assert works.count() == 40 and editions.select("key").distinct().count() == 30
    for df in written:
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in works._jdf.queryExecution().executedPlan().toString()
