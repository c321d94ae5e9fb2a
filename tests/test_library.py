"""Sources, state changes and groupings on small hand-made tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from brute_groups import grouped
from shelfwise.operators import authors, catalog, curation, dedupe, feedback, ingest, matching, recommend, report, series
from shelfwise.schema import LibraryState, conform
from shelfwise.sources import DocumentClient, newest, read_approvals, read_editions, read_loans, read_report, read_volumes, read_works
from shelfwise.sources.documents import HostDown, Limits, request
from shelfwise.store import SnapshotStore
from shelfwise.streaming import latest_feedback, stream_loans

HEADER = "title,author,isbn,publisher,timestamp,cover,library,details\n"


def at(text="2026-01-31 12:00:00"):
    return F.to_timestamp(F.lit(text))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture
def library(spark):
    def build(**tables):
        frames = {}
        for name, (schema, data) in tables.items():
            frames[name] = spark.createDataFrame(data, schema)
        return LibraryState.of(spark, **frames)

    return build


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_loans(spark, tmp_path):
    p = write(tmp_path / "a.csv", HEADER + '"A, ""quoted""\nbook",Jane Roe,, Tantor Media ,"January 12, 2026 02:51",,L,21 days\n,No Title,,,,,,\nNo Author,,,,,,,\nB, Ann Lee et al.,978,,bad,,,\n')
    got = read_loans(spark, p).orderBy("_pos").collect()
    assert [(r["title"], r["author"], r["isbn"], r["publisher"]) for r in got] == [('A, "quoted"\nbook', "Jane Roe", None, "Tantor Media"), ("B", "Ann Lee et al.", "978", None)]
    assert newest(spark, str(tmp_path / "*.csv")).endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        newest(spark, str(tmp_path / "*.none"))


def test_ingest_and_update(spark, tmp_path):
    p = write(
        tmp_path / "a.csv",
        HEADER + 'Dup,"Jane Roe, X",978,Tantor Media,"January 12, 2026",,L,21 days\nDup again,Jane Roe,978,Orbit,,c,,\nTwice,Ann Lee,,Orbit,,,,\nTwice,Ann Lee,,,,,M,\n',
    )
    counters, state = ingest.ingest(LibraryState.of(spark), read_loans(spark, p), at())
    assert counters.first().asDict() == {"books_added": 2, "books_updated": 0, "authors_added": 2, "marked_as_read": 0, "removed_from_to_read": 0}
    assert rows(state.books, "id", "title", "author", "format") == [(1, "Dup", "Jane Roe", "audiobook"), (2, "Twice", "Ann Lee", "ebook")]
    assert rows(state.authors, "id", "name", "normalized_name") == [(1, "Jane Roe, X", "Jane Roe"), (2, "Ann Lee", "Ann Lee")]
    assert rows(state.metadata, "key", "value") == [("last_libby_import", "2026-01-31T12:00:00")]
    again, same = ingest.ingest(state, read_loans(spark, p), at())
    assert again.first()["books_added"] == 0 and rows(same.books) == rows(state.books)
    counted, updated = ingest.ingest(state, read_loans(spark, p), at(), update=True)
    assert counted.first()["books_updated"] == 4
    # title and author stay; publisher and format follow the last row, also to nothing; the rest fills in
    assert rows(updated.books, "id", "title", "publisher", "format", "cover_url", "library") == [(1, "Dup", "Orbit", "ebook", "c", "L"), (2, "Twice", None, "unknown", None, "M")]


def test_read_marks(spark, library):
    s = library(
        books=("id long, title string, author string", [(1, "The Sea (Saga Book #1)", "Jane Roe")]),
        recommendations=("id long, title string, author string, format string, thumbs_up boolean, already_read boolean", [(1, "Sea", "JANE ROE, Other", "ebook", True, None), (2, "Lake", "Jane Roe", "ebook", True, None)]),
    )
    marked = ingest.mark_read(s.recommendations, s.books)
    assert rows(marked, "id", "_read") == [(1, True), (2, False)]


def test_match_to_history(library):
    s = library(
        authors=("id long, name string, normalized_name string", [(1, "Jane Roe", "Jane Roe"), (2, "Ann Lee", "Ann Lee")]),
        books=("id long, title string, author string, isbn string", [(1, "Sea", "Jane Roe", "978"), (2, " sea ", "Jane Roe", "978"), (3, "The Long Lake", "Jane Roe", None), (4, "Sea", "Ann Lee", None)]),
        catalog=(
            "id long, author_id long, title string, isbn string, is_read boolean, matched_book_id long",
            [(1, 1, "Other", "978", False, None), (2, 1, "SEA", None, False, None), (3, 1, "long lake", None, False, None), (4, 1, "Nothing", None, True, 9), (5, 2, "Sea", None, False, None)],
        ),
    )
    got = matching.match_to_history(s.catalog, s.authors, s.books)
    assert rows(got, "id", "is_read", "matched_book_id") == [(1, True, 2), (2, True, 2), (3, True, 3), (4, False, None), (5, True, 4)]


def reading(library):
    return library(
        authors=("id long, name string, normalized_name string, hidden boolean", [(1, "Jane Roe", "Jane Roe", False), (2, "Ann Lee", "Ann Lee", True)]),
        books=("id long, title string, author string, format string", [(1, "Sea", "Jane Roe", "audiobook"), (2, "Hill", "Ann Lee", "ebook")]),
        catalog=(
            "id long, author_id long, title string, series_name string, series_position int, categories string, is_read boolean",
            [
                (1, 1, "Sea", "Water", 1, None, True), (2, 1, "Lake", "Water", 2, "Fiction, Love", False), (3, 1, "Pond", "Water", 0, None, False), (4, 1, "Alone", None, None, "History", False),
                (5, 2, "Rock", "Stone", 1, None, False), (6, 1, "Le Petit Lac", None, None, None, False), (7, 1, "Moor", "Gone", 1, None, False),
            ],
        ),
        recommendations=(
            "id long, title string, author string, format string, similarity_score double, thumbs_up boolean, thumbs_down boolean, duplicate boolean, already_read boolean",
            [(1, " lake", "jane roe ", "ebook", 0.5, True, False, None, None), (2, "Pond", "Jane Roe", "ebook", None, False, True, None, None), (3, "Moor", "Jane Roe", "ebook", None, None, None, True, None), (4, "New", "Ann Lee", "ebook", None, True, None, None, None)],
        ),
    )


def test_series(library):
    got = series.analyze_series(reading(library)).collect()
    assert [(r["series_name"], r["total_books"], r["books_read"], r["status"], [b["title"] for b in r["unread_books"]]) for r in got] == [("Water", 3, 1, "partial", ["Lake"]), ("Stone", 1, 0, "not_started", ["Rock"])]
    assert series.series_summary(reading(library)).first().asDict() == {"total_series": 2, "complete": 0, "partial": 1, "not_started": 1, "standalone": 2}


def test_recommendations(library):
    s = reading(library)
    assert rows(recommend.candidates(s, "audiobook"), "title", "similarity_score") == [("Alone", 0.95), ("Lake", 0.95), ("Moor", 0.95), ("Pond", 0.95)]
    assert rows(recommend.candidates(s, "ebook", "love"), "title") == [("Lake",)]
    assert rows(recommend.web_recommendations(s, "ebook"), "title", "category", "thumbs_up") == [("Alone", "History", False), ("Lake", "Fiction", True), ("Lake", "Love", True)]
    assert rows(recommend.web_recommendations(s, "ebook", distinct=True), "title") == [("Alone",), ("Lake",)]
    assert rows(recommend.hidden_section(s, "ebook"), "author", "n") == [("Ann Lee", 1)]
    assert [r["title"] for r in recommend.books_to_read(s).collect()] == ["New", " lake"]
    plan, saved = recommend.save(s, recommend.candidates(s, "ebook"), at())
    assert rows(plan.groupBy("action").count()) == [("insert", 3), ("update", 2)]
    assert rows(recommend.save(saved, recommend.candidates(s, "ebook"), at())[0].groupBy("action").count()) == [("update", 5)]


def test_feedback(spark, library):
    s = reading(library)
    events = spark.createDataFrame([("Lake", "Jane Roe", "ebook", "thumbs_down", 1), ("LAKE ", "Jane Roe", "ebook", "duplicate", 2), ("Fresh", "Bo", "ebook", "thumbs_up", 3), ("", "Bo", "ebook", "thumbs_up", 4), ("Lake", "Jane Roe", "ebook", "thumbs_up", 0)], "title string, author string, format string, action string, s long").withColumn("at", F.timestamp_seconds("s"))
    plan, new = feedback.apply_feedback(s, events, at())
    assert rows(plan) == [(1, "update"), (5, "insert")]
    got = {r["id"]: r for r in new.recommendations.collect()}
    assert (got[1]["thumbs_up"], got[1]["thumbs_down"], got[1]["duplicate"]) == (False, True, True)
    assert (got[5]["thumbs_up"], got[5]["thumbs_down"], got[5]["non_english"]) == (True, False, False)
    names = spark.createDataFrame([("JANE ROE",), ("Nobody",)], "name string")
    plan, hidden = feedback.set_hidden(s, names, True, at())
    assert rows(plan) == [("jane roe", 1), ("nobody", None)] and rows(hidden.authors, "id", "hidden") == [(1, True), (2, True)]
    plan, moved = feedback.recategorize(s, spark.createDataFrame([("Lake", "Jane Roe"), ("Alone", "Jane Roe")], "title string, author string"))
    assert rows(plan) == [(2, "Fiction, Love", "Fiction, Love, Non-Fiction"), (4, "History", "Fiction")]


def test_cleanup_and_duplicates(library):
    s = library(
        authors=("id long, name string, normalized_name string", [(1, "Jane Roe", "Jane Roe")]),
        catalog=("id long, author_id long, title string, isbn string", [(1, 1, "Sea", None), (2, 1, "Sea [1/2]", "978"), (3, 1, "Sea (French Edition)", None), (4, 1, "Lake", None)]),
        books=("id long, title string, author string", [(1, "Sea", "Jane Roe"), (2, "sea ", "jane roe"), (3, "Sea", "Bo")]),
    )
    assert rows(catalog.duplicate_titles(s)) == [("books", 2, 1), ("catalog", 1, 2), ("catalog", 3, 2)]
    plan, clean = catalog.cleanup_non_english(s)
    assert rows(plan) == [(3, "Sea (French Edition)", "title")] and clean.catalog.count() == 3
    assert catalog.duplicate_titles(catalog.remove_duplicate_titles(s)[1]).count() == 0
    assert rows(catalog.sliced(s.catalog, 2, 1), "id") == [(2,), (3,)]


def test_fetch_catalog(spark, library):
    s = library(
        authors=("id long, name string, normalized_name string", [(1, "Jane Roe", "Jane Roe"), (2, "Ann Lee", "Ann Lee")]),
        books=("id long, title string, author string", [(1, "New One", "Jane Roe")]),
        catalog=("id long, author_id long, title string, isbn string, open_library_key string, is_read boolean", [(1, 1, "Known", None, "/works/1", False), (2, 1, "Same Title", None, None, False), (3, 2, "Theirs", "555", None, False)]),
    )
    payloads = spark.createDataFrame(
        [
            ("/works/1", json.dumps({"title": "Known"})), ("/works/2", json.dumps({"title": "same title", "isbn_13": ["978"]})), ("/works/3", json.dumps({"title": "New One (Saga Book #2)", "authors": [{"author": {"key": "OL1A"}}]})),
            ("/works/4", json.dumps({"title": "Theirs"})), ("/works/5", json.dumps({"title": "Neuf", "languages": [{"key": "/languages/fre"}]})), ("/works/6", "{}"),
            ("/works/7", json.dumps({"title": "Explicit", "series": [{"name": "Row"}], "series_position": 4, "languages": ["eng"], "first_publish_date": "May 1999"})),
        ],
        "key string, payload string",
    )
    works = read_works(payloads).withColumn("author_id", F.lit(1).cast("long"))
    editions = read_editions(spark.createDataFrame([("/works/3", json.dumps({"entries": [{"languages": [{"key": "/languages/ger"}]}, {"languages": ["eng"], "isbn_10": ["10"], "publish_date": "2001"}]}))], "key string, payload string"))
    plan, new = catalog.fetch_catalog(s, works, editions, at())
    assert rows(plan, "key", "action") == [("/works/2", "update"), ("/works/3", "insert"), ("/works/7", "insert")]
    got = {r["open_library_key"]: r for r in new.catalog.collect()}
    assert (got["/works/3"]["series_name"], got["/works/3"]["series_position"], got["/works/3"]["isbn"], got["/works/3"]["is_read"]) == ("Saga", 2, "10", True)
    assert (got["/works/7"]["series_name"], got["/works/7"]["series_position"]) == ("Row", 4) and got["/works/2"]["id"] == 2 and got["/works/2"]["isbn"] == "978"
    recent, _ = catalog.fetch_catalog(s, works, editions, at(), recent_years=3)
    assert rows(recent, "key") == [("/works/2",)]
    assert rows(read_works(payloads).filter("key = '/works/3'").select(F.explode("author_keys"))) == [("/authors/OL1A",)]
    volume = spark.createDataFrame([("k", json.dumps({"items": [{"id": "g", "volumeInfo": {"title": "T", "subtitle": "Book 2", "language": "en-GB", "categories": ["A"]}}]}))], "key string, payload string")
    assert rows(read_volumes(volume), "title", "series_name", "series_position", "english") == [("T", "T", 2, True)]


def test_authors(spark, library):
    s = library(
        authors=("id long, name string, normalized_name string, open_library_id string", [(1, "Julia R. Kelly", "Julia R. Kelly", None), (2, "Julia Kelly", "Julia Kelly", "/authors/O"), (3, "Ann Lee, Bob Ray", "Ann Lee", None), (4, "Foo Press", "Other Words", None)]),
        catalog=("id long, author_id long, title string, open_library_key string", [(1, 1, "Sea", "w1"), (2, 1, "Lake", "w2"), (3, 2, "sea ", None), (4, 2, "Hill", None), (5, 3, "Ray of Light", None), (6, 3, "Other", None), (7, 4, "X", None)]),
        books=("id long, title string, author string, isbn string", [(1, "Sea", "Julia R. Kelly", None), (2, "Sea", "Julia Kelly", None), (3, "Moor", "Julia Kelly", None)]),
        recommendations=("id long, title string, author string, format string", [(1, "X", "Foo Press", "ebook")]),
    )
    assert rows(authors.duplicate_authors(s), "id1", "id2", "overlap", "confidence") == [(1, 2, 1, "high")]
    plan, merged = authors.merge_authors(s, "julia r. kelly", 2, keep=1)
    assert rows(plan, "table", "id", "action") == [("books", 2, "delete"), ("books", 3, "move"), ("catalog", 3, "delete"), ("catalog", 4, "move")]
    assert rows(merged.authors, "id", "open_library_id") == [(1, "/authors/O"), (3, None), (4, None)] and rows(merged.books, "id", "author") == [(1, "Julia R. Kelly"), (3, "Julia R. Kelly")]
    with pytest.raises(ValueError):
        authors.merge_authors(s, 1, 1)
    plan, split = authors.split_groups(s)
    assert rows(plan, "id", "member", "how") == [(5, "Bob Ray", "last_name"), (6, "Ann Lee", "first")]
    assert rows(split.authors, "name") == [("Ann Lee",), ("Bob Ray",), ("Foo Press",), ("Julia Kelly",), ("Julia R. Kelly",)]
    assert rows(authors.name_mismatches(s), "id", "fixed_name") == [(3, "Ann Lee"), (4, "Foo Press")]
    assert rows(authors.fix_name_mismatches(s)[1].authors.filter("id = 4"), "normalized_name") == [("Foo Press",)]
    assert rows(authors.remove_authors(s, ["foo press"])[0]) == [("authors", 4), ("catalog", 7), ("recommendations", 1)]
    assert rows(authors.reassign_author(s, 4, 1)[0]) == [("catalog", 7), ("recommendations", 1)]
    assert rows(authors.publisher_authors(s), "id", "label") == [(4, "Press/Publishing")]
    works = spark.createDataFrame([("w1", "/authors/A"), ("w2", "/authors/B")], "key string, author_key string")
    titles = spark.createDataFrame([("/authors/A", "SEA"), ("/authors/B", "none")], "author_key string, title string")
    plan, fixed = authors.fix_mixed_identities(s, works, titles, spark.createDataFrame([("/authors/B", "Another Kelly")], "author_key string, name string"), at())
    assert rows(plan, "author_id", "author_key", "to_id", "target") == [(1, "/authors/B", 5, "Another Kelly")]
    assert rows(fixed.catalog.filter("id = 2"), "author_id") == [(5,)]


def test_curation(library):
    s = library(
        authors=("id long, name string, normalized_name string", [(1, "Jane Roe", "Jane Roe")]),
        catalog=(
            "id long, author_id long, title string, series_name string, series_position int, is_read boolean",
            [(1, 1, "The Secret/The Revealing", "Duo", 1, False), (2, 1, "Secret", None, None, False), (3, 1, "The Revealing (Large)", None, None, False), (4, 1, "Books 1-5", None, None, False), (5, 1, "Macroeconomics Now", None, None, False), (6, 1, "For Ages 8-12", None, None, False)],
        ),
    )
    found = {r["composite_id"]: r for r in curation.composites(s).collect()}
    assert found[4]["confidence"] == "low" and found[1]["confidence"] == "high"
    assert [(m["standalone_id"], m["score"]) for m in found[1]["matches"]] == [(2, 1.0), (3, 0.8)]
    _, done = curation.remove_composites(s)
    assert rows(done.catalog, "id", "series_name", "series_position") == [(2, "Duo", 1), (3, "Duo", 2), (5, None, None), (6, None, None)]
    assert rows(curation.childrens_books(s), "id") == [(6,)]
    plan, kept = curation.delete_rows(s, curation.childrens_books(s), keep_numbers=[1])
    assert plan.count() == 0 and kept.catalog.count() == 6
    assert rows(curation.filter_books(s)[0], "id") == [(5,)]
    assert rows(series.consolidations(s)) == []


def test_consolidations(library):
    s = library(catalog=("id long, author_id long, series_name string, series_position int, title string", [(1, 1, "Amish Series", 1, "a"), (2, 1, "amish", 2, "b"), (3, 1, "The Amish Series", 3, "c"), (4, 1, "Lone", 1, "d"), (5, 2, "Row", 1, "e"), (6, 2, "row", 5, "f")]))
    assert rows(series.consolidations(s), "series_key", "canonical", "confidence") == [("amish", "Amish Series", "high"), ("row", "Row", "medium")]
    assert rows(series.consolidate(s, [1])[1].catalog, "id", "series_name") == [(1, "Amish Series"), (2, "Amish Series"), (3, "Amish Series"), (4, "Lone"), (5, "Row"), (6, "row")]


def plain_groups(items, contained):
    """The groupings again, over plain loops."""

    def sim(a, b):
        if not a or not b:
            return 0.0
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, d[j + 1] + 1, d[j] + (x != y)))
            d = new
        return 1 - d[-1] / max(len(a), len(b))

    fuzzy, inside = {}, {}
    for (i, ni, bi, _), (j, nj, bj, _) in itertools.combinations(items, 2):
        if max(sim(ni, nj), sim(bi, bj)) >= 0.85:
            fuzzy.setdefault(i, []).append(j)
        if bi and bj and (bi == bj or ((bi in bj or bj in bi) and abs(len(bi) - len(bj)) < 30 and min(len(bi), len(bj)) >= 3)):
            inside.setdefault(i, []).append(j)
    ids = [i for i, *_ in items]
    return grouped(ids, {i: n for i, n, _, _ in items}, {i: b for i, _, b, _ in items}, {i: s for i, _, _, s in items}, fuzzy, inside if contained else None)


def test_duplicate_groups_find_all_edges(spark):
    rnd = random.Random(5)
    words = ["sea", "seas", "the long lake", "the long lakes", "ruby", "ruby river", "hill", "hall"]
    data = []
    for i in range(60):
        w = rnd.choice(words)
        data.append(("x" if i % 2 else "y", i, w, w.split()[0], rnd.choice(["", "", "978"]), i % 3))
    df = spark.createDataFrame(data, "owner string, id long, norm string, base string, isbn_key string, score int")
    got = dedupe.duplicate_groups(df, True).collect()
    for owner in "xy":
        mine = [(i, n, b, s) for o, i, n, b, s, _ in data if o == owner]
        want = {(k, tuple(m)) for k, m in plain_groups(mine, True)}
        found = {}
        for r in got:
            if r["owner"] == owner:
                found.setdefault(r["group_key"], []).append(r["id"])
        assert {(k, tuple(m)) for k, m in found.items()} == want


def test_grouping_order():
    keys = {1: "a", 2: "a", 3: "b", 4: "c"}
    none = dict.fromkeys(keys, "")
    found = grouped([1, 2, 3, 4], keys, none, none, {2: [3], 3: [4]}, {3: [4]})
    assert found == [("exact:a", [1, 2]), ("fuzzy:2", [2, 3]), ("contained:4", [4])] or [g[0] for g in found] == ["exact:a", "fuzzy:2"]


def test_recommendation_duplicates_query_sees_copies(library):
    """Copies whose first row has feedback against it are still looked at, all of them."""
    from shelfwise.plans import queries

    data = [(1, "Sea", "A", True), (2, "Sea", "A", None), (3, "Sea", "A", None)] + [(10 + k, t, "A", None) for k, t in enumerate(["Lake", "Hill", "Ruby moon", "Winter", "Bread", "Copper", "Orchid", "Thunder"])]
    s = library(recommendations=("id long, title string, author string, thumbs_down boolean", data))
    got = queries.q19_recommendation_duplicates(s)
    assert rows(got.select("group_key", "n", "id")) == [("exact:sea", 2, 2), ("exact:sea", 2, 3)]


def test_recommendation_reasons(library):
    from shelfwise.plans import queries

    titles = ["Sea", "Sea", "Lake", "Hill", "Ruby moon", "Winter", "Bread", "Copper", "Orchid", "Thunder"]
    s = library(recommendations=("id long, title string, author string, isbn string", [(k, t, "A", None) for k, t in enumerate(titles, 1)]))
    ((owner, key, keep, gone, reasons),) = rows(queries.q21_recommendation_reasons(s))
    assert (owner, key, {keep, gone}) == ("A", "exact:sea", {1, 2}) and "exact_normalized" in reasons


def test_audit_covers_all_authors(library):
    from shelfwise.plans import queries

    s = library(catalog=("id long, author_id long, title string, isbn string", [(1, 1, "Sea", None), (2, 1, "Sea", None), (3, 2, "Sea", None)]))
    assert rows(queries.q23_audit(s), "id", "same_title") == [(1, 2), (2, 2), (3, 1)]


def test_reports_and_approvals(spark, library, tmp_path):
    s = library(
        catalog=("id long, author_id long, title string, isbn string", [(i, 1, t, None) for i, t in enumerate(["Sea", "The Sea", "Sea!", "Lake"], 1)]),
        recommendations=("id long, catalog_book_id long, title string, author string, format string, duplicate boolean", [(1, 2, "x", "y", "ebook", None)]),
    )
    why = dedupe.sure(dedupe.explained(dedupe.catalog_duplicates(s, 1), s.catalog))
    assert {(r["id"], r["confidence"]) for r in why.collect()} >= {(2, "high")}
    doc = {"analysis_date": "d", "min_books": 1, "authors": [{"author_id": 1, "author_name": "J", "duplicate_details": [{"group_key": "g", "keep": {"id": 1}, "remove": [{"id": 2, "reasons": ["isbn_match"]}], "pattern_types": [], "count": 2}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    (tmp_path / "a.json").write_text(json.dumps({"group_keys": ["g"]}))
    removals, ok = read_report(spark, str(tmp_path / "r.json")), read_approvals(spark, str(tmp_path / "a.json")).first()
    assert ok["group_keys"] == ["g"]
    plan, new = dedupe.approve(s, removals, group_keys=ok["group_keys"])
    assert rows(plan, "remove_id") == [(2,)] and rows(new.catalog, "id") == [(1,), (3,), (4,)] and rows(new.recommendations, "duplicate") == [(True,)]
    assert dedupe.approve(s, removals)[0].count() == 0
    assert report.histogram(why, "reasons", 1).count() == 1


def test_document_client(spark, tmp_path):
    client = DocumentClient(spark, str(tmp_path / "cache"), Limits(pause=0), get=lambda url, limits: (200, {}, json.dumps({"url": url})) if "q=a" in url else (404, {}, ""), sleep=lambda s: None)
    end, params = client.search_author("a")
    asked = spark.createDataFrame([("http://h", end, json.dumps(params)), ("http://h", end, json.dumps({"q": "b"}))], "host string, endpoint string, params string")
    assert rows(client.fetch(asked), "payload") == [('{"url": "http://h/search/authors.json?q=a"}',), ("{}",)]
    assert client.cached().count() == 1  # what came back empty is asked again
    # A host that goes down keeps what it answered before; nothing is asked again by a retry.
    def failing(url, limits):
        with open(tmp_path / "asked", "a") as f:
            f.write(url + "\n")
        return (200, {}, '{"ok": 1}') if int(url.rsplit("=", 1)[1]) < 6 else (0, {}, "")

    down = DocumentClient(spark, str(tmp_path / "cache2"), Limits(pause=0, errors=2, tasks=1), get=failing, sleep=lambda s: None)
    many = spark.createDataFrame([("http://h", "/e", json.dumps({"q": i})) for i in range(10)], "host string, endpoint string, params string")
    with pytest.raises(HostDown):
        down.fetch(many)
    assert down.cached().count() == 6 and len(open(tmp_path / "asked").read().split()) == 8
    waits, answers = [], iter([(429, {"Retry-After": "500"}, ""), (429, {}, ""), (200, {}, "[1]")])
    assert request("u", Limits(), lambda u, limits: next(answers), waits.append) == "[1]"
    assert waits == [0.5, 120.0, 0.5, 60.0, 0.5]


def test_store_and_migration(spark, library, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "lib"))
    assert store.version() == 0 and store.load().books.count() == 0
    s = reading(library)
    assert store.publish(s) == 1 and store.publish(store.load()) == 2
    assert rows(store.load().catalog) == rows(s.catalog) and store.load(1).authors.count() == 2
    old = conform(spark.createDataFrame([(1, "n", "n")], "id long, name string, normalized_name string"), "authors")
    assert old.first()["hidden"] is False and old.first()["hidden_at"] is None


def test_a_publish_that_dies_and_two_writers(spark, library, tmp_path):
    from shelfwise.store import Conflict

    path = str(tmp_path / "lib")
    one, two = SnapshotStore(spark, path), SnapshotStore(spark, path)
    s = reading(library)
    assert one.publish(s) == 1
    one.load(), two.load()
    # Cut before the rename: the version is as it was, and the next publish goes on from it.
    rename, one._fs = one._fs, type("Cut", (), {"__getattr__": lambda self, name: (_ for _ in ()).throw(KeyboardInterrupt()) if name == "rename" else getattr(rename, name)})()
    with pytest.raises(KeyboardInterrupt):
        one.publish(s)
    one._fs = rename
    assert two.version() == 1 and two.load().authors.count() == 2
    assert two.publish(s) == 2
    with pytest.raises(Conflict):
        one.publish(s)
    assert one.version() == 2 and one.load().authors.count() == 2 and one.publish(s) == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.csv", HEADER + "Sea,Jane Roe,,Orbit,,,,\n")
    store = SnapshotStore(spark, str(tmp_path / "lib"))
    stream_loans(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(120)
    write(tmp_path / "in/b.csv", HEADER + "Lake,Jane Roe,,Orbit,,,,\nSea,Jane Roe,,,,,,\n")
    stream_loans(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(store.load().books, "title") == [("Lake",), ("Sea",)]
    assert rows(store.load().metadata.filter("key LIKE 'stream:%'"), "value") == [("1",)]
    events = spark.createDataFrame([("e1", "ebook", "thumbs_up", 1), ("e1", "ebook", "thumbs_up", 1), ("e2", "ebook", "thumbs_up", 2)], "event_id string, format string, action string, s long").withColumn("at", F.timestamp_seconds("s"))
    events.write.parquet(str(tmp_path / "ev"))
    stream = latest_feedback(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("fb").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("fb"), "format", "action", "n") == [("ebook", "thumbs_up", 2)]
