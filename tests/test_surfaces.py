"""Command line and HTTP on a small library, and the operators they share with fetching."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from shelfwise import api, cli
from shelfwise.operators import authors, catalog
from shelfwise.schema import LibraryState
from shelfwise.sources.documents import HostDown, Limits, request
from shelfwise.store import SnapshotStore


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "loans.csv").write_text('title,author,isbn,publisher,timestamp\nSea,Jane Roe,,Tantor Media,"January 12, 2026 02:51"\n')
    db = str(tmp_path / "lib")
    cli.main(["--db", db, "ingest", str(tmp_path / "*.csv")])
    s = SnapshotStore(spark, db)
    state = s.load()
    more = spark.createDataFrame([(1, 1, "Lake", "Fiction", False), (2, 1, "Lake", None, False), (3, 1, "Mer (French Edition)", None, False)], "id long, author_id long, title string, categories string, is_read boolean")
    s.publish(state.with_(catalog=more))
    return s


def test_command_line(spark, store, capsys, monkeypatch):
    db = store.path
    assert store.load().books.count() == 1 and store.load().authors.first()["name"] == "Jane Roe"
    cli.main(["--db", db, "remove-duplicates", "--dry-run"])
    assert store.load().catalog.count() == 3
    monkeypatch.setattr("builtins.input", lambda prompt: "no")
    cli.main(["--db", db, "remove-duplicates"])
    assert store.load().catalog.count() == 3 and "Cancelled." in capsys.readouterr().out
    monkeypatch.setattr("builtins.input", lambda prompt: "Yes ")
    cli.main(["--db", db, "remove-duplicates"])
    cli.main(["--db", db, "cleanup", "--yes", "--titles-only"])
    assert [r["title"] for r in store.load().catalog.collect()] == ["Lake"]
    cli.main(["--db", db, "recommend", "audiobook", "--save"])
    assert [r["title"] for r in store.load().recommendations.collect()] == ["Lake"]
    cli.main(["--db", db, "feedback", "audiobook", "thumbs_up", "Lake", "Jane Roe"])
    for command in (["status"], ["series"], ["list-authors", "--search", "roe"], ["catalog", "--list-due"], ["merge-authors"], ["fix-names"], ["composites", "--yes"], ["childrens", "--yes", "--keep", "1,2"], ["verify-cleanup"], ["review-cleanup"], ["duplicates", "prolific"], ["recommend", "ebook", "--category", "Fiction"]):
        cli.main(["--db", db, *command])
    assert "Jane Roe" in capsys.readouterr().out


def test_maintenance_commands(spark, tmp_path, capsys):
    db = str(tmp_path / "lib")
    SnapshotStore(spark, db).publish(LibraryState.of(
        spark, authors=spark.createDataFrame([(1, "Jane Roe", "Jane Roe"), (2, "Big Press", "Big Press"), (3, "Ann Lee, Bob Ray", "Ann Lee")], "id long, name string, normalized_name string"),
        catalog=spark.createDataFrame([(1, 1, "Sea (Saga #2)", None), (2, 1, "Macroeconomics", None), (3, 2, "Catalog", None), (4, 1, "Alone", None)], "id long, author_id long, title string, series_name string"),
    ))
    titles = lambda: sorted(r["title"] for r in SnapshotStore(spark, db).load().catalog.collect())
    for command in (["publisher-authors"], ["standalone"], ["audit"], ["audit", "--author-id", "1"], ["inspect", "--top", "2"], ["filter-books", "--dry-run"], ["extract-series", "--dry-run"]):
        cli.main(["--db", db, *command])
    shown = capsys.readouterr().out
    assert "authors_with_catalog" in shown and "Alone" in shown and len(titles()) == 4
    cli.main(["--db", db, "filter-books", "--yes"])
    cli.main(["--db", db, "extract-series"])
    assert titles() == ["Alone", "Catalog", "Sea (Saga #2)"] and SnapshotStore(spark, db).load().catalog.filter("series_name = 'Saga'").count() == 1
    cli.main(["--db", db, "reassign", "--yes", "--source-id", "2", "--target-id", "1"])
    assert {r["author_id"] for r in SnapshotStore(spark, db).load().catalog.collect()} == {1}
    cli.main(["--db", db, "split-groups", "--yes"])
    cli.main(["--db", db, "remove-authors", "--yes", "--names", "press", "--substring"])
    assert {"Ann Lee", "Bob Ray", "Jane Roe"} >= {r["name"] for r in SnapshotStore(spark, db).load().authors.collect()}
    with pytest.raises(SystemExit):
        cli.main(["--db", db, "reassign", "--yes"])


class Host(threading.Thread):
    """A stub of the two book APIs; answers by path, and counts what it was asked."""

    def __init__(self, answers):
        super().__init__(daemon=True)
        asked = self.asked = []

        class Handler(api.BaseHTTPRequestHandler):
            def do_GET(self):
                asked.append(self.path)
                found = answers.get(self.path.split("?")[0])
                body = json.dumps(found(self.path) if callable(found) else found).encode()
                self.send_response(200 if found is not None else 404)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = api.HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def run(self):
        self.server.serve_forever()


def test_catalog_is_fetched(spark, store, capsys):
    """The author is found by a title that was read; known works aren't asked for; the next run is answered by the cache."""
    english = [{"key": "/languages/eng"}]
    host = Host({
        "/search/authors.json": {"docs": [{"key": "OL9A"}, {"key": "OL1A"}]},
        "/authors/OL9A/works.json": {"entries": [{"key": "/works/OL90W", "title": "Other"}]},
        "/authors/OL1A/works.json": {"entries": [{"key": "/works/OL1W", "title": "Sea"}, {"key": "/works/OL2W", "title": "Hill"}, {"key": "/works/OL3W", "title": "Libro"}]},
        "/works/OL1W.json": {"title": "Sea", "languages": english}, "/works/OL2W.json": {"languages": english, "isbn_10": ["123"]}, "/works/OL3W.json": {"title": "Libro", "languages": [{"key": "/languages/spa"}]},
        "/works/OL1W/editions.json": {"entries": [{"languages": english, "publish_date": "May 2001", "isbn_13": ["978"]}]}, "/works/OL2W/editions.json": {"entries": []},
        "/works/OL3W/editions.json": {"entries": [{"languages": [{"key": "/languages/spa"}]}]},
    })
    host.start()
    flags = ["--host", host.url, "--pause", "0"]
    cli.main(["--db", store.path, "catalog", "--force", *flags])
    state = store.load()
    assert sorted((r["title"], r["isbn"], r["publication_date"], r["is_read"]) for r in state.catalog.filter("open_library_key IS NOT NULL").collect()) == [("Hill", "123", None, False), ("Sea", "978", "May 2001", True)]
    assert state.authors.first()["open_library_id"] == "/authors/OL1A"
    assert "/search/authors.json?q=Jane+Roe" in host.asked and any(p.startswith("/authors/OL1A/works.json?limit=200") for p in host.asked)
    before = len(host.asked)
    cli.main(["--db", store.path, "catalog", "--force", *flags])
    assert all("OL3W" in p or "editions" in p for p in host.asked[before:])  # empty answers only
    assert store.load().catalog.filter("open_library_key IS NOT NULL").count() == 2
    host.server.shutdown()


def test_authors_are_fixed_from_the_network(spark, tmp_path, monkeypatch):
    db = str(tmp_path / "lib")
    store = SnapshotStore(spark, db)
    store.publish(LibraryState.of(
        spark, authors=spark.createDataFrame([(1, "Jane Roe", "Jane Roe")], "id long, name string, normalized_name string"), books=spark.createDataFrame([(1, "Sea", "Jane Roe")], "id long, title string, author string"),
        catalog=spark.createDataFrame([(1, 1, "Sea", "/works/OL1W"), (2, 1, "Law", "/works/OL2W"), (3, 1, "Tax", "/works/OL3W")], "id long, author_id long, title string, open_library_key string"),
    ))
    host = Host({
        "/works/OL1W.json": {"title": "Sea", "authors": [{"author": {"key": "/authors/OL1A"}}]}, "/works/OL2W.json": {"title": "Law", "authors": [{"key": "OL2A"}]}, "/works/OL3W.json": {"title": "Tax", "authors": ["/authors/OL2A"]},
        "/authors/OL1A/works.json": {"entries": [{"key": "/works/OL1W", "title": "Sea"}]}, "/authors/OL2A/works.json": {"entries": [{"key": "/works/OL2W", "title": "Law"}]}, "/authors/OL2A.json": {"name": "Jane Roe, LLM"},
    })
    host.start()
    cli.main(["--db", db, "fix-authors", "--dry-run", "--host", host.url, "--pause", "0"])
    assert store.load().authors.count() == 1
    cli.main(["--db", db, "fix-authors", "--yes", "--limit", "5", "--host", host.url, "--pause", "0"])
    state = store.load()
    assert sorted((r["id"], r["name"], r["open_library_id"]) for r in state.authors.collect()) == [(1, "Jane Roe", None), (2, "Jane Roe, LLM", "/authors/OL2A")]
    assert sorted((r["id"], r["author_id"]) for r in state.catalog.collect()) == [(1, 1), (2, 2), (3, 2)]
    host.server.shutdown()


def test_http(store):
    server = api.HTTPServer(("127.0.0.1", 0), api.handler(api.Library(store)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        req = urllib.request.Request(base + path, data=None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(req, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/api/recommendations/audiobook")[1]["total"] == 2
    for path, body in (("recommendations/audiobook/flag-duplicate", {"title": "Lake", "author": "Jane Roe"}), ("recommendations/audiobook/recategorize", {"title": "Lake", "author": "Jane Roe"}), ("authors/jane%20roe/hide", {})):
        status, answer = call(f"/api/{path}", body | {"dry_run": True})
        assert status == 200 and answer["would"] and "version" not in answer
    assert call("/api/recommendations/audiobook")[1]["total"] == 2
    assert call("/api/recommendations/audiobook/feedback", {"title": "Lake", "author": "Jane Roe", "thumbs_up": True})[0] == 200
    assert [b["title"] for b in call("/api/books-to-read")[1]["books"]] == ["Lake"]
    assert call("/api/recommendations/audiobook/flag-duplicate", {"title": "Lake", "author": "Jane Roe"})[0] == 200
    assert call("/api/recommendations/audiobook")[1]["total"] == 0
    assert call("/api/recommendations/audiobook/feedback", {"title": " "})[0] == 400
    assert call("/api/recommendations/audiobook/recategorize", {"title": "Lake", "author": "Jane Roe"})[1]["done"][0]["new_categories"] == "Fiction, Non-Fiction"
    assert call("/api/authors/jane%20roe/hide", {})[0] == 200 and call("/api/authors/nobody/hide", {})[0] == 404
    first = call("/api/recommendations/ebook?limit=1&offset=0")[1]
    assert len(first["recommendations"]) <= 1 <= first["total"] + 1
    assert call("/api/status")[1]["books"] == 1 and call("/api/series")[0] == 200 and call("/nothing")[0] == 404
    server.shutdown()


def test_candidates_and_duplicate_names(spark):
    found = spark.createDataFrame([("Jane Roe", 0, "OL1A"), ("Jane Roe", 1, "/authors/OL2A"), ("Bo", 0, "/OL3A")], "author string, rank int, author_key string")
    works = spark.createDataFrame([("OL1A", 0, "x"), ("OL2A", 0, "SEA "), ("OL2A", 30, "y")], "author_key string, pos int, title string")
    books = spark.createDataFrame([(1, "Sea", "Jane Roe"), (2, "None", "Bo")], "id long, title string, author string")
    assert sorted(tuple(r) for r in authors.pick_candidates(found, works, books).collect()) == [("Bo", "/authors/OL3A", False), ("Jane Roe", "/authors/OL2A", True)]
    state = LibraryState.of(
        spark, books=books,
        authors=spark.createDataFrame([(1, "Jane Roe", "Jane Roe", "OL1A"), (2, "Jane Roe, PhD", "Jane Roe", "OL2A"), (3, "Bo", "Bo", None)], "id long, name string, normalized_name string, open_library_id string"),
        catalog=spark.createDataFrame([(1, 1, "Lake"), (2, 1, "Hill"), (3, 2, "Hill"), (4, 3, "X")], "id long, author_id long, title string"),
    )
    plan, new = authors.fix_duplicate_names(state, works.select("author_key", "title"))
    assert sorted(tuple(r) for r in plan.select("id", "to_id", "action").collect()) == [(1, 2, "move"), (2, 2, "delete")]
    assert sorted(r["id"] for r in new.authors.collect()) == [2, 3] and sorted((r["id"], r["author_id"]) for r in new.catalog.collect()) == [(1, 2), (3, 2), (4, 3)]


def test_fetch_all(spark):
    now = F.to_timestamp(F.lit("2026-01-31 12:00:00"))
    state = LibraryState.of(spark, authors=spark.createDataFrame([(1, "Ann Lee, Bob Ray", "Ann Lee"), (2, "Jane Roe", "Jane Roe")], "id long, name string, normalized_name string"))
    none = "array<string>"
    works = spark.createDataFrame([(2, "w1", "Sea"), (2, "w2", "sea (Large Edition)"), (2, "w3", "Libro")], "author_id long, key string, title string")
    works = works.withColumns({"series_name": F.lit(None).cast("string"), "series_position": F.lit(None).cast("int"), "isbn": F.lit(None).cast("string"), "publication_date": F.lit("2025"), "languages": F.lit(None).cast(none)})
    editions = spark.createDataFrame([], "key string, pos int, title string, languages array<string>, isbn string, publication_date string")
    for years in (None, 3):
        plan, new = catalog.fetch_all(state, works, editions, now, recent_years=years, auto_cleanup=True)
        assert plan.count() == 3 and [r["title"] for r in new.catalog.collect()] == ["Sea"]
        assert sorted(r["name"] for r in new.authors.collect()) == ["Ann Lee", "Bob Ray", "Jane Roe"]


def test_host_that_does_not_answer():
    failed = []
    limits = Limits(pause=0, errors=3)
    down = lambda url, limits: (0, {}, "")
    assert request("u", limits, down, lambda s: None, failed) == "{}" and request("u", limits, lambda u, x: (404, {}, ""), lambda s: None, failed) == "{}" and failed == []
    assert request("u", limits, down, lambda s: None, failed) == request("u", limits, down, lambda s: None, failed) == "{}"
    with pytest.raises(HostDown):
        request("u", limits, down, lambda s: None, failed)
