"""A JSON interface over HTTP, for a browser or scripts: python -m shelfwise.api PATH [PORT].

GET  /api/status, /api/series, /api/recommendations/<format>, /api/books-to-read
POST /api/recommendations/<format>/<feedback | flag-non-english | flag-already-read | flag-duplicate | recategorize>
     /api/authors/<name>/<hide | unhide>

Lists come in pages: ?limit= (1000, if none is given; 10000 at most) and ?offset=, with the total beside them.

What it serves is the newest version of the library; each change publishes one. Requests are taken one at a time."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import feedback, recommend, report, series
from .session import get_session
from .store import SnapshotStore

FORMATS = ("audiobook", "ebook")
FLAG_PATHS = {"flag-non-english": "non_english", "flag-already-read": "already_read", "flag-duplicate": "duplicate"}


PAGE, MOST = 1000, 10_000


def items(df: DataFrame) -> list:
    """Rows of a frame that is small by nature or paged."""
    return [json.loads(x) for x in df.toJSON().collect()]


def page(df: DataFrame, query: str, *order) -> tuple[list, int]:
    """A page of df in the given order, and the number of all rows."""
    given = parse_qs(query)
    number = lambda name, default: int(given[name][0]) if given.get(name, [""])[0].isdigit() else default
    return items(df.orderBy(*order).offset(number("offset", 0)).limit(min(MOST, number("limit", PAGE)))), df.count()


class Library:
    def __init__(self, store: SnapshotStore):
        self.store, self.spark = store, store.spark

    def get(self, path: str) -> tuple[int, object]:
        state, (path, _, query) = self.store.load(), path.partition("?")
        parts = [unquote(p) for p in path.strip("/").split("/")]
        match parts:
            case ["api", "status"]:
                return 200, items(report.status(state, F.current_timestamp()))[0]
            case ["api", "series"]:
                rows, total = page(series.analyze_series(state), query, "author_id", "series_name")
                return 200, {"series": rows, "total": total, "summary": items(series.series_summary(state))[0]}
            case ["api", "books-to-read"]:
                rows, total = page(recommend.books_to_read(state), query, "author", F.desc("similarity_score"), "id")
                return 200, {"books": rows, "total": total}
            case ["api", "recommendations", fmt] if fmt in FORMATS:
                shown = recommend.web_recommendations(state, fmt)
                rows, total = page(shown, query, *(c for c in ("author", "title", "catalog_id", "category") if c in shown.columns))
                return 200, {"recommendations": rows, "total": total, "hidden": page(recommend.hidden_section(state, fmt), query, "author")[0]}
        return 404, {"error": "not found"}

    def post(self, path: str, body: dict) -> tuple[int, object]:
        state, now, parts = self.store.load(), F.current_timestamp(), [unquote(p) for p in path.strip("/").split("/")]
        match parts:
            case ["api", "recommendations", fmt, what] if fmt in FORMATS:
                title, author = (str(body.get(k) or "").strip() for k in ("title", "author"))
                if not title or not author:
                    return 400, {"error": "title and author are needed"}
                if what == "recategorize":
                    plan, new = feedback.recategorize(state, self.spark.createDataFrame([(title, author)], "title string, author string"))
                else:
                    action = FLAG_PATHS.get(what) or ("thumbs_up" if body.get("thumbs_up") else "thumbs_down" if body.get("thumbs_down") else None)
                    if action is None or what not in (*FLAG_PATHS, "feedback"):
                        return 400, {"error": "no such action"}
                    event = self.spark.createDataFrame([(title, author, fmt, action)], "title string, author string, format string, action string").withColumn("at", now)
                    plan, new = feedback.apply_feedback(state, event, now)
            case ["api", "authors", name, what] if what in ("hide", "unhide"):
                plan, new = feedback.set_hidden(state, self.spark.createDataFrame([(name,)], "name string"), what == "hide", now)
                if plan.filter("id IS NOT NULL").isEmpty():
                    return 404, {"error": "no such author"}
            case _:
                return 404, {"error": "not found"}
        done = items(plan)
        if not done:
            return 404, {"error": "no such book"}
        if body.get("dry_run") is True:
            return 200, {"would": done}
        return 200, {"done": done, "version": self.store.publish(new)}


def handler(library: Library) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, payload: object) -> None:
            data = json.dumps(payload).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send(*library.get(self.path))

        def do_POST(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}"
            try:
                body = json.loads(raw)
            except ValueError:
                body = None
            self._send(*(library.post(self.path, body) if isinstance(body, dict) else (400, {"error": "a JSON object is needed"})))

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(path: str, port: int = 5001) -> HTTPServer:
    return HTTPServer(("127.0.0.1", port), handler(Library(SnapshotStore(get_session(), path))))


if __name__ == "__main__":
    serve(sys.argv[1], *(int(p) for p in sys.argv[2:3])).serve_forever()
