"""The data source of the book APIs: pushed filters, one pace and one count of errors for all tasks, answers that survive."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from shelfwise.sources import DocumentClient
from shelfwise.sources.book_api import HostDown, Limits, Turns, cut, register

REQUESTS = "host string, endpoint string, params string"


@pytest.fixture
def host():
    """A stub that answers every call with its path, and notes when it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.time(), self.path))
            body = json.dumps({"path": self.path}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    server.asked, server.url = asked, f"http://127.0.0.1:{server.server_port}"
    yield server
    server.shutdown()


def test_filters_reach_a_mirror(spark, tmp_path):
    docs = [("author_works", f"OL{i}A", json.dumps({"entries": [{"key": k} for k in range(5)]})) for i in range(40)] + [("work", "OL1A", "not json")]
    spark.createDataFrame(docs, "kind string, key string, payload string").repartition(3).write.parquet(str(tmp_path / "m"))
    load = lambda: spark.read.format(register(spark)).option("mirror", str(tmp_path / "m")).load()
    found = load().filter("kind = 'author_works' AND key IN ('OL1A', 'OL7A', 'nobody') AND limit = 2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "book_api" in plan  # the source keeps no filter for Spark
    shown = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in shown and "OL7A" in shown and "EqualTo(limit,2)" in shown
    assert sorted((r["key"], len(json.loads(r["payload"])["entries"]), r["limit"]) for r in found.collect()) == [("OL1A", 2, 2), ("OL7A", 2, 2)]
    assert load().filter("kind = 'work'").first()["payload"] == "not json" and load().count() == 41
    assert load().filter("payload LIKE 'not%' AND key LIKE '%1A'").count() == 1  # what the source can't do, Spark does
    assert load().filter("kind = 'nothing'").count() == 0


def test_filters_become_calls(spark, host):
    source = spark.read.format(register(spark)).option("host", host.url).options(**Limits(pause=0, tasks=3).options()).load()
    rows = source.filter("kind = 'author_works' AND key IN ('/authors/OL1A', 'OL2A') AND limit = 7").collect()
    assert sorted(json.loads(r["payload"])["path"] for r in rows) == ["/authors/OL1A/works.json?limit=7", "/authors/OL2A/works.json?limit=7"]
    assert len(host.asked) == 2 and {r["key"] for r in rows} == {"/authors/OL1A", "OL2A"}
    with pytest.raises(Exception, match="filter by kind and key"):
        spark.read.format(register(spark)).option("host", host.url).load().filter("kind = 'work'").collect()


def test_four_tasks_share_one_pace(spark, host, tmp_path):
    client = DocumentClient(spark, str(tmp_path / "cache"), Limits(pause=0.3, tasks=4))
    asked = spark.createDataFrame([(host.url, "/e", json.dumps({"q": i})) for i in range(16)], REQUESTS)
    assert client.fetch(asked).filter("payload LIKE '%path%'").count() == 16
    times = sorted(t for t, _ in host.asked)
    assert len(times) == 16 and min(b - a for a, b in zip(times, times[1:])) > 0.2
    client.fetch(asked)
    assert len(host.asked) == 16  # the cache answers


def test_errors_of_all_tasks_count_together(spark, tmp_path):
    def failing(url, limits):
        with open(tmp_path / "asked", "a") as f:
            f.write(url + "\n")
        return 0, {}, ""

    client = DocumentClient(spark, str(tmp_path / "cache"), Limits(pause=0.3, tasks=4), get=failing)
    with pytest.raises(HostDown):
        client.fetch(spark.createDataFrame([("http://h", "/e", json.dumps({"q": i})) for i in range(40)], REQUESTS))
    assert len(open(tmp_path / "asked").read().split()) == 5


def test_an_answer_in_between_starts_the_count_anew(spark, tmp_path):
    def every_third(url, limits):
        return (200, {}, "{\"a\": 1}") if int(url.rsplit("=", 1)[1]) % 3 == 0 else (0, {}, "")

    client = DocumentClient(spark, str(tmp_path / "cache"), Limits(pause=0, tasks=1, errors=3), get=every_third)
    asked = spark.createDataFrame([("http://h", "/e", json.dumps({"q": i})) for i in range(9)], REQUESTS)
    assert client.fetch(asked).filter("payload <> '{}'").count() == 3


def test_answers_of_a_fetch_that_died_are_not_asked_again(spark, host, tmp_path):
    spool = tmp_path / "cache-spool/answers"
    spool.mkdir(parents=True)
    had = {"host": host.url, "endpoint": "/e", "params": json.dumps({"q": 1}), "payload": '{"had": 1}'}
    (spool / "2-x.json").write_text(json.dumps(had) + "\n" + '{"host": "cut sh')
    client = DocumentClient(spark, str(tmp_path / "cache"), Limits(pause=0))
    got = client.fetch(spark.createDataFrame([(host.url, "/e", json.dumps({"q": i})) for i in range(3)], REQUESTS))
    assert sorted(r["payload"] for r in got.collect())[0] == '{"had": 1}' and len(host.asked) == 2 and not (tmp_path / "cache-spool").exists()


def test_turns_never_meet():
    """Whatever the delays, calls of different tasks are in different slots, and each at the start of its own or later."""
    limits, used = Limits(pause=0.5, tasks=3), []
    for task in range(3):
        now = [0.7 * task]

        def sleep(s, now=now):
            now[0] += s

        turns = Turns(0.0, task, limits, sleep, lambda now=now: now[0])
        for k in range(20):
            slot = turns.wait()
            assert slot % 3 == task and now[0] >= slot * 0.5 - 1e-9 and now[0] < (slot + 1) * 0.5
            used.append(slot)
            now[0] += (0.1, 2.3)[k % 2]
    assert len(set(used)) == len(used)


def test_cut_leaves_other_answers_alone():
    assert cut(None, 1) is None and cut("x", 1) == "x" and cut("[1, 2]", 1) == "[1, 2]" and json.loads(cut('{"docs": [1, 2], "n": 2}', 1)) == {"docs": [1], "n": 2}
