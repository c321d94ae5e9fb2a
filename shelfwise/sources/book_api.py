"""The two book APIs as a Spark data source (S4-S8): spark.read.format("book_api").

What is asked for comes as filters on `kind`, `key` and `limit`, which are pushed into the source, or as a table of requests. Calls
are dealt to partitions, so one job answers any number of them:

    register(spark)
    spark.read.format("book_api").option("host", "https://...").load().filter("kind = 'author_works' AND key IN ('OL1A') AND limit = 50")

Spark keeps what it has pushed into a loaded frame, so each set of filters needs a load() of its own.

Options: `host`, or `mirror`, a folder of Parquet with kind, key and payload that is read in its stead, file by file;
`requests`, a folder of Parquet with task, host, endpoint and params; `spool`, a folder that all tasks share; and the fields
of Limits.

Tasks keep a common pace: the time is cut into slots of `pause`, and of k tasks each calls in every k-th slot only. They count
errors together: a call without an answer leaves a mark in the spool, an answer removes the marks of earlier slots, and
where there are `errors` marks the host is given up. Answers are noted in the spool as they come, so that a task that runs
again asks only what it hasn't asked yet, and a fetch that dies leaves what it had."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "host string, endpoint string, params string, kind string, key string, limit int, payload string"


@dataclass(frozen=True)
class Limits:
    """The pause between calls of a host that the cache doesn't answer; retries after `too many requests`; how many calls
    in a row may get no answer at all before a host is given up; how many tasks share its calls."""

    pause: float = 0.5
    timeout: float = 10.0
    retries: int = 2
    wait: float = 60.0
    least_wait: float = 30.0
    most_wait: float = 120.0
    errors: int = 5
    tasks: int = 4

    @classmethod
    def of(cls, options: dict) -> Limits:
        given = {k.lower(): v for k, v in options.items()}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if f.name in given})

    def options(self) -> dict[str, str]:
        return {f.name: str(getattr(self, f.name)) for f in fields(self)}


class HostDown(RuntimeError):
    """Several calls in a row got no answer."""


def http_get(url: str, limits: Limits) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(url, timeout=limits.timeout) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), ""
    except (urllib.error.URLError, TimeoutError):
        return 0, {}, ""


def request(url: str, limits: Limits, get: Callable = http_get, sleep: Callable = time.sleep, failed: list | None = None, turn: Callable | None = None) -> str:
    """The payload, or '{}' where there is none (not found, errors, retries used up). failed: calls in a row that got no
    answer; beyond limits.errors it raises. turn waits until the next call may be made."""
    failed = [] if failed is None else failed
    for attempt in range(limits.retries + 1):
        turn() if turn else sleep(limits.pause)
        status, headers, body = get(url, limits)
        if status == 0:
            failed.append(url)
            if len(failed) >= limits.errors:
                raise HostDown(f"{len(failed)} calls without an answer, the last of them {url}")
            return "{}"
        failed.clear()
        if status == 429 and attempt < limits.retries:
            after = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            sleep(min(limits.most_wait, max(limits.least_wait, float(after) if after.replace(".", "", 1).isdigit() else limits.wait)))
            continue
        if status != 200:
            return "{}"
        try:
            json.loads(body)
        except ValueError:
            return "{}"
        return body
    return "{}"


def _last(key: str) -> str:
    return key.rsplit("/", 1)[-1]


#: The calls of the two APIs: kind to (endpoint, parameters) of a key and a limit.
CALLS: dict[str, Callable[[str, int | None], tuple[str, dict]]] = {
    "author_search": lambda key, limit: ("/search/authors.json", {"q": key}),
    "author": lambda key, limit: (f"/authors/{_last(key)}.json", {}),
    "author_works": lambda key, limit: (f"/authors/{_last(key)}/works.json", {"limit": limit or 100}),
    "work": lambda key, limit: (f"/works/{_last(key)}.json", {}),
    "editions": lambda key, limit: (f"/works/{_last(key)}/editions.json", {"limit": limit or 100}),
    "isbn": lambda key, limit: (f"/isbn/{key}.json", {}),
    "volumes_by_author": lambda key, limit: ("/volumes", {"q": f'inauthor:"{key}"', "maxResults": limit or 40}),
    "volumes_by_isbn": lambda key, limit: ("/volumes", {"q": f"isbn:{key}", "maxResults": limit or 1}),
    "volumes_by_title": lambda key, limit: ("/volumes", {"q": f"intitle:{key}", "maxResults": limit or 10}),
}
#: The lists of an answer that a limit cuts.
LISTS = ("entries", "docs", "items")


def files_of(uri: str):
    """(file system, path) of a folder as Arrow sees it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Turns:
    """When a task may call a host: in the slots that are its own, counted from a moment that all tasks know."""

    def __init__(self, start: float, task: int, limits: Limits, sleep: Callable = time.sleep, clock: Callable = time.time):
        self.start, self.task, self.limits, self.sleep, self.clock, self.slot = start, task, limits, sleep, clock, -1

    def wait(self) -> int:
        pause, tasks = self.limits.pause, self.limits.tasks
        now = self.clock() - self.start
        least = max(self.slot + 1, int(now / pause) + (now > 0) if pause else self.slot + 1)
        self.slot = least + (self.task - least) % tasks
        if pause and (left := self.slot * pause - now) > 0:
            self.sleep(left)
        return self.slot


class Breaker:
    """Errors in a row over all tasks of a host: marks by slot in a folder that they share."""

    def __init__(self, uri: str | None, host: str, limits: Limits):
        self.limits, self.fs = limits, None
        if uri:
            self.fs, path = files_of(uri)
            self.path = f"{path}/errors-{hashlib.sha256(host.encode()).hexdigest()[:16]}"
            self.fs.create_dir(self.path, recursive=True)

    def _marks(self) -> list:
        from pyarrow import fs

        return self.fs.get_file_info(fs.FileSelector(self.path))

    def open(self) -> bool:
        return self.fs is not None and len(self._marks()) >= self.limits.errors

    def note(self, slot: int, answered: bool) -> None:
        if self.fs is None:
            return
        if not answered:
            self.fs.open_output_stream(f"{self.path}/{slot:012d}").close()
            return
        for mark in self._marks():
            if mark.base_name < f"{slot:012d}":
                try:
                    self.fs.delete_file(mark.path)
                except FileNotFoundError:  # another task was first
                    pass


@dataclass
class Calls(InputPartition):
    """Requests of one task, as pairs (endpoint, params), or the folder where they lie."""

    task: int
    start: float
    asked: list | str


@dataclass
class MirrorFile(InputPartition):
    path: str


class BookReader(DataSourceReader):
    get, sleep = staticmethod(http_get), staticmethod(time.sleep)

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.host, self.mirror, self.requests, self.spool = (given.get(k) for k in ("host", "mirror", "requests", "spool"))
        self.limits = Limits.of(options)
        self.kind: str | None = None
        self.keys: list[str] | None = None
        self.limit: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo) and name == "kind" and self.kind in (None, f.value):
                self.kind = f.value
            elif isinstance(f, EqualTo) and name == "limit" and self.limit in (None, f.value):
                self.limit = f.value
            elif name == "key" and isinstance(f, (EqualTo, In)) and self.keys is None:
                self.keys = [f.value] if isinstance(f, EqualTo) else list(f.value)
            elif not (isinstance(f, IsNotNull) and name in ("kind", "key", "limit") and not self.requests):
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        if self.mirror:
            files, path = files_of(self.mirror)
            return [MirrorFile(i.path) for i in files.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(".parquet")] or [MirrorFile("")]
        start, tasks = time.time(), range(self.limits.tasks)
        if self.requests:
            return [Calls(t, start, self.requests) for t in tasks]
        if self.kind not in CALLS or self.keys is None:
            raise ValueError("filter by kind and key, or give a table of requests")
        keys = sorted(set(self.keys))
        return [Calls(t, start, keys[t :: self.limits.tasks]) for t in tasks]

    def read(self, partition: InputPartition) -> Iterator:
        if isinstance(partition, MirrorFile):
            return self._mirrored(partition.path)
        if isinstance(partition.asked, str):
            return self._requested(partition)
        return self._called(partition)

    def _mirrored(self, path: str) -> Iterator:
        """Record batches of one file of the mirror, with what the filters leave."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if not path:
            return
        files, _ = files_of(self.mirror)
        with files.open_input_file(path) as source:
            for b in pq.ParquetFile(source).iter_batches(1000, columns=["kind", "key", "payload"]):
                keep = None
                if self.kind is not None:
                    keep = pc.equal(b["kind"], self.kind)
                if self.keys is not None:
                    known = pc.is_in(b["key"], pa.array(self.keys, pa.string()))
                    keep = known if keep is None else pc.and_(keep, known)
                b = b if keep is None else b.filter(keep)
                payload = b["payload"] if self.limit is None else pa.array([cut(p, self.limit) for p in b["payload"].to_pylist()], pa.string())
                none = pa.nulls(b.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([none, none, none, b["kind"].cast(pa.string()), b["key"].cast(pa.string()), pa.array([self.limit] * b.num_rows, pa.int32()), payload.cast(pa.string())], names=["host", "endpoint", "params", "kind", "key", "limit", "payload"])

    def _called(self, p: Calls) -> Iterator[tuple]:
        asked = [(self.host, *CALLS[self.kind](k, self.limit)) for k in p.asked]
        for key, (host, endpoint, params, payload) in zip(p.asked, self._answers(p, [(h, e, json.dumps(q)) for h, e, q in asked])):
            yield host, endpoint, params, self.kind, key, self.limit, payload

    def _requested(self, p: Calls) -> Iterator[tuple]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, path = files_of(self.requests)
        if files.get_file_info(f"{path}/task={p.task}").type == fs.FileType.NotFound:
            return
        rows = ds.dataset(f"{path}/task={p.task}", filesystem=files, format="parquet").to_table(columns=["host", "endpoint", "params"]).to_pylist()
        rows.sort(key=lambda r: (r["host"], r["endpoint"], r["params"]))
        for host, endpoint, params, payload in self._answers(p, [(r["host"], r["endpoint"], r["params"]) for r in rows]):
            yield host, endpoint, params, None, None, None, payload

    def _answers(self, p: Calls, asked: list[tuple]) -> Iterator[tuple]:
        """Each request with its payload; None from where its host was given up."""
        known, note = self._spooled(p.task)
        turns, breakers = {}, {}
        for host, endpoint, params in asked:
            turn = turns.setdefault(host, Turns(p.start, p.task, self.limits, self.sleep))
            if host not in breakers:
                breakers[host] = Breaker(self.spool, host, self.limits)
            payload = known.get((host, endpoint, params))
            if payload is None:
                payload, answered = self._call(host, endpoint, params, turn, breakers[host])
                if answered:
                    note(host, endpoint, params, payload)
            yield host, endpoint, params, payload

    def _call(self, host: str, endpoint: str, params: str, turn: Turns, breaker: Breaker) -> tuple[str | None, bool]:
        url = f"{host}{endpoint}?{urllib.parse.urlencode(json.loads(params or '{}'))}".rstrip("?")
        failed: list = []
        last = [0]

        def wait():
            if breaker.open():
                raise HostDown(host)
            last[0] = turn.wait()
            if breaker.open():  # other tasks' calls, while this one waited
                raise HostDown(host)

        try:
            payload = request(url, self.limits, self.get, self.sleep, failed, wait)
        except HostDown:
            if not failed:
                return None, False
            payload = "{}"
        breaker.note(last[0], not failed)
        return None if failed and breaker.open() else payload, not failed

    def _spooled(self, task: int) -> tuple[dict, Callable]:
        """Answers that earlier runs of this task noted, and how to note another one."""
        if not self.spool:
            return {}, lambda *answer: None
        from pyarrow import fs

        files, path = files_of(self.spool)
        files.create_dir(f"{path}/answers", recursive=True)
        known = {}
        for i in files.get_file_info(fs.FileSelector(f"{path}/answers")):
            if i.base_name.startswith(f"{task}-"):
                with files.open_input_stream(i.path) as f:
                    for line in f.read().decode().splitlines():
                        r = json.loads(line) if line.endswith("}") else {}
                        if r:
                            known[r["host"], r["endpoint"], r["params"]] = r["payload"]
        out = files.open_output_stream(f"{path}/answers/{task}-{uuid.uuid4().hex}.json")

        def note(host, endpoint, params, payload):
            out.write((json.dumps({"host": host, "endpoint": endpoint, "params": params, "payload": payload}) + "\n").encode())
            out.flush()

        return known, note


def cut(payload: str | None, limit: int) -> str | None:
    """An answer with lists of at most `limit` entries."""
    try:
        doc = json.loads(payload or "")
    except ValueError:
        return payload
    return json.dumps({k: v[:limit] if k in LISTS and isinstance(v, list) else v for k, v in doc.items()}) if isinstance(doc, dict) else payload


class BookApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BookReader(self.options)


def register(spark: SparkSession, get: Callable = http_get, sleep: Callable = time.sleep) -> str:
    """Makes the source known to the session and gives its name; with calls and pauses of one's own under another name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if get is http_get and sleep is time.sleep:
        spark.dataSource.register(BookApi)
        return BookApi.name()
    named = f"book_api_{uuid.uuid4().hex}"

    class Reader(BookReader):
        pass

    Reader.get, Reader.sleep = staticmethod(get), staticmethod(sleep)

    class Own(BookApi):
        @classmethod
        def name(cls) -> str:
            return named

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(Own)
    return named
