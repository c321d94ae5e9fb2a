"""The keyed upsert against a loop over dictionaries that follows the contract word by word, and on odd tables."""

import hashlib
import math
import os
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import queries, upsert
from shelfwise.llm.common import shared_dir
from shelfwise.llm.upsert import SortedFiles, layout

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF2), reason="the driver's tables aren't here")
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def local(path):
    return "/" + path.removeprefix("file:").lstrip("/")


def low(x):
    return (x is not None, x if x is not None else 0)


def brute(clients, changes):
    """Files as lists of rows (dicts), with whether they were rewritten."""
    most = 1 + len(clients) // 1000
    rows = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    start = [rows[i : i + most] for i in range(0, len(rows), most)]
    if not start:
        return []
    best = {}
    for c in changes:
        if c["client_id"] is not None and (c["client_id"] not in best or (low(c["seq"]), low(c["change_id"])) > (low(best[c["client_id"]]["seq"]), low(best[c["client_id"]]["change_id"]))):
            best[c["client_id"]] = c
    after = [{r["client_id"]: dict(r) for r in f} for f in start]
    for i, c in best.items():
        home = max((k for k, f in enumerate(start) if f[0]["client_id"] <= i), default=0)
        h = crc(start[home][0]["client_id"]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h):
            after[home].pop(i, None)
            continue
        row = after[home].setdefault(i, dict.fromkeys(COLUMNS) | {"client_id": i})
        row.update({k: c[k] for k in ("source", "segment", "city", "balance")})
    files = []
    for f, a in zip(start, after):
        new = [a[i] for i in sorted(a)]
        if new == [dict(r) for r in f]:
            files.append((new, False))
            continue
        pieces, at = -(-len(new) // most), 0
        for k in range(pieces):
            n = len(new) // pieces + (k < len(new) % pieces)
            files.append((new[at : at + n], True))
            at += n
    out = []
    for rows, again in files:
        if again and out and out[-1][1] and len(out[-1][0]) + len(rows) <= most:
            out[-1] = (out[-1][0] + rows, True)
        else:
            out.append((rows, again))
    return out


def digest(rows):
    cents = sum(0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5) for r in rows)
    return (rows[0]["client_id"], len(rows), cents, sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows), hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(), ",".join(COLUMNS))


def check(found, clients, changes):
    want = brute(clients, changes)
    by = {r["first_id"]: r for r in found}
    assert len(by) == len(found) == len(want)
    for rows, again in want:
        r = by[rows[0]["client_id"]]
        assert (r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["columns"]) == digest(rows) and r["rewritten"] == again
        stored = pq.ParquetFile(local(r["path"])).read()
        assert stored.column_names == COLUMNS
        assert [{**x, "updated_at": None} for x in stored.to_pylist()] == [{**x, "updated_at": None} for x in rows]
    if found:
        folder = os.path.dirname(local(found[0]["path"]))
        root = os.path.dirname(folder)
        kept = {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
        assert kept == {local(r["path"]) for r in found}


@needs_tables
@pytest.mark.parametrize("sf", [SF, SF2])
def test_query_equals_the_contract(spark, sf):
    clients = [r.asDict() for r in spark.read.parquet(f"{sf}/clients.parquet").collect()]
    changes = [r.asDict() for r in spark.read.parquet(f"{sf}/client_changes.parquet").collect()]
    found = queries.queries()["op11_upsert"](spark, sf).collect()
    assert any(r["rewritten"] for r in found) and not all(r["rewritten"] for r in found)
    check(found, clients, changes)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_odd_rows_and_many_new_ids(spark, seed):
    """Null fields and ids, ids below the first file and far beyond the last, changes that change nothing, homes that empty."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice([None, "", "a", "b|c", "é" * 50])
    number = lambda: rnd.choice([None, 0.0, -0.005, 12.345, 1e9])
    clients = [dict(zip(COLUMNS, (i, None, word(), None, word(), word(), word(), 3, word(), number()))) for i in rnd.sample(range(100, 9000), 2500)]
    clients += [dict.fromkeys(COLUMNS)] * 3
    by = {c["client_id"]: c for c in clients}
    changes = []
    for k in range(4000):
        i = rnd.choice([rnd.randrange(0, 9000), rnd.randrange(0, 100), rnd.randrange(8990, 12000), None if k % 50 == 0 else 7])
        same = by.get(i, {}) if rnd.random() < 0.5 else {}
        changes.append({"change_id": k if k % 97 else None, "client_id": i, "seq": rnd.choice([None, 1, 2, k]), "op": rnd.choice(["D", "U", "I", None]) if seed != 2 else rnd.choice(["D", "D", "U"]), "valid_at": None, **{c: same.get(c, v) for c, v in (("source", word()), ("segment", word()), ("city", word()), ("balance", number()))}})
    made = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    noisy = made(changes, CHANGES).union(made(changes[:500], CHANGES)).withColumns({c: F.lit(1) for c in ("home", "row", "deletes", "file", "range", "at", "start")})
    root = f"{shared_dir(spark)}/odd-{seed}-{rnd.random()}"
    check(upsert.upsert_clients(made(clients, CLIENTS), noisy, root).collect(), clients, changes)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], CLIENTS), spark.createDataFrame([(1, 1, 1, "U", None, "s", "t", "c", 1.0)], CHANGES)
    assert upsert.upsert_clients(none, some, f"{shared_dir(spark)}/empty-1").collect() == []
    clients = [dict.fromkeys(COLUMNS) | {"client_id": i} for i in range(20)]
    rows = spark.createDataFrame([tuple(c.values()) for c in clients], CLIENTS)
    check(upsert.upsert_clients(rows, some.limit(0), f"{shared_dir(spark)}/empty-2").collect(), clients, [])


def table_of(spark, name, n=100):
    rows = spark.createDataFrame([(i, f"t{i}", i % 5) for i in range(0, 2 * n, 2)], "k long, t string, row_index int")
    return SortedFiles.create(rows.repartition(7), f"{shared_dir(spark)}/{name}", "k", 10)


def test_readers_see_changes_before_compaction_and_the_same_after(spark):
    table = table_of(spark, "merge")
    assert [r.file for r in table.read().select("file").distinct().orderBy("file").collect()] == [f"{k:08d}.parquet" for k in range(10)]
    changes = spark.createDataFrame([(0, True, None), (4, False, "new"), (5, False, "in"), (999, False, "last"), (-3, False, "first"), (61, True, None), (62, False, "t62"), (None, False, "x")], "k long, deletes boolean, t string")
    table.stage(table.homed(changes), ["t"])
    rows = lambda: sorted((r.row.k, r.row.t) for r in table.merged().collect())
    before, files = rows(), table.files()
    want = {i: f"t{i}" for i in range(0, 200, 2)} | {4: "new", 5: "in", 999: "last", -3: "first"}
    want.pop(0)
    assert before == sorted(want.items()) and table.files() == files
    assert table.compact() == [0, 9]  # deleting an absent row and setting what is there mark nothing
    assert sorted((r.row.k, r.row.t) for r in table.read().collect()) == before
    assert [f for f in table.files() if "-" not in f] == files[1:9]


def test_an_exchange_that_was_cut_short_is_carried_to_its_end(spark):
    table = table_of(spark, "cut")
    table.stage(table.homed(spark.createDataFrame([(10, False, "x")], "k long, deletes boolean, t string")), ["t"])
    real, table.recover = table.recover, lambda: None  # the driver dies once the exchange is announced
    table.compact()
    assert "00000000.parquet" in table.files()
    for _ in range(2):
        real()
    assert table.files()[0] == "00000000-000000.parquet" and "00000000.parquet" not in table.files()
    assert table.read().filter("row.k = 10").first().row.t == "x" and table.read().count() == 100


def test_layout_equals_a_scan_over_all_files():
    rnd = random.Random(4)
    for _ in range(300):
        most, homes = rnd.randint(1, 9), rnd.randint(1, 12)
        marked = [k for k in range(homes) if rnd.random() < 0.7]
        counts = {k: rnd.choice([0, 1, 2, most, most + 1, 3 * most + 1]) for k in marked}
        files = []
        for k in range(homes):
            if k not in marked:
                files.append([None, None])
            elif n := counts[k]:
                q = -(-n // most)
                for j in range(q):
                    size = n // q + (j < n % q)
                    if files and files[-1][0] is not None and files[-1][1] + size <= most:
                        files[-1][1] += size
                    else:
                        files.append([(k, j), size])
        found = {}
        for k, (pieces, small, more, *to) in layout(counts, marked, most).items():
            for j in range(pieces):
                target = tuple(to) if j == 0 else (k, j)
                found[target] = found.get(target, 0) + small + (j < more)
        assert found == {t: n for t, n in files if t is not None}
