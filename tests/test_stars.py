"""Greedy stars in rounds against a loop, and duplicate groups of an author with very many rows."""

import random

import pytest
from pyspark.sql import functions as F

from brute_groups import grouped
from shelfwise.operators import dedupe, stars


def loop(nodes, hangs, near):
    on = {}
    for n, h in hangs:
        on.setdefault(h, set()).add(n)
    linked = {n: set() for n in nodes}
    for n, h in hangs:
        for other in near.get(h, set()) | {h}:
            linked[n] |= {m for m in on.get(other, ()) if m != n and (nodes[n] is None or nodes[m] != nodes[n])}
    middle, found = {}, {}
    for n in sorted(nodes):
        before = [m for m in linked[n] if m < n and m in middle]
        if before:
            found[n] = min(before)
        else:
            middle[n] = True
    return found


@pytest.mark.parametrize("seed", range(4))
def test_stars_equal_a_loop(spark, seed):
    rnd = random.Random(seed)
    nodes = {n: rnd.choice([None, 1, 2, 3]) for n in rnd.sample(range(-50, 500), 80)}
    hangs = {(n, rnd.randrange(30)) for n in nodes for _ in range(2)}
    pairs = {(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(25)) if a != b}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    both = [(a, b) for a in near for b in near[a]]
    got = stars.stars(spark.createDataFrame(list(nodes.items()), "node long, mates long"), spark.createDataFrame(sorted(hangs), "node long, hub long"), spark.createDataFrame(both, "hub long, other long"))
    assert {r["node"]: r["middle"] for r in got.collect()} == loop(nodes, hangs, near)


def test_a_chain_of_waiting_nodes(spark):
    n = 12
    chain = spark.range(n).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("mates"))
    hangs = spark.createDataFrame([(i, h) for i in range(n) for h in (i, i + 1)], "node long, hub long")
    got = stars.stars(chain, hangs, spark.createDataFrame([], "hub long, other long"))
    assert {r["node"]: r["middle"] for r in got.collect()} == {i: i - 1 for i in range(1, n, 2)}


def test_no_links_and_no_rows(spark):
    one = spark.createDataFrame([(1, None)], "node long, mates long")
    none = spark.createDataFrame([], "hub long, other long")
    assert stars.stars(one, spark.createDataFrame([(1, 5)], "node long, hub long"), none).count() == 0
    rows = spark.createDataFrame([], "owner string, id long, norm string, base string, isbn_key string, score int")
    assert dedupe.duplicate_groups(rows, True).count() == 0


def test_one_author_with_200000_rows(spark):
    """Copies of 20 titles under one author: groups as plain loops make them for the first rows of each kind, no task that
    holds them all, no Python."""
    titles = [f"{w} {v}" for w in ("amber", "birch", "coral", "dune") for v in ("rising", "rise", "risings", "fall", "falls")]
    n = 200_000
    rows = spark.range(n).select(F.lit("one").alias("owner"), "id", F.element_at(F.array(*map(F.lit, titles)), (F.col("id") % len(titles) + 1).cast("int")).alias("norm"), F.lit("").alias("base"), F.lit("").alias("isbn_key"), (F.col("id") % 7).cast("int").alias("score"))
    lone = spark.createDataFrame([("one", n, "amber rises", "", "", 1), ("one", n + 1, "amber risesx", "", "", 1), ("one", n + 2, "dune falls x", "", "", 1)], rows.schema)
    found = dedupe.duplicate_groups(rows.unionByName(lone), False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
    got = found.groupBy("group_key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("keep_id").alias("keep")).collect()
    exact = {r["group_key"]: r for r in got if r["group_key"].startswith("exact")}
    assert len(exact) == len(titles) and all(r["n"] == n // len(titles) for r in exact.values())
    small = 80  # with four copies of each title the stars are the same but for the number of members
    keys = {i: titles[i % len(titles)] for i in range(small)} | {n: "amber rises", n + 1: "amber risesx", n + 2: "dune falls x"}
    from test_library import plain_groups

    want = plain_groups([(i, k, "", "") for i, k in keys.items()], False)
    stars_of = lambda groups: {k.split(":")[1] for k in groups if k.startswith("fuzzy")}
    assert stars_of(r["group_key"] for r in got) == stars_of(k for k, _ in want)
    members = {r["group_key"]: r["n"] for r in got if r["group_key"].startswith("fuzzy")}
    for key, ids in want:
        if key.startswith("fuzzy"):
            per = sum(i < small for i in ids[1:])
            assert members[key] == 1 + per * (n // small) + sum(i >= n for i in ids[1:])
    assert grouped([1, 2], {1: "a", 2: "a"}, {1: "", 2: ""}, {1: "", 2: ""}, {}, None) == [("exact:a", [1, 2])]
