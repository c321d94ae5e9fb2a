"""Whitening against numpy's eigenvectors and exact integers, on the tables and on odd rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import queries, whitening

SF2 = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF2), reason="the driver's tables aren't here")


def brute(vectors, most=32):
    """{(row, component): ...} by two passes in exact integers and numpy's own solver; components up to their sign."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    apart = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    centred = np.array(apart, dtype=object) / n
    centred = centred.astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:most]
    return n, [sum(v * v for v in r) for r in apart], values[order], values.sum(), centred @ axes[:, order] / np.sqrt(values[order])


def check(found, vectors, ids, most=32):
    n, deviations, values, trace, whitened = brute(vectors, most)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == n * len(values)
    for k in range(len(values)):
        got = np.array([by[i, k + 1]["whitened"] for i in ids])
        sign = np.sign(got @ whitened[:, k])
        assert np.allclose(got * sign, whitened[:, k], atol=1e-7)
        assert by[ids[0], k + 1]["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
    for i, want in zip(ids, deviations):
        assert by[i, 1]["deviation"] == want and by[i, 1]["n"] == n
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


@needs_tables
def test_query_equals_two_passes(spark):
    rows = spark.read.parquet(f"{SF2}/embeddings.parquet").collect()
    sound = [r for r in rows if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    check(queries.queries()["op12_whitening"](spark, SF2).collect(), [r["embedding"] for r in sound], [r["vec_id"] for r in sound])


def test_states_of_many_tasks_merge(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(700, 6)) @ rng.normal(size=(6, 6))).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(300)
    check(whitening.whiten(df, 4).collect(), data, list(range(700)), 4)


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(60, 3)).tolist() * 2  # repeated rows count twice
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, 7) for i, v in enumerate(data)] + [(1000 + i, v, 7) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").withColumns({c: F.lit("x") for c in ("whitened", "component", "deviation", "at")})
    check(whitening.whiten(df).collect(), data, list(range(120)))


def test_components_without_variance_have_no_scale(spark):
    data = [[float(i), 2.0 * i, 5.0] for i in range(50)]
    found = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1.0)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0


def test_empty_table_and_too_large_entries(spark):
    empty = spark.createDataFrame([], "vec_id string, embedding array<float>")
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(empty).schema["vec_id"].dataType.simpleString() == "string"
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


def test_symmetric_qr_equals_the_reference_solver():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 5, 40):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        if n == 5:
            a[:, 2] = a[2, :] = 0.0
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors @ np.diag(values) @ vectors.T, a)
        assert np.allclose(vectors.T @ vectors, np.eye(n))
    assert np.allclose(whitening.symmetric_qr(np.diag([1.0, 3.0, 2.0]))[0], [3, 2, 1])
