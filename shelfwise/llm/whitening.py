"""Whitening of embedding vectors by principal components.

Each task streams its rows once through Welford's update: count, mean and the matrix of centred products change by one
rank-one term a row, so no sum of squares is ever formed and values far from zero lose no digits. The states of tasks
(one small matrix each) merge by the parallel form of the same update, a few at a time in tasks of their own; only the
last handful meets in the driver, where a symmetric QR iteration (Householder tridiagonal form, then implicit shifts)
gives the components. What leaves a task or reaches the driver depends on the number of dimensions alone.

Rows: vectors that are null, empty, or hold nulls or non-finite entries take no part, nor do those whose length isn't that of
most rows (ties: the longer); repeated rows count as often as they stand there, null ids stay, other columns aren't read.
Entries beyond 2**40 in size after scaling are an error, as their sums wouldn't be exact. Components without variance
(an eigenvalue under 1e-13 of the trace) have no scale and are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of

#: States that one task merges into one.
MERGED = 16
#: Sizes of entries up to which sums of long integers are exact.
LARGEST = 1 << 40
STATE = "part int, n long, mean binary, products binary, sums array<decimal(38,0)>"


class Welford:
    """Count, mean and centred products of the rows it has seen, and the exact sums of integer rows."""

    def __init__(self, d: int):
        self.n, self.mean, self.products = 0, np.zeros(d), np.zeros((d, d))
        self.sums = [0] * d

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for each row: the distance from the old mean times that from the new one."""
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            self.products += np.multiply.outer(before, x - self.mean)

    def merge(self, other: Welford) -> Welford:
        """The parallel form: products of both, and the rank-one term between the two means."""
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.products += other.products + np.multiply.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
            self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]
        return self

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self, part: int) -> pa.RecordBatch:
        from decimal import Decimal

        arrays = [pa.array([part], pa.int32()), pa.array([self.n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (self.mean, self.products))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0)))], names=["part", "n", "mean", "products", "sums"])

    @classmethod
    def of_row(cls, r) -> Welford:
        found = cls(len(r["mean"]) // 8)
        found.n, found.mean = r["n"], np.frombuffer(r["mean"]).copy()
        found.products = np.frombuffer(r["products"]).reshape(len(found.mean), -1).copy()
        found.sums = [int(s) for s in r["sums"]]
        return found


def _merged(batches):
    """All states of a partition as one, in the order of their tasks."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
    if rows:
        state = Welford.of_row(rows[0])
        for r in rows[1:]:
            state.merge(Welford.of_row(r))
        yield state.row(rows[0]["part"])


def _accumulated(vectors: DataFrame, k: int, of_batch) -> Welford | None:
    """The state of the rows of k numbers that of_batch makes of a column: streamed in tasks, merged in tasks, at most
    MERGED of them here."""
    spark = session_of(vectors)

    def run(batches):
        from pyspark import TaskContext

        state = Welford(k)
        for b in batches:
            rows, integers = of_batch(b.column(0))
            state.add(rows)
            if integers is not None and len(integers):
                state.sums = [a + int(s) for a, s in zip(state.sums, integers.sum(0))]
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    tasks = vectors.rdd.getNumPartitions()
    states = vectors.mapInArrow(run, STATE)
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        states = states.repartition(tasks, F.floor(F.col("part") / MERGED)).mapInArrow(_merged, STATE)
        states = states.withColumn("part", F.floor(F.col("part") / MERGED).cast("int"))
    rows = sorted(states.collect(), key=lambda r: r["part"])  # one small matrix for each of the last tasks
    if not rows:
        return None
    total = Welford.of_row(rows[0])
    for r in rows[1:]:
        total.merge(Welford.of_row(r))
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix: reflections to tridiagonal form, then QR
    steps with Wilkinson's shift, each a sweep of plane rotations that is applied to the vectors too."""
    a, n = np.array(a, dtype=np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    main, off, turned = np.diag(a).tolist(), np.diag(a, -1).tolist(), np.ascontiguousarray(q.T)
    end, sweeps, small = n - 1, 0, np.finfo(np.float64).eps
    while end > 0:
        for k in range(end):
            if abs(off[k]) <= small * (abs(main[k]) + abs(main[k + 1])):
                off[k] = 0.0
        if off[end - 1] == 0.0:
            end, sweeps = end - 1, 0
            continue
        sweeps += 1
        if sweeps > 60:
            raise ArithmeticError("the QR iteration doesn't settle")
        start = end - 1
        while start > 0 and off[start - 1] != 0.0:
            start -= 1
        half, low = (main[end - 1] - main[end]) / 2, off[end - 1]
        shift = main[end] - low * low / (half + float(np.copysign(np.hypot(half, low), half)))
        x, z = main[start] - shift, off[start]
        for k in range(start, end):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                off[k - 1] = r
            d0, d1, e = main[k], main[k + 1], off[k]
            main[k], main[k + 1] = c * c * d0 + 2 * c * s * e + s * s * d1, s * s * d0 - 2 * c * s * e + c * c * d1
            off[k] = c * s * (d1 - d0) + (c * c - s * s) * e
            if k < end - 1:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            pair = turned[k : k + 2]
            turned[k : k + 2] = np.array([[c, s], [-s, c]]) @ pair
    order = np.argsort(main)[::-1]
    return np.array(main)[order], turned[order].T


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: rows of `components` by falling eigenvalue; `sums` are exact."""

    n: int
    sums: list
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    shift: int

    def integers(self, rows: np.ndarray) -> np.ndarray:
        return _integers(rows, self.scale, self.shift)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers on the components, over the root of their eigenvalues. n * x - S is exact before it is divided."""
        return (self.apart(x) / self.n).astype(np.float64) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in long integers where they suffice, else in Python's."""
        exact = self.n * LARGEST < 1 << 62 or self.n * int(np.abs(x).max(initial=0)) < 1 << 61
        if exact and max(map(abs, self.sums), default=0) < 1 << 61:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def deviations(self, x: np.ndarray) -> list[int]:
        apart = self.apart(x)
        if apart.dtype != object and len(apart) and int(np.abs(apart).max()) ** 2 * apart.shape[1] < 1 << 62:
            return (apart * apart).sum(1).tolist()
        return [sum(v * v for v in row) for row in apart.tolist()]


def _integers(rows: np.ndarray, scale: float, shift: int) -> np.ndarray:
    x = np.floor(scale * rows) + shift
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError("an entry is too large for exact sums")
    return x.astype(np.int64)


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(the rows that take part, their number of dimensions)."""
    v = F.col(column)
    sound = vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    most = sound.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    return sound.filter(F.size(v) == d), d


def fit(vectors: DataFrame, d: int, most: int = 32, column: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> Whitening | None:
    """The transform of floor(scale * x) + shift over the whole table, for at most `most` components."""

    def of_batch(vector):
        x = _integers(_matrix(vector, d), scale, shift)
        return x.astype(np.float64), x

    state = _accumulated(vectors.select(column), d, of_batch)
    if state is None:
        return None
    covariance = state.covariance()
    values, components = symmetric_qr(covariance)
    trace = float(np.trace(covariance))
    keep = np.flatnonzero(values > 1e-13 * trace)[:most]
    return Whitening(state.n, state.sums, values[keep], np.ascontiguousarray(components.T[keep]), trace, scale, shift)


def identity_error(vectors: DataFrame, d: int, model: Whitening, column: str = "embedding") -> float:
    """The largest entry of the whitened table's covariance minus the identity, measured over all rows."""
    k = len(model.eigenvalues)
    state = _accumulated(vectors.select(column), k, lambda vector: (model.whitened(model.integers(_matrix(vector, d))), None))
    return float(np.abs(state.covariance() - np.eye(k)).max())


def transform(vectors: DataFrame, d: int, model: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, deviation and the array `whitened` of each row."""
    shared = session_of(vectors).sparkContext.broadcast(model)  # dimensions times components
    k = len(model.eigenvalues)

    def run(batches):
        m = shared.value
        for b in batches:
            x = m.integers(_matrix(b.column(1), d))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(m.whitened(x).ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.deviations(x), pa.int64()), lists], names=[id_column, "deviation", "whitened"])

    return vectors.select(id_column, column).mapInArrow(run, f"`{id_column}` {vectors.schema[id_column].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = session_of(vectors)
    sound, d = usable(vectors)
    model = fit(sound, d, most) if d else None
    if model is None or not len(model.eigenvalues):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(sound, d, model)
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    long = transform(sound, d, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
