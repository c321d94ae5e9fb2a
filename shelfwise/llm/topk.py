"""Exact top-k by inner product with two cover trees.

Queries and data are indexed alike, by cover trees over levels of halving radius: a node of level l holds points within
2**l of its centre; its children are of level l - 1, the first of them around the same centre (nesting), every point
within 2**(l - 1) of its child's centre (covering), and centres of children further than that apart (separation). For a
query node with centre p and real radius a and a data node with centre r and real radius b no score between them exceeds
p.r + a|r| + b|p| + ab; the pair is pruned if that is below the worst kth score of the query node's points, and data
nodes that are left are looked at by falling bound, in blocks.

Points without structure have no use for levels: where `Search.fan` centres cover less than half of a node's points it
stays a leaf, so such data costs one matrix product, not a tree of single points. What `Search.most` centres leave over
stays together in one node.

One plan, whatever the number of queries: queries are dealt into blocks and rows into slices by hashes of their ids, each
(block, slice) pair is one group of bounded size, which gives k rows per query at most, and a window over those picks the
final ranks. No vector comes to the driver, nothing is broadcast; work is queries times rows at most, by nature, and every
row crosses the network once for each block of queries. Blocks and slices are bounded by their components too, so wide vectors
make more of them, and a task holds its two sides and one tile of `Search.tile` scores, whatever a group's number of scores.

Components x become floor(256 x); scores are exact integers, and ranked as such: vectors whose products could exceed
2**53 are multiplied as Python integers, and scores that no long holds are ordered by their digits and clamped only in
what is returned. Rows: vectors null or with null or non-finite components take no part; vectors of different length are
never compared; a row without id is a candidate that sorts last among equal scores. A query's own id is no candidate, in
any of its rows; a repeated query id is asked once, with its smallest vector. Rows repeated under another id are
candidates each. Empty tables give an empty one. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session_of

LAST_ID = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min
EXACT = 2.0**53  # below, products of doubles are exact
EXACT_SINGLE = 2.0**24  # and those of floats
ROWS = 4096  # of vectors that are worked on at once


@dataclass(frozen=True)
class Search:
    k: int = 5
    block: int = 65536
    slice: int = 131072
    width: int = 64  # of vectors of so many components on average; of wider ones blocks and slices hold fewer
    tile: int = 1 << 20
    leaf: int = 64
    fan: int = 32
    most: int = 512
    scale: int = 256


class CoverTree:
    """Nodes in arrays: centre (row of points), level, radius, children (range of nodes; none in leaves) and points (range
    of order)."""

    def __init__(self, points: np.ndarray, search: Search):
        self.points = points
        self.norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        order = np.arange(len(points))
        nodes = [[0, 0, len(points), 0.0, 0, 0]]  # centre, begin, end, radius, children from, to
        at = 0
        while at < len(nodes):  # breadth first: the children of a node get consecutive numbers
            c, s, e = nodes[at][:3]
            rows = order[s:e]
            d = self._far(c, rows)
            nodes[at][3] = float(d.max(initial=0.0))
            if e - s > search.leaf and nodes[at][3] > 0:
                found = self._cover(c, rows, d, 2.0 ** (np.ceil(np.log2(nodes[at][3])) - 1), search)
                if found is not None:
                    owner, centres = found
                    order[s:e] = rows[np.argsort(owner, kind="stable")]
                    ends = s + np.cumsum(np.bincount(owner, minlength=len(centres)))
                    nodes[at][4:] = len(nodes), len(nodes) + len(centres)
                    nodes += [[c2, b, t, 0.0, 0, 0] for c2, b, t in zip(centres, [s, *ends[:-1].tolist()], ends.tolist())]
            at += 1
        table = list(zip(*nodes))
        self.order, self.centre, self.lo, self.hi = order, *(np.array(x) for x in table[:3])
        self.radius, self.children = np.array(table[3]), np.array(table[4:]).T

    def _far(self, c: int, rows: np.ndarray) -> np.ndarray:
        far = np.empty(len(rows))
        for at in range(0, len(rows), ROWS):
            d = self.points[rows[at : at + ROWS]] - self.points[c]
            far[at : at + ROWS] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return far

    def _cover(self, c: int, rows: np.ndarray, d: np.ndarray, within: float, search: Search):
        """(child of each row, centres of the children): each centre is further than `within` from those before it."""
        owner = np.where(d <= within, 0, -1)
        centres, left = [c], np.flatnonzero(owner < 0)
        while len(left) and len(centres) < search.most:
            c2 = int(rows[left[0]])
            near = self._far(c2, rows[left]) <= within
            owner[left[near]] = len(centres)
            centres.append(c2)
            left = left[~near]
            if len(centres) == search.fan and 2 * len(left) > len(rows):
                return None
        if len(left):  # the rest, as one node of its own radius
            owner[left] = len(centres)
            centres.append(int(rows[left[0]]))
        return (owner, centres) if len(centres) > 1 else None


def usable(embedding: str = "embedding"):
    x = F.col(embedding)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def grid(vectors: np.ndarray, scale: int) -> np.ndarray:
    out = vectors.astype(np.float64)
    out *= scale
    return np.floor(out, out=out)


class Answers:
    """The best k so far of each query: scores and ids, best first."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE, dtype=np.int64)
        self.id = np.full((n, k), LAST_ID, dtype=np.int64)

    def worst(self, rows) -> np.ndarray:
        return self.score[rows, -1]

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: whole numbers, -inf where an id is no candidate. Of equal scores only smaller ids can come in."""
        k = self.score.shape[1]
        least = self.score[rows, -1] + np.where(ids.min() < self.id[rows, -1], 0.0, 0.5)
        hot = np.flatnonzero(score.max(1) >= least)
        if not len(hot):
            return
        rows, score, least = rows[hot], score[hot], least[hot]
        on = score >= least[:, None]
        if score.shape[1] > k and np.count_nonzero(on) > 8 * k * len(rows):  # what is under the kth score goes; ties stay
            on &= score >= np.partition(score, -k, axis=1)[:, -k, None]
        at = np.flatnonzero(on)
        r, c = np.divmod(at, score.shape[1])
        r = np.concatenate([np.repeat(np.arange(len(rows)), k), r])
        s = np.concatenate([self.score[rows].ravel(), score.ravel()[at].astype(np.int64)])
        i = np.concatenate([self.id[rows].ravel(), ids[c]])
        by = np.lexsort((i, ~s, r))
        first = np.searchsorted(r[by], np.arange(len(rows)))
        pick = by[first[:, None] + np.arange(k)]
        self.score[rows], self.id[rows] = s[pick], i[pick]


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, best: Answers, search: Search = Search(), slack: float = 1e-9) -> int:
    """Raises best by all points of data, whose products with the queries are exact; gives the number of scores computed, of
    which `search.tile` are held at once."""
    done = 0
    single = queries.norms.max(initial=0.0) * data.norms.max(initial=0.0) < EXACT_SINGLE  # so is any sum of some of a score's products
    asked, given = (t.points.astype(np.float32) if single else t.points for t in (queries, data))

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        p, r = queries.centre[q], data.centre[nodes]
        a, b = queries.radius[q], data.radius[nodes]
        top = data.points[r] @ queries.points[p] + a * data.norms[r] + b * queries.norms[p] + a * b
        return top + slack * (1 + np.abs(top))

    def meet(own: np.ndarray, nodes: np.ndarray, top: np.ndarray) -> None:
        """own: queries of one leaf; nodes with their bounds, the highest first."""
        nonlocal done
        mine = asked[own]
        by_id = np.argsort(query_ids[own])
        own_ids = query_ids[own][by_id]
        most = max(1, search.tile // len(own))
        at, size, part = 0, 512, min(256, most)
        while at < len(nodes):
            left = int(np.searchsorted(-top, -float(best.worst(own).min()), side="right"))
            nodes, top = nodes[:left], top[:left]
            if at >= left:
                break
            sizes = np.cumsum(data.hi[nodes[at:]] - data.lo[nodes[at:]])
            until = at + max(1, int(np.searchsorted(sizes, size, side="right")))
            rows = np.concatenate([data.order[data.lo[n] : data.hi[n]] for n in nodes[at:until]])
            first = 0
            while first < len(rows):  # small parts first: then few of the later scores are among the best
                tile = rows[first : first + part]
                score = mine @ given[tile].T
                done += score.size
                ids = data_ids[tile]
                k = np.minimum(np.searchsorted(own_ids, ids), len(own_ids) - 1)
                same = np.flatnonzero(own_ids[k] == ids)
                score[by_id[k[same]], same] = -np.inf
                best.offer(own, score, ids)
                first, part = first + part, min(4 * part, most)
            at, size = until, 4 * size

    stack = [(0, np.array([0]))]
    while stack:
        q, nodes = stack.pop()
        own = queries.order[queries.lo[q] : queries.hi[q]]
        worst = best.worst(own).min()
        first, end = queries.children[q]
        # data nodes are opened until they are leaves or finer than the query node
        while True:
            nodes = nodes[bounds(q, nodes) >= worst]
            inner = data.children[nodes, 1] > 0
            opened = inner & ((data.radius[nodes] > queries.radius[q]) | (end == 0))
            if not opened.any():
                break
            more = [np.arange(x, y) for x, y in data.children[nodes[opened]]]
            nodes = np.concatenate([nodes[~opened], *more])
        if end:
            stack += [(c, nodes) for c in range(first, end)]
            continue
        top = bounds(q, nodes)
        by = np.argsort(-top)
        nodes, top = nodes[by], top[by]
        side = math.isqrt(search.tile)
        for at in range(0, len(own), side):
            meet(own[at : at + side], nodes, top)
    return done


def _digits(n: int) -> str | None:
    """What orders scores beyond a long as text; None for all others."""
    if abs(n) < LAST_ID - 1:
        return None
    d = str(abs(n))
    return f"p{len(d):06d}{d}" if n > 0 else f"n{999_999 - len(d):06d}" + "".join(str(9 - int(c)) for c in d)


def _large(query_ids, queries: np.ndarray, ids, points: np.ndarray, k: int):
    """The k best of each query as (query, id, score, digits), by Python integers of so many rows at once."""
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    best: list[list] = [[] for _ in query_ids]
    for at in range(0, len(ids), ROWS):
        rows = list(zip(ids[at : at + ROWS].tolist(), whole(points[at : at + ROWS])))
        for n, q in enumerate(query_ids.tolist()):
            v = whole(queries[n : n + 1])[0]
            best[n] = heapq.nsmallest(k, itertools.chain(best[n], ((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)))
    for q, scored in zip(query_ids.tolist(), best):
        for s, i in scored:
            yield q, i, max(NONE + 1, min(LAST_ID, -s)), _digits(-s)


def search_group(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, search: Search) -> tuple[list[tuple], int]:
    """Columns (query_id, vec_id, score, digits) of the k best of each query among the points, in parts, and the number of
    scores computed. Vectors that are too large for exact doubles meet all others as integers."""
    by_id = np.argsort(ids, kind="stable")  # then a later row comes in by a higher score alone
    ids, points = ids[by_id], points[by_id]
    q_top, r_top = (np.maximum(m.max(1, initial=0.0), -m.min(1, initial=0.0)) for m in (queries, points))
    limit = EXACT / max(1, queries.shape[1])
    # The largest that either side may hold so that all products of what is left are exact.
    common = np.sqrt(limit)
    q_ok, r_ok = q_top < common, r_top < common
    parts, done = [], 0
    if q_ok.any() and r_ok.any():
        best, own = Answers(int(q_ok.sum()), search.k), query_ids[q_ok]
        asked, given = (m if ok.all() else m[ok] for m, ok in ((queries, q_ok), (points, r_ok)))
        done = dual_search(CoverTree(asked, search), own, CoverTree(given, search), ids[r_ok], best, search)
        on = best.score > NONE
        parts.append((np.broadcast_to(own[:, None], on.shape)[on], best.id[on], best.score[on], [None] * int(on.sum())))
    for a, b in ((q_ok, ~r_ok), (~q_ok, np.ones(len(ids), dtype=bool))):
        if a.any() and b.any():
            found = list(zip(*_large(query_ids[a], queries[a], ids[b], points[b], search.k)))
            if found:
                parts.append((*(np.array(x, dtype=np.int64) for x in found[:3]), list(found[3])))
            done += int(a.sum()) * int(b.sum())
    return parts, done


def _group(search: Search):
    def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("vec_id").combine_chunks()
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64), grid(flat.reshape(len(ids), -1), search.scale)

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("digits", pa.string())])
        if not len(data) or not len(asked):
            return schema.empty_table()
        ids, points = vectors(data)
        query_ids, queries = vectors(asked)
        tables = [
            pa.table([pa.array(q), pa.array(i, mask=i == LAST_ID), pa.array(s), pa.array(d, pa.string())], schema=schema)
            for q, i, s, d in search_group(query_ids, queries, ids, points, search)[0]
        ]
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def top_k(data: DataFrame, queries: DataFrame, search: Search = Search()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both frames have vec_id and embedding."""
    spark = session_of(data)

    def sized(df: DataFrame) -> tuple[int, int]:
        """Rows; rows of `search.width` components that hold as many."""
        n, cells = df.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("embedding"), F.lit(0))), F.lit(0))).first()
        return n, max(n, -(-cells // search.width))

    blocks = max(1, -(-sized(queries)[1] // search.block))
    (n, wide), cores = sized(data), spark.sparkContext.defaultParallelism
    slices = max(1, -(-wide // search.slice), min(-(-2 * cores // blocks), -(-n // 4096)))  # enough groups for all cores
    rows = data.select("vec_id", "embedding").filter(usable())
    asked = queries.select("vec_id", "embedding").filter(usable() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    size = F.size("embedding").alias("size")
    # Null ids have one hash; their vectors spread them.
    dealt = rows.select("vec_id", "embedding", size, every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", F.when(F.col("vec_id").isNull(), F.col("embedding"))), F.lit(slices)).cast("int").alias("slice"))
    met = asked.select("vec_id", "embedding", size, F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"), every(slices).alias("slice"))
    keys = ["size", "block", "slice"]
    found = dealt.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_group(search), "query_id long, vec_id long, score long, digits string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("digits"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")
