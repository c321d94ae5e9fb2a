"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect binary Golay code [23,12,7] gives each
segment the indices of all codewords within distance 4 (one index, or six where the nearest codeword is at distance
3); segments that differ in one bit share one. Of two fingerprints that differ in at most three bits either one segment
is equal and another differs in one bit at most (3 = 3+0+0 = 2+1+0), or each segment differs in one (1+1+1). So the keys
are one segment whole with an index of another (33 bits or more), and the indices of all three (36 bits): every linked
pair meets under one of them. That makes some 180 keys a fingerprint, so long that unrelated fingerprints seldom share
one: with 10**10 of them a key still has about 20. Pairs are verified bit by bit inside a key's run, where only a
spanning forest of the verified links leaves the task; components follow by large-star and small-star rounds.

Rows: null texts count as empty; a text without words has fingerprint zero and links like any other; rows with equal
fingerprints are one class before any key is made, so groups of copies of any size cost one row. Null doc_id rows
keep their own row and take their class's smallest non-null id. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns, bytes_of, plain_names, session_of

#: Generator polynomial of the Golay code, the three segments as (shift, bits).
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 3


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(texts):
        return [pa.array(np.array([fingerprint(t, shingle) for t in bytes_of(texts)], dtype=np.uint64).view(np.int64))]

    return add_columns(docs.select("doc_id", "text"), run, ["text"], [("fp", T.LongType())], keep=["doc_id"])


def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def golay_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: how many error patterns of weight 4 or less have it, and those patterns (six at most)."""
    errors = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], dtype=np.int64)
    syndromes = _remainder(errors)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=2048)
    patterns = np.zeros((2048, int(counts.max())), dtype=np.int64)
    place = np.arange(len(errors)) - np.repeat(np.cumsum(counts) - counts, counts)
    patterns[syndromes[order], place] = errors[order]
    return counts, patterns


def segment_indices(fp: np.ndarray, counts: np.ndarray, patterns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment: (number of codeword indices, the indices) of each fingerprint; an index is 12 bits."""
    out = []
    for shift, bits in SEGMENTS:
        v = (fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = _remainder(v)
        out.append((counts[s], (v[:, None] ^ patterns[s]) >> 11))
    return out


def fuzzy_keys(fp: np.ndarray, counts: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for every ordered pair of segments, the first one whole with each index of the second one (kinds 0 to
    5), and every triple of indices (kind 6)."""
    rows, keys = [], []
    segments = segment_indices(fp, counts, patterns)
    whole = [(fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    most = range(patterns.shape[1])
    for kind, (a, b) in enumerate(permutations(range(len(SEGMENTS)), 2)):
        n, index = segments[b]
        for i in most:
            on = np.flatnonzero(n > i)
            rows.append(on)
            keys.append(kind << 36 | whole[a][on] << 12 | index[on, i])
    (n0, i0), (n1, i1), (n2, i2) = segments
    for i in most:
        for j in most:
            for k in most:
                on = np.flatnonzero((n0 > i) & (n1 > j) & (n2 > k))
                rows.append(on)
                keys.append(6 << 36 | i0[on, i] << 24 | i1[on, j] << 12 | i2[on, k])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    counts, patterns = golay_patterns()
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(fp.view(np.uint64), counts, patterns)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])


def _forest(v: np.ndarray) -> tuple[list, list]:
    """A spanning forest of the links among distinct fingerprints, breadth first; memory grows with their number only."""
    left, a, b = np.arange(len(v)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(v[left] ^ v[at]) <= RADIUS
            found = left[near]
            a += [v[at]] * len(found)
            b += v[found].tolist()
            queue += found.tolist()
            left = left[~near]
    return a, b


def _links_of_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    for s, n in zip(starts[sizes > 24], sizes[sizes > 24]):
        x, y = _forest(np.unique(fp[s : s + n]))
        a.append(np.array(x, dtype=np.uint64))
        b.append(np.array(y, dtype=np.uint64))
    at = np.flatnonzero(np.repeat(sizes <= 24, sizes))
    lag = 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at + lag] == key[at]]
        on = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= RADIUS]
        a.append(fp[on])
        b.append(fp[on + lag])
        lag += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _verified(batches):
    """Batches are sorted by key within a task; a run that a batch cuts is carried to the next one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(key, fp):
        a, b = _links_of_runs(key, fp)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    held, held_rows = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        held_rows += batch.num_rows
        if held_rows < 200_000:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield out(key[:cut], fp[:cut])
        held, held_rows = [(key[cut:], fp[cut:])], 0
    if held:
        key, fp = (np.concatenate(x) for x in zip(*held))
        if len(key):
            yield out(key, fp)


def links(classes: DataFrame) -> DataFrame:
    """(a, b): a < b as unsigned fingerprints; a spanning forest, key by key, of all pairs at three bits or fewer."""
    keyed = classes.select("fp").mapInArrow(_keyed, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): label is the smallest node of its component. Large-star and small-star rounds in turn: each node hands
    the smallest one around it to its larger neighbours, then to itself and its smaller ones, until every node hangs on
    its label. The number of edges doesn't grow, and paths shrink to about half a round: 1,024 nodes in a row take about ten,
    whatever their order (tested)."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now, n = scratch.write(edges.filter("a <> b").select(a, b).distinct(), "edges0"), 0
    held = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    while held["n"]:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
        around = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.join(around, "node").filter("other > node").select(F.col("other").alias("a"), F.col("low").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(lowest.select("a", "low"))
        now, n = scratch.write(small.distinct(), f"edges{n + 1}", held["n"]), n + 1
        scratch.drop(f"edges{n - 1}")
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == held:
            break
        held = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long), fingerprint (16 hex digits), component_id (smallest doc_id of
    all documents reachable over links)."""
    scratch = Scratch(session_of(docs))
    marked = scratch.write(with_fingerprint(docs, shingle), "marked")
    most = marked.count()
    classes = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes", most)
    labels = components(links(classes), scratch)
    rooted = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    lowest = rooted.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_class = scratch.write(rooted.join(lowest, "label").select("fp", "component_id"), "of_class", most)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_class, "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs that stay names by (doc_id, mark: hash of the text), one of each. Texts are dealt out once, by
    the keys of the join, which drop repeated rows as well. All columns of docs stay, whatever their names."""
    keys = ["__none", "__id", "__mark"]
    plain, named = plain_names(docs)

    def keyed(df: DataFrame, mark) -> DataFrame:
        return df.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__mark": mark})

    wanted = keyed(stay, F.col("mark")).select(*keys)
    return named(keyed(plain, text_mark()).join(wanted, keys, "left_semi").dropDuplicates(keys))


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last, then the smallest hash of its
    text). An id that stands on several texts is judged text by text, so a row goes only where another row of its own
    component stays, whatever the order of the rows."""
    scratch = Scratch(session_of(docs))

    def run(texts):
        return [pa.array(np.array([fingerprint(t, shingle) for t in bytes_of(texts)], dtype=np.uint64).view(np.int64))]

    marked = add_columns(docs.select("doc_id", text_mark().alias("mark"), "text"), run, ["text"], [("fp", T.LongType())], keep=["doc_id", "mark"])
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = scratch.write(marked.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    labels = components(links(classes), scratch)
    of_class = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    kept = of_class.groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    return keep_rows(docs, scratch.write(kept.select("first.doc_id", "first.mark"), "stay"))
