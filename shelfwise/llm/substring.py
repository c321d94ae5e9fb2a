"""Exact substring deduplication with suffix automata over shards of repeated passages.

A window is `window` consecutive words. Each window is anchored at its minimizer, the leftmost of its `seed`-word
grams with the smallest hash, so equal windows have equal anchors at equal places. A shard is everything around one
anchor hash: the distinct contexts in which it occurs, each with its first place. Shards are made only for anchors
that may occur twice. Within a shard the contexts are streamed, in order of first place, through the suffix automaton
of the contexts before them; matching statistics of a window's length or more show the windows that occur earlier,
and the context then joins the automaton. Maximal spans of such windows are removed.

A shard is held by the one task that owns it, and only contexts with its anchor are streamed through it: sending each
automaton to all documents would read the corpus once for every shard. Shards of more than `largest_shard` contexts (a
common line in many surroundings) are cut into sub-shards with automata of their own: windows that reach half of their
other words or more beyond the anchor go by the words that follow it, all others by the words before it. What is too
large still shares an anchor and that side; there each window is a shard by itself, and its first place a partial aggregate.

Which anchors occur twice is broadcast as a bitmap of their hashes, of 2**`most_bits` bits at most; it decides how
many anchors are looked at, not the result. A corpus with more such anchors than the bitmap can tell apart (one in 16
bits) has its contexts joined with them instead. Words are compared by their 64-bit hashes, within equal 64-bit anchors.

Rows: null texts have no words. Places are ordered by (doc_id, hash of the text, word); null ids come first. Rows
with the same doc_id and text are one document and get the same result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bytes_of, id_type, plain_names, session_of

BYTES = 8  # of a word's hash that a context keeps
SLICE = 14  # bits of the places that one group packs into the bitmap
GAP = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Spans:
    window: int = 20
    seed: int = 8
    largest_shard: int = 256
    most_bits: int = 29

    def __post_init__(self):
        if not 1 <= self.seed < self.window or self.reach > 62:
            raise ValueError("seed has to be under window, by 62 words at most: a mask of 63 bits holds the windows of an anchor")

    @property
    def half(self) -> int:
        """Words on one side that tell sub-shards apart: every window reaches so many beyond one of its anchor's ends."""
        return (self.reach + 1) // 2

    @property
    def reach(self) -> int:
        """Words of a window besides its anchor."""
        return self.window - self.seed


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def anchors(h: np.ndarray, spans: Spans):
    """(hash, place, least, most) of each anchor: windows that start `least` to `most` words before place have it."""
    if len(h) < spans.window:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    n = len(h) - spans.seed + 1
    g = np.zeros(n, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(spans.seed):
        g += h[j : j + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    views = np.lib.stride_tricks.sliding_window_view(g, spans.reach + 1)
    at = np.arange(len(views)) + views.argmin(axis=1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    # Minimizers are small by nature; an odd factor spreads them over all keys again.
    return g[place] * np.uint64(0x9E3779B97F4A7C15), place, place - last, place - first


def _counted(spans: Spans):
    def run(batches):
        for b in batches:
            keys = [anchors(word_hashes((t or b"").split()), spans)[0] for t in bytes_of(b.column(0))]
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def repeated_anchors(docs: DataFrame, spans: Spans, scratch: Scratch) -> tuple[DataFrame, np.ndarray | None, int]:
    """The hashes of anchors that occur twice (key); a bitmap over their leading bits, and the number of those bits. No
    bitmap where `most_bits` are too few to tell them apart."""
    counts = docs.select("text").mapInArrow(_counted(spans), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    twice = scratch.write(counts.filter("n > 1").select("key"), "twice")
    bits = int(max(min(20, spans.most_bits), np.ceil(np.log2(16 * max(1, twice.count())))))
    if bits > spans.most_bits:
        return twice, None, 0
    # Places in the bitmap are distinct and lie in slices of 2**SLICE: what one group gathers is bounded.
    width = min(SLICE, bits)
    places = twice.select(F.shiftrightunsigned("key", 64 - bits).alias("place")).distinct()

    def packed(rows: pa.Table) -> pa.Table:
        on = np.zeros(1 << width, dtype=bool)
        place = rows.column("place").to_numpy()
        on[place & ((1 << width) - 1)] = True
        return pa.table({"slice": pa.array([int(place[0] >> width)]), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    slices = places.withColumn("slice", F.shiftright("place", width)).groupBy("slice").applyInArrow(packed, "slice long, bits binary").toArrow()
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for at, b in zip(slices["slice"].to_pylist(), slices["bits"].to_pylist()):
        bitmap[at << (width - 3) : (at + 1) << (width - 3)] = np.frombuffer(b, dtype=np.uint8)
    return twice, bitmap, bits


def _on(bitmap: np.ndarray | None, bits: int, key: np.ndarray) -> np.ndarray:
    """Which anchors may occur twice: all, where no bitmap tells."""
    if bitmap is None:
        return np.ones(len(key), dtype=bool)
    place = (key >> np.uint64(64 - bits)).astype(np.int64)
    return bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 > 0


def _contexts(spans: Spans, shared, bits: int):
    """Rows (key, context, doc_id, text_hash, place): a context is least, most, the words before the anchor, those after."""

    def run(batches):
        bitmap = shared.value
        for b in batches:
            out: dict = {"key": [], "context": [], "doc": [], "place": []}
            for d, t in enumerate(bytes_of(b.column(2))):
                h = word_hashes((t or b"").split())
                key, place, least, most = anchors(h, spans)
                on = np.flatnonzero(_on(bitmap, bits, key))
                if not len(on):
                    continue
                raw = h.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
                for p, lo, hi in zip(place[on].tolist(), least[on].tolist(), most[on].tolist()):
                    out["context"].append(bytes((lo, hi)) + raw[BYTES * (p - hi) : BYTES * p] + raw[BYTES * (p + spans.seed) : BYTES * (p + spans.window - lo)])
                out["key"].append(key[on].view(np.int64))
                out["place"].append(place[on])
                out["doc"].append(np.full(len(on), d))
            if not out["key"]:
                continue
            doc = pa.array(np.concatenate(out["doc"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out["key"])), pa.array(out["context"], pa.binary()), b.column(0).take(doc), b.column(1).take(doc), pa.array(np.concatenate(out["place"]).astype(np.int32))],
                names=["key", "context", "doc_id", "text_hash", "place"],
            )

    return run


class SuffixAutomaton:
    """Of a set of sequences, grown one symbol at a time."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, sequence: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            known = nxt[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:  # the state stands for longer strings too: it is split
                last = self._split(last, c, known)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else self._split(p, c, q)
            last = cur

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def matching(self, sequence: list) -> list[int]:
        """At each place, the length of the longest suffix of sequence[: place + 1] that occurs in a sequence added."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            out.append(n)
        return out


def symbols(context: bytes) -> tuple[int, int, list]:
    """least, most, and the words of a context with an empty symbol for the anchor."""
    least, most = context[0], context[1]
    words = [context[i : i + BYTES] for i in range(2, len(context), BYTES)]
    return least, most, [*words[:most], b"", *words[most:]]


def first_windows(contexts: list[bytes], spans: Spans) -> list[int]:
    """For each context of a shard, in order of first place: bits of the windows (by words before the anchor) that no
    earlier context has."""
    out = []
    automaton = SuffixAutomaton()
    for k, context in enumerate(contexts):
        least, most, line = symbols(context)
        own = (1 << (most + 1)) - (1 << least)
        if k:
            for i, n in enumerate(automaton.matching(line)):
                if n > spans.reach:
                    own &= ~(1 << (most - (i - spans.reach)))
        if k + 1 < len(contexts):
            automaton.add(line)
        out.append(own)
    return out


def _resolved(spans: Spans):
    """Batches are sorted by key and first place within a task; a shard that a batch cuts is carried on."""

    def out(rows: pa.Table):
        key = rows.column("key").to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        contexts = rows.column("context").to_pylist()
        own: list[int] = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            own += first_windows(contexts[s:e], spans)
        made = pa.table({"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"), "place": rows.column("place"), "own": pa.array(own, pa.int64())})
        return made.filter(pa.compute.not_equal(made.column("own"), 0)).combine_chunks().to_batches()

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < 50_000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from out(rows.slice(0, cut).combine_chunks())
            held, n = rows.slice(cut).combine_chunks().to_batches(), len(rows) - cut
        if n:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    return run


def _sides(spans: Spans):
    """The two sub-shards of each context, as rows (key, side, context, first): side begins with A and holds the words that
    follow the anchor, for windows that reach `half` of them, or with B and the words before it, for all other windows."""

    def run(batches):
        for b in batches:
            rows, side, cut = [], [], []
            for r, context in enumerate(b.column(1).to_pylist()):
                least, most, words = context[0], context[1], context[2:]
                anchor = BYTES * most
                last_a = min(most, spans.reach - spans.half)  # windows with so many words before the anchor reach half after it
                if least <= last_a:
                    rows.append(r)
                    side.append(b"A" + words[anchor : anchor + BYTES * spans.half])
                    cut.append(bytes((least, last_a)) + words[BYTES * (most - last_a) :])
                first_b = max(least, last_a + 1)
                if first_b <= most:
                    rows.append(r)
                    side.append(b"B" + words[anchor - BYTES * (spans.reach - spans.half + 1) : anchor])
                    cut.append(bytes((first_b, most)) + words[: anchor + BYTES * (spans.reach - first_b)])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(side, pa.binary()), pa.array(cut, pa.binary()), b.column(2).take(take)], names=["key", "side", "context", "first"])

    return run


def _windows(spans: Spans):
    """A row for each window of each context."""

    def run(batches):
        for b in batches:
            rows, bit, window = [], [], []
            for r, context in enumerate(b.column(1).to_pylist()):
                least, most = context[0], context[1]
                words = context[2:]
                for o in range(least, most + 1):
                    at = BYTES * (most - o)
                    rows.append(r)
                    bit.append(o)
                    window.append(words[at : at + BYTES * spans.reach])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(bit, pa.int32()), pa.array(window, pa.binary()), b.column(2).take(take)], names=["key", "o", "window", "first"])

    return run


def _shards(contexts: DataFrame, shard: list[str], spans: Spans) -> DataFrame:
    """(doc_id, text_hash, place, own) of the contexts, each shard streamed through its automaton."""
    kind = contexts.select("first.doc_id").schema["doc_id"].dataType.simpleString()
    flat = contexts.select(F.xxhash64(*shard).alias("key") if len(shard) > 1 else F.col("key"), *shard[1:], "context", "first.doc_id", "first.text_hash", "first.place")
    ordered = flat.repartition("key").sortWithinPartitions("key", *shard[1:], "doc_id", "text_hash", "place")
    return ordered.drop(*shard[1:]).mapInArrow(_resolved(spans), f"doc_id {kind}, text_hash long, place int, own long")


def first_places(docs: DataFrame, spans: Spans, scratch: Scratch):
    """(firsts, bitmap, bits). firsts: for documents, the anchors that may occur twice and have windows that occur nowhere
    earlier, as (doc_id, text_hash, found: array of (place, own)). With a bitmap, an anchor in it that isn't there has
    earlier windows only; without one, such anchors are there too, with own 0."""
    spark = docs.sparkSession
    twice, bitmap, bits = repeated_anchors(docs, spans, scratch)
    shared = spark.sparkContext.broadcast(bitmap)
    seen = docs.select("doc_id", "text_hash", "text").mapInArrow(_contexts(spans, shared, bits), f"key long, context binary, doc_id {id_type(docs)}, text_hash long, place int")
    known = None
    if bitmap is None:
        seen = scratch.write(seen.join(twice, "key", "left_semi"), "seen")
        known = seen.select("doc_id", "text_hash", "place", F.lit(0).cast("long").alias("own"))
    # Copies of a passage meet map-side already: one row for each distinct context.
    distinct = scratch.write(seen.groupBy("key", "context").agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("first")), "contexts")
    scratch.drop("twice")
    hot = scratch.write(distinct.groupBy("key").count().filter(F.col("count") > spans.largest_shard).select("key"), "hot")
    first_type = distinct.schema["first"].dataType.simpleString()
    cold = _shards(distinct.join(hot, "key", "left_anti"), ["key"], spans)
    sides = distinct.join(hot, "key", "left_semi").select("key", "context", "first").mapInArrow(_sides(spans), f"key long, side binary, context binary, first {first_type}")
    # Contexts that differ beyond a side's windows are one there.
    sides = scratch.write(sides.groupBy("key", "side", "context").agg(F.min("first").alias("first")), "sides")
    large = scratch.write(sides.groupBy("key", "side").count().filter(F.col("count") > spans.largest_shard).select("key", "side"), "large")
    warm = _shards(sides.join(large, ["key", "side"], "left_anti"), ["key", "side"], spans)
    exploded = sides.join(large, ["key", "side"], "left_semi").select("key", "context", "first").mapInArrow(_windows(spans), f"key long, o int, window binary, first {first_type}")
    least = exploded.groupBy("key", "o", "window").agg(F.min("first").alias("first"))
    rest = least.select("first.doc_id", "first.text_hash", "first.place", F.expr("shiftleft(1L, o)").alias("own"))
    every = cold.unionByName(warm).unionByName(rest)
    every = every if known is None else every.unionByName(known)
    firsts = every.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "own")).alias("found"))
    firsts = scratch.write(firsts, "firsts")
    for name in ("contexts", "hot", "sides", "large", "seen"):
        scratch.drop(name)
    return firsts, shared, bits


def covered(h: np.ndarray, found: list, bitmap: np.ndarray, bits: int, spans: Spans) -> np.ndarray:
    """Which words lie in a window that occurs earlier."""
    none = np.zeros(len(h), dtype=bool)
    if len(h) < spans.window:
        return none
    key, place, least, most = anchors(h, spans)
    own: dict = {}
    for x in found or ():
        own[x["place"]] = own.get(x["place"], 0) | x["own"]
    on = np.flatnonzero(_on(bitmap, bits, key) if bitmap is not None else np.isin(place, list(own)))
    if not len(on):
        return none
    place, least, most = place[on], least[on], most[on]
    mine = np.array([own.get(p, 0) for p in place.tolist()], dtype=np.int64)
    # Anchors without a first window cover one run of words; only others are taken window by window.
    whole = mine == 0
    begin, end = [place[whole] - most[whole]], [place[whole] - least[whole] + spans.window]
    place, least, most, mine = place[~whole], least[~whole], most[~whole], mine[~whole]
    some = mine != (1 << (most + 1)) - (1 << least)
    place, least, most, mine = place[some], least[some], most[some], mine[some]
    for o in range(spans.reach + 1) if len(place) else ():
        start = place[(least <= o) & (o <= most) & (mine >> o & 1 == 0)] - o
        begin.append(start)
        end.append(start + spans.window)
    n = len(h) + 1
    edges = np.bincount(np.concatenate(begin), minlength=n) - np.bincount(np.concatenate(end), minlength=n)
    return np.cumsum(edges[:-1]) > 0


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """text without the words marked; of the white space around a removed span, what precedes it stays."""
    out, at, k = [], 0, 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    spans = list(GAP.finditer(text))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[at : spans[s].start()])
        at = spans[e].start() if e < len(spans) else len(text)
        k = e
    return b"".join([*out, text[at:]])


def _judged(spans: Spans, shared, bits: int, with_text: bool):
    def run(batches):
        bitmap = shared.value
        for b in batches:
            names = b.schema.names
            n_words, n_removed, digest, kept_text = [], [], [], []
            for t, found in zip(bytes_of(b.column(names.index("text"))), b.column(names.index("__found")).to_pylist()):
                words = (t or b"").split()
                gone = covered(word_hashes(words), found, bitmap, bits, spans)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                if with_text:
                    kept_text.append(t if t is None or not n_removed[-1] else _cut(t, gone))
                else:
                    kept = words if not n_removed[-1] else [w for w, g in zip(words, gone.tolist()) if not g]
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            last = pa.array(kept_text, pa.binary()).cast(pa.string()) if with_text else pa.array(digest, pa.string())
            keep = [i for i, n in enumerate(names) if n not in ("__found", "__hash", "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last], names=[*(names[i] for i in keep), "n_words__", "n_removed__", "last__"])

    return run


def _run(docs: DataFrame, spans: Spans, with_text: bool) -> DataFrame:
    scratch = Scratch(session_of(docs))
    firsts, shared, bits = first_places(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), spans, scratch)
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    f = firsts.select(F.col("doc_id").alias("__f_id"), F.col("text_hash").alias("__f_hash"), F.col("found").alias("__found"))
    joined = hashed.join(f, hashed["doc_id"].eqNullSafe(f["__f_id"]) & (hashed["__hash"] == f["__f_hash"]), "left").drop("__f_id", "__f_hash")
    kept = [x for x in joined.schema.fields if x.name not in ("__found", "__hash", "text")]
    schema = T.StructType([*kept, T.StructField("n_words__", T.LongType()), T.StructField("n_removed__", T.LongType()), T.StructField("last__", T.StringType())])
    return joined.mapInArrow(_judged(spans, shared, bits, with_text), schema)


def repeated_words(docs: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return _run(docs.select("doc_id", "text"), spans, False).select("doc_id", F.col("n_words__").alias("n_words"), F.col("n_removed__").alias("n_removed"), F.col("last__").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, spans: Spans = Spans()) -> DataFrame:
    """docs with the repeated spans cut out of text (n_chars, where there is one, follows), without the rows of which
    nothing is left. All columns stay, whatever their names."""
    plain, named = plain_names(docs)
    out = _run(plain, spans, True).filter("n_words__ = 0 OR n_removed__ < n_words__").withColumn("text", F.col("last__"))
    if "n_chars" in docs.columns:
        n_chars = plain.columns[docs.columns.index("n_chars")]
        out = out.withColumn(n_chars, F.when(F.col("n_removed__") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return named(out)
