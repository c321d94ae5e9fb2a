"""Vector bin packing of instruction examples: tokens, segments and loss-bearing tokens of a sequence are limited at once.

An example is a prompt, whose ids bear no loss, and a text, whose ids do; plain documents have no prompt. Examples longer than a
sequence, or with more loss than one may have, are cut into pieces first. Sequences are then filled one at a time: of all
pieces that fit under every limit, the one with the largest weighted dot product of its demand and what is left goes in.
Pieces of one length and loss are alike, so this is decided on their histogram, and a pattern of pieces is repeated as
long as there are enough of them: the outcome is that of placing them one by one, and its size depends on the limits,
not on the corpus. Loss is rounded up to multiples of `grain` for that.

Where sequences would be padded, the emptiest ones are dissolved: their pieces, laid end to end, are cut into the gaps of the
others, as far as the other two limits let a gap be filled. What exceeds the gaps gets sequences of their own whose
lengths are powers of two, which need no padding. So with limits that don't bind, nothing is padded at all, and cuts
are about as many as gaps.

Pieces find their place by rank: the rank inside the task that cut them plus the counts of earlier tasks. Ids are kept only
with pieces that may be cut again, and only those of dissolved sequences are read back.

Rows: a null text or prompt is empty, so a null row is the end id alone; repeated rows are examples each, ids may be null or
of any type, other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_type, session_of
from .packing import Encoder


@dataclass(frozen=True)
class Limits:
    """Of one sequence; segments and loss default to what can't bind before tokens does."""

    tokens: int = 1024
    segments: int | None = None
    loss: int | None = None
    weights: tuple = (1.0, 1.0, 1.0)
    grain: int = 32

    @property
    def all(self) -> np.ndarray:
        return np.array([self.tokens, self.segments or self.tokens, self.loss or self.tokens], dtype=np.int64)

    def rounded(self, loss: int) -> int:
        """An upper bound of a piece's loss, of few different values."""
        return loss if self.loss is None else min(-(-loss // self.grain) * self.grain, self.loss)


def cut(n: int, prompt: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, length, loss) of the pieces of n ids of which the first `prompt` bear no loss, each as long as it may be."""
    tokens, _, loss = limits.all.tolist()
    found, start = [], 0
    while start < n:
        end = min(n, start + tokens, max(start, prompt) + loss)
        found.append((start, end - start, max(0, end - max(start, prompt))))
        start = end
    return found


def _pieces(path: str, limits: Limits, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encoder, part = Encoder.of_process(path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], dtype="<u4").tobytes(), {}
        for b in batches:
            at, rows = [], []
            for d, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                before = encoder.encode(p) if p else b""
                ids = before + encoder.encode(t or "") + end
                total = len(ids) // 4
                for s, n, loss in cut(total, len(before) // 4, limits):
                    own = ids[4 * s : 4 * (s + n)]
                    kind = n * (limits.tokens + 1) + limits.rounded(loss)
                    rank = seen.get(kind, 0)
                    seen[kind] = rank + 1
                    at.append(d)
                    rows.append((total, s, n, loss, kind, zlib.crc32(own), rank, part, own if with_ids or n < limits.tokens else None))
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "doc_tokens", "start", "length", "loss", "kind", "ids_crc32", "rank_in_part", "part", "ids"])

    return run


@dataclass
class Plan:
    """rules: (kind, rank, n, sequence, copies, offset, stream): the n pieces of a kind from that rank on go, copies to each, to
    the sequences from `sequence` on; or, where stream >= 0, lie from there on in the stream that fills gaps.
    gaps: (position in the stream, length, sequence, offset) of each run of equal gaps, in the stream's order."""

    rules: np.ndarray
    gaps: np.ndarray
    sequences: int


def _fill(counts: np.ndarray, length: np.ndarray, loss: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    """(kind, copies) in the order in which one sequence takes them."""
    room, left, taken = limits.all.copy(), counts.copy(), []
    demand = np.stack([length, np.ones_like(length), loss], 1) / limits.all * np.array(limits.weights)
    while True:
        fits = np.flatnonzero((left > 0) & (length <= room[0]) & (room[1] >= 1) & (loss <= room[2]))
        if not len(fits):
            return taken
        best = int(fits[np.argmax(demand[fits] @ (room / limits.all))])
        if taken and taken[-1][0] == best:
            taken[-1] = (best, taken[-1][1] + 1)
        else:
            taken.append((best, 1))
        left[best] -= 1
        room -= np.array([length[best], 1, loss[best]])


def plan(histogram: dict[tuple[int, int], int], limits: Limits = Limits()) -> Plan:
    """The packing of that many pieces of each (length, loss)."""
    tokens, segments, most_loss = limits.all.tolist()
    kinds = sorted(histogram, reverse=True)
    length, loss = (np.array([k[i] for k in kinds], dtype=np.int64) for i in (0, 1))
    counts, rank = np.array([histogram[k] for k in kinds], dtype=np.int64), np.zeros(len(kinds), dtype=np.int64)
    patterns, opened = [], 0  # (tokens, gap that can be filled, repeats, first sequence, rules)
    while counts.any():
        taken = _fill(counts, length, loss, limits)
        need = np.zeros_like(counts)
        for k, n in taken:
            need[k] += n
        repeats = int((counts[need > 0] // need[need > 0]).min())
        rules, offset = [], 0
        for k, n in taken:
            rules.append((k, int(rank[k]), n, offset))
            rank[k] += n * repeats
            offset += n * int(length[k])
        counts -= need * repeats
        patterns.append((offset, int(need.sum()), int(loss @ need), repeats, opened, rules))
        opened += repeats
    open_ones = [p for p in patterns if p[0] < tokens]
    shortest = min((int(length[k]) for p in open_ones for k, *_ in p[5]), default=1)

    def gap(content: int, used: int, lost: int) -> int:
        """How much of the stream may follow: any stretch of g of it has at most (g - 1) // shortest + 2 pieces, and g at most."""
        free = segments - used
        return max(0, min(tokens - content, most_loss - lost, max(free, (free - 2) * shortest + 1)))

    open_ones.sort(key=lambda p: (p[0], p[4]))
    gaps_left, dissolved = sum(p[3] * gap(*p[:3]) for p in open_ones), {}
    for content, used, lost, repeats, first, _ in open_ones:
        if gaps_left <= 0:
            break
        g = gap(content, used, lost)
        n = min(repeats, -(-gaps_left // (content + g)))
        dissolved[first] = n
        gaps_left -= n * (content + g)
    found, stream = [], 0
    for content, used, lost, repeats, first, rules in patterns:
        out = dissolved.get(first, 0)
        for k, r, n, offset in rules:
            key = int(length[k]) * (tokens + 1) + int(loss[k])
            if out:
                found.append((key, r, out * n, -1, n, 0, stream))
                stream += out * n * int(length[k])
            if repeats > out:
                found.append((key, r + out * n, (repeats - out) * n, first + out, n, offset, -1))
    gaps, at = [], 0
    for content, used, lost, repeats, first, _ in open_ones:
        g, n = gap(content, used, lost), repeats - dissolved.get(first, 0)
        if g and n and at < stream:
            gaps.append((at, g, first + repeats - n, content))
            at += g * n
    size = 1 << (min(tokens, gap(0, 0, 0)).bit_length() - 1)
    while at < stream:
        size = min(size, 1 << ((stream - at).bit_length() - 1))
        gaps.append((at, size, opened, 0))
        at, opened = at + size, opened + 1
    return Plan(np.array(found, dtype=np.int64).reshape(-1, 7), np.array(gaps, dtype=np.int64).reshape(-1, 4), opened)


def _ruled(p: Plan, kind: np.ndarray, rank: np.ndarray):
    """For each piece its rule and its rank among the pieces of that rule."""
    kinds = np.unique(p.rules[:, 0])
    as_one = lambda k, n: np.searchsorted(kinds, k) << 43 | n  # noqa: E731  at most 2**19 kinds, 2**43 pieces of one
    keys = as_one(p.rules[:, 0], p.rules[:, 1])
    order = np.argsort(keys)
    r = p.rules[order[np.searchsorted(keys[order], as_one(kind, rank), side="right") - 1]]
    return r, rank - r[:, 1]


PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "sequence_id", "offset"]


def _whole(p: Plan, batches, with_ids: bool):
    """The pieces of kept sequences."""
    for b in batches:
        get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
        r, inside = _ruled(p, get("kind").to_numpy(), get("rank").to_numpy())
        sequence, offset = r[:, 3] + inside // r[:, 4], r[:, 5] + inside % r[:, 4] * get("length").to_numpy()
        made = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
        names = PLACED + ["ids"] * with_ids
        yield pa.RecordBatch.from_arrays([made[c] if c in made else get(c) for c in names], names=names).filter(pa.array(r[:, 6] < 0))


def _refilled(p: Plan, batches, with_ids: bool):
    """The pieces of dissolved sequences, cut into gaps."""
    for b in batches:
        get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
        r, inside = _ruled(p, get("kind").to_numpy(), get("rank").to_numpy())
        at, rows = [], []
        columns = [get(c).to_pylist() for c in ("start", "length", "doc_tokens", "loss", "ids")]
        for d in np.flatnonzero(r[:, 6] >= 0):
            start, n, total, loss, ids = (c[d] for c in columns)
            position, done = int(r[d, 6] + inside[d] * n), 0
            while done < n:
                k = int(np.searchsorted(p.gaps[:, 0], position, side="right")) - 1
                base, size, sequence, offset = p.gaps[k].tolist()
                which, within = divmod(position - base, size)
                take = min(n - done, size - within)
                own = ids[4 * done : 4 * (done + take)]
                bearing = max(0, done + take - max(done, n - loss))
                at.append(d)
                rows.append((start + done, take, zlib.crc32(own), total, bearing, sequence + which, offset + within, own))
                position, done = position + take, done + take
        made = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64()] * 7 + [pa.binary()]
        keep = 8 if with_ids else 7
        yield pa.RecordBatch.from_arrays([get("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in list(zip(made, kinds))[:keep])], names=PLACED + ["ids"] * with_ids)


def pack_examples(examples: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 0, prompt: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, loss, sequence_id, offset of every piece, and if wanted `ids` (its ids as
    little-endian unsigned 32-bit numbers). prompt names the column of what comes before the text and bears no loss."""
    spark = session_of(examples)
    scratch = Scratch(spark)
    kind_of_id = id_type(examples)
    asked = examples.select("doc_id", "text", (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt"))
    schema = f"doc_id {kind_of_id}, doc_tokens long, start long, length long, loss long, kind long, ids_crc32 long, rank_in_part long, part long, ids binary"
    pieces = scratch.write(asked.mapInArrow(_pieces(tokenizer_path, limits, end_id, with_ids), schema), "pieces")
    counts = pieces.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.write(counts.select("kind", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases", pieces.count())
    # A row for each length and rounded loss: at most tokens * (loss / grain + 1), whatever the corpus.
    found = bases.groupBy("kind").agg(F.sum("n").alias("n")).collect()
    decided = plan({divmod(r["kind"], limits.tokens + 1): r["n"] for r in found}, limits)
    shared = spark.sparkContext.broadcast(decided)
    numbers = bases.select("kind", "part", "base").hint("merge")  # bases grow with the map tasks, so they aren't broadcast

    def ranked(rows: DataFrame, *columns: str) -> DataFrame:
        both = rows.join(numbers, ["kind", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
        return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss", "kind", "rank", *columns)

    schema = f"doc_id {kind_of_id}, start long, length long, ids_crc32 long, doc_tokens long, loss long, sequence_id long, offset long" + ", ids binary" * with_ids
    placed = ranked(pieces, *["ids"] * with_ids).mapInArrow(lambda batches: _whole(shared.value, batches, with_ids), schema)
    loose = sorted({int(k) for k in decided.rules[decided.rules[:, 6] >= 0, 0]})
    if not loose:
        return placed
    again = ranked(pieces.filter(F.col("kind").isin(loose)), "ids").mapInArrow(lambda batches: _refilled(shared.value, batches, with_ids), schema)
    return placed.unionByName(again)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences of pieces packed with their ids: sequence_id, input_ids (bytes of its ids in order), the length of
    each piece and how many of its last ids bear loss. A group holds one sequence, so at most its limits."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "loss", "ids")))
    of = lambda name: F.transform("parts", lambda p: p[name])
    ids = F.aggregate(of("ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", ids.alias("input_ids"), of("length").alias("lengths"), of("loss").alias("losses"))
