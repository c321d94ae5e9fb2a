"""Best-fit packing of tokenized documents under several capacities.

A sequence has three capacities: tokens, documents (pieces) and attention cost (sum of squared piece lengths). Pieces
are taken by falling length; each goes to a sequence that fits it under every capacity, by the smallest weighted norm
of what would be left (or the largest weighted dot product of demand and residual), and opens a new one if none fits.

All pieces of one length ask the same of a sequence and all sequences with the same residual offer the same, so the
packing is decided on the histogram of lengths: at most `tokens` counts, whatever the corpus. Its outcome is a table
of rules (length, ranks, sequences, copies, offset) that grows with the number of lengths, not of documents. Pieces
then find their sequence by their rank among those of their length: the rank inside the task that cut the piece plus
the counts of earlier tasks. So the result is that of one global best fit, and no task sees more than its own rows.

Rows: a null text is empty and packs as the single end id; repeated rows are pieces each, ids may be null. Only
doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import sys
import types as python_types
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_type, session_of

#: Characters on whose classes all Unicode versions agree; a text with others is left to the tokenizer's own splitter.
OTHER = re.compile("[^\x00-\u024f\u2000-\u206f]")
#: Fixed value: how word vocabularies split a text whose white space they drop, so that no piece reaches over a blank.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
BLANKS = str.maketrans("\t\r\n", "   ")
#: Words of characters that normalisation leaves alone, whose case and class no library sees differently, and that begin
#: no special token; their pieces by WORD_PATTERN.
PLAIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
WORD_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|[0-9]|(?:[^\\w]|_)+")


@dataclass(frozen=True)
class Capacity:
    """documents and attention default to what can't bind before tokens does; rule: norm or dot."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple = (1.0, 0.05, 0.05)
    rule: str = "norm"

    @property
    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself,
    the other bytes take the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer file's own library gives them
    without added special tokens. Where the vocabulary is byte-level BPE in rank order, the same merges are run by a
    faster library, built from that file; texts with rare characters, and those whose runs of blanks are too long for
    that library's pattern engine, go to the tokenizer itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"]["type"] == "BPE" and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["normalizer"]:
            import tiktoken
            from public_tokenizers import PATTERN

            of, special = byte_symbols(), {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("of_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = first.get("type") == "Split" and first["pattern"] == {"Regex": WORD_PATTERN} and first["behavior"] == "Removed" and first["invert"]
        self.counts: dict[str, int] = {}
        self.pieces = self._word_pieces(spec) if self.by_word and spec["model"].get("end_of_word_suffix") == WORD_END else None

    def _word_pieces(self, spec: dict):
        """The merges of a word vocabulary for the faster library: the end of a word is the byte 255, which no text has.
        None if the vocabulary isn't in the order of its merges."""
        import tiktoken

        of, special = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        order = [t for t in sorted(spec["model"]["vocab"], key=spec["model"]["vocab"].get) if t not in special]
        if order[len(order) - len(merged) :] != merged:
            return None
        as_bytes = lambda t: bytes(of[c] for c in t.removesuffix(WORD_END)) + b"\xff" * t.endswith(WORD_END)
        ranks = {as_bytes(t): i for i, t in enumerate(order)}
        return tiktoken.Encoding("of_words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """One for each worker process."""
        held = sys.modules.setdefault("_shelfwise_encoders", python_types.ModuleType("_shelfwise_encoders"))
        if path not in held.__dict__:
            held.__dict__[path] = cls(path)
        return held.__dict__[path]

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not OTHER.search(text):
            try:
                return array("I", self.fast.encode(text, allowed_special="all")).tobytes()
            except ValueError as e:  # the engine's stack ends at runs of about a million blanks
                if "stack size exceeded" not in str(e):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def count(self, text: str) -> int:
        """How many ids encode() gives. Where no token reaches over a blank, words are counted once each and remembered;
        what is remembered is bounded."""
        if not self.by_word:
            return len(self.encode(text)) // 4
        counts, total = self.counts, 0
        for word in text.translate(BLANKS).split(" "):
            n = counts.get(word)
            if n is None:
                n = self._count_word(word)
                if len(counts) < 300_000 and len(word) <= 40:
                    counts[word] = n
            total += n
        return total

    def _count_word(self, word: str) -> int:
        if self.pieces is None or not PLAIN.fullmatch(word):
            return len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return sum(len(self.pieces(p.encode() + b"\xff")) for p in WORD_PIECE.findall(word.lower()))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: those longer than size are cut, all but the first being full."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encoder, part, seen = Encoder.of_process(path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc, rank, tokens = [], [], [], [], [], [], []
            for d, t in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(t or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)]))
                    rank.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        tokens.append(np.frombuffer(ids, dtype="<u4")[s : s + n].astype(np.int32))
            more = [pa.array(tokens, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, rank)), pa.array(np.full(len(doc), part), pa.int64()), *more],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank_in_part", "part", *(["ids"] if with_ids else [])],
            )

    return run


def pack(histogram: dict[int, int], capacity: Capacity = Capacity()) -> tuple[np.ndarray, int]:
    """(rules, number of sequences). A rule (length, rank, n, sequence, copies, offset): pieces of that length with
    ranks from rank to rank + n go, copies to each, to the sequences from `sequence` on, from offset on."""
    limits = capacity.limits.astype(float)
    weights = np.array(capacity.weights)
    room = np.zeros((0, 3), dtype=np.int64)  # what a class of sequences has left
    ranges: list[list[tuple[int, int]]] = []  # the sequences of each class: (first, number)
    at: dict[tuple, int] = {}
    rules, opened = [], 0

    def put(left: np.ndarray, first: int, n: int) -> None:
        nonlocal room
        if left[0] < 1 or left[1] < 1 or left[2] < 1:
            return
        key = tuple(left.tolist())
        if key in at:
            ranges[at[key]].append((first, n))
            return
        free = next(iter(empty), None)
        if free is None:
            grown = np.zeros((max(64, 2 * len(room)), 3), dtype=np.int64)
            grown[: len(room)] = room
            empty.update(range(len(room), len(grown)))
            ranges.extend([] for _ in range(len(grown) - len(room)))
            room = grown
            free = next(iter(empty))
        empty.discard(free)
        room[free], ranges[free], at[key] = left, [(first, n)], free

    empty: set[int] = set()
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        demand = np.array([length, 1, length * length], dtype=np.int64)
        while left:
            fits = np.flatnonzero((room >= demand).all(1))
            if len(fits):
                rest = room[fits]
                if capacity.rule == "dot":
                    best = fits[np.argmax((weights * (demand / limits) * (rest / limits)).sum(1))]
                else:
                    best = fits[np.argmin((weights * ((rest - demand) / limits) ** 2).sum(1))]
                have = room[best].copy()
                copies = int((have // demand).min())
                first, n = ranges[best].pop()
                offset = int(capacity.tokens - have[0])
            else:
                have, best = capacity.limits, None
                copies = int((have // demand).min())
                if copies < 1:
                    raise ValueError(f"a piece of {length} tokens exceeds a capacity of a sequence")
                n = max(1, left // copies)
                first, offset = opened, 0
                opened += n
            use = min(n, left // copies)
            if use == 0:  # fewer pieces than one sequence takes
                use, copies = 1, left
            rules.append((length, rank, use * copies, first, copies, offset))
            put(have - copies * demand, first, use)
            if best is not None:
                if use < n:
                    ranges[best].append((first + use, n - use))
                elif not ranges[best]:
                    del at[tuple(room[best].tolist())]
                    room[best] = 0
                    empty.add(int(best))
            elif use < n:
                opened = first + use
            rank += use * copies
            left -= use * copies
    return np.array(rules, dtype=np.int64).reshape(-1, 6), opened


def _placed(rules: np.ndarray, batches):
    by = {int(n): rules[rules[:, 0] == n] for n in np.unique(rules[:, 0])}
    for b in batches:
        names = b.schema.names
        length, rank = (b.column(names.index(c)).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(rows):
                r = by[int(length[rows[0]])]
                k = np.searchsorted(r[:, 1], rank[rows], side="right") - 1
                inside = rank[rows] - r[k, 1]
                sequence[rows] = r[k, 3] + inside // r[k, 4]
                offset[rows] = r[k, 5] + inside % r[k, 4] * r[k, 0]
        keep = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids") if c in names]
        yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in keep if c != "ids"), pa.array(sequence), pa.array(offset), *(b.column(names.index(c)) for c in keep if c == "ids")], names=[*(c for c in keep if c != "ids"), "sequence_id", "offset", *(c for c in keep if c == "ids")])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and if wanted ids (array of int), of every piece."""
    spark = session_of(docs)
    scratch = Scratch(spark)
    cut_docs = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity.tokens, end_id, with_ids), f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long, rank_in_part long, part long" + ", ids array<int>" * with_ids)
    pieces = scratch.write(cut_docs, "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.write(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases", pieces.count())
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity.tokens rows at most
    shared = spark.sparkContext.broadcast(pack(histogram, capacity)[0])
    # The bases grow with the map tasks, so they aren't broadcast; no key of this join has more rows than one map task.
    ranked = pieces.join(bases.select("length", "part", "base").hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "rank"]
    return ranked.select(*columns).mapInArrow(lambda batches: _placed(shared.value, batches), f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences of pieces packed with their ids: sequence_id, input_ids, and in doc_lengths where each
    piece ends. A group holds one sequence, so at most its capacity of tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"), F.transform("parts", lambda p: p["length"]).alias("doc_lengths"))
