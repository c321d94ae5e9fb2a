"""Vector packing: every id once, in gapless sequences under all limits, and as a loop that places pieces one by one."""

import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import queries, vector_packing
from shelfwise.llm.vector_packing import Limits, cut, plan

SF2 = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF2), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text, prompt=None):
    before = tokenizer.encode(prompt, add_special_tokens=False).ids if prompt else []
    return before + tokenizer.encode(text or "", add_special_tokens=False).ids + [0], len(before)


def check(found, wanted, limits):
    """found: pieces; wanted: {doc_id: (ids, prompt ids)}. Returns the number of padding ids."""
    tokens, segments, loss = limits.all.tolist()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(wanted)
    for d, pieces in by_doc.items():
        ids, before = wanted[d]
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            own = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(own)
            if "loss" in r:
                assert r["loss"] == max(0, at + r["length"] - max(at, before))
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens and len(pieces) <= segments
        if "loss" in pieces[0]:
            assert sum(r["loss"] for r in pieces) <= loss
        padded += 0 if at & (at - 1) == 0 else tokens - at
    return padded


@needs_tables
def test_query_pads_nothing_and_keeps_every_id(spark, tokenizer):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").collect()
    found = queries.queries()["op13_vector_packing"](spark, SF2).collect()
    assert found[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    wanted = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in docs}
    assert check([r.asDict() for r in found], wanted, Limits()) == 0
    total = sum(len(i) for i, _ in wanted.values())
    whole = sum(len(cut(len(i), 0, Limits())) for i, _ in wanted.values())
    assert len({r["sequence_id"] for r in found}) <= total / 1024 + 11
    assert len(found) - whole < 0.5 * total / 1024  # fewer cuts than by chunks of a stream, about one a sequence


@pytest.mark.parametrize("limits", [Limits(256, 6, 100, grain=8), Limits(256, 3), Limits(200, None, 90), Limits(256, 1, 256), Limits(64, 5, 33, (1, 3, 2))])
def test_limits_hold_on_instruction_examples(spark, tokenizer, limits):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 1, 5, 40, 150, 700])), rnd.choice([None, "", text(20), text(300)])) for i in range(120)]
    rows += [(i + 200, t, p) for i, (_, t, p) in enumerate(rows[:20])] + [(900, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ask string").withColumns({c: F.lit(1) for c in ("ids", "kind", "part", "rank", "loss", "prompt")}).repartition(5)
    found = vector_packing.pack_examples(df, PATH, limits, prompt="ask", with_ids=True)
    pieces = [r.asDict() for r in found.collect()]
    wanted = {i: ids_of(tokenizer, t, p) for i, t, p in rows}
    check(pieces, wanted, limits)
    made = {r["sequence_id"]: r for r in vector_packing.sequences(found).collect()}
    for s, r in made.items():
        own = sorted((p for p in pieces if p["sequence_id"] == s), key=lambda p: p["offset"])
        assert np.frombuffer(r["input_ids"], "<u4").tolist() == [x for p in own for x in wanted[p["doc_id"]][0][p["start"] : p["start"] + p["length"]]]
        assert r["lengths"] == [p["length"] for p in own] and r["losses"] == [p["loss"] for p in own]


def one_by_one(histogram, limits):
    """Sequences as multisets of pieces, filled one at a time by the largest dot product."""
    caps, weights = limits.all, np.array(limits.weights)
    left, bins = [k for k, n in sorted(histogram.items(), reverse=True) for _ in range(n)], []
    while left:
        room, own = caps.copy(), []
        while True:
            scored = [(-float(np.array([n, 1, w]) / caps * weights @ (room / caps)), i) for i, (n, w) in enumerate(left) if n <= room[0] and room[1] and w <= room[2]]
            if not scored:
                break
            n, w = left.pop(min((round(s, 12), i) for s, i in scored)[1])
            own.append((n, w))
            room -= np.array([n, 1, w])
        bins.append(tuple(sorted(own)))
    return collections.Counter(bins)


@pytest.mark.parametrize("limits", [Limits(50), Limits(50, 4), Limits(50, 4, 20, grain=1), Limits(60, 9, 30, (2, 0.5, 1), grain=1)])
def test_patterns_equal_placing_one_by_one(limits, monkeypatch):
    rnd = random.Random(9)
    histogram = collections.Counter()
    for _ in range(300):
        n = rnd.choice([50, 50, 31, 20, 7, 3, 1])
        histogram[n, min(rnd.choice([0, n // 2, n]), limits.loss or n)] += 1
    found, real = collections.Counter(), vector_packing._fill

    def noted(counts, length, loss, lim):
        taken = real(counts, length, loss, lim)
        need = collections.Counter()
        for k, n in taken:
            need[k] += n
        times = min(int(counts[k]) // n for k, n in need.items())
        found[tuple(sorted((int(length[k]), int(loss[k])) for k, n in need.items() for _ in range(n)))] += times
        return taken

    monkeypatch.setattr(vector_packing, "_fill", noted)
    plan(dict(histogram), limits)
    assert found == one_by_one(histogram, limits)


def test_equal_lengths_that_leave_gaps_are_cut_into_them():
    p = plan({(600, 600): 1000})
    kept, moved = (p.rules[p.rules[:, 6] < 0, 2].sum(), p.rules[p.rules[:, 6] >= 0, 2].sum())
    assert (kept, moved) == (585, 415)  # 586 sequences of 1,024 would hold all
    first, tail = p.gaps[0].tolist(), p.gaps[1:].tolist()
    assert first == [0, 424, 415, 600] and tail[0][0] == 585 * 424 and all(g & (g - 1) == 0 for _, g, _, _ in tail)
    assert 585 * 424 + sum(g for _, g, _, _ in tail) == 415 * 600


def test_text_ids_long_texts_and_empty_tables(spark, tokenizer):
    rows = [("a", "word " * 30_000), ("b", None), (None, ""), ("c", "x")]
    found = [r.asDict() for r in vector_packing.pack_examples(spark.createDataFrame(rows, "doc_id string, text string"), PATH).collect()]
    assert check(found, {d: ids_of(tokenizer, t) for d, t in rows}, Limits()) == 0
    assert vector_packing.pack_examples(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
