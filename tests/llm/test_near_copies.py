"""The pipeline's near-duplicate stage against plain loops over five-word shingles."""

import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_brute import brute_kept
from shelfwise.llm import near_copies, packing, simhash, substring, toxicity
from shelfwise.llm.common import Scratch

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stage_drops_all_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == want


def test_large_group_and_repeated_ids(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]

    def edited(n):
        return " ".join(w if i not in n else f"x{rnd.random()}" for i, w in enumerate(base))

    group = [(100 + k, edited({rnd.randrange(200)})) for k in range(300)]
    # Id 7 stands on two texts: one a near copy of a smaller id's, one nobody's.
    rows = [(5, " ".join(base)), (7, edited({50})), (7, "nobody else has these few words"), (8, None), (9, ""), (None, "of no id"), *group]
    kept = near_copies.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[5]]))


def templates(rnd, n, copies, share, edits):
    """n texts on one template of 300 words, each with its own words at a share of the places, and edited copies of some. Edits
    stand together, so that they cost few shingles."""
    base = [f"w{i}" for i in range(300)]
    own = int(300 * share)
    out = []
    for k in range(n):
        at = rnd.randrange(300 - own)
        out.append(base[:at] + [f"t{k}x{i}" for i in range(own)] + base[at + own :])
    for k in range(copies):
        words = list(out[k])
        at = rnd.randrange(300 - edits)
        words[at : at + edits] = [f"c{k}y{i}" for i in range(edits)]
        out.append(words)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("share", "edits"), [(0.11, 24), (0.125, 14), (0.14, 8)])
def test_template_texts_lose_no_link(spark, share, edits):
    """Originals at a similarity just under 0.8 to each other, copies just over it to their originals, all under long runs."""
    rows = templates(random.Random(7), 600, 100, share, edits)
    random.Random(8).shuffle(rows)
    want = brute_kept(rows)
    assert 600 <= len(want) < 700
    kept = near_copies.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {r["doc_id"] for r in kept.collect()} == want


def test_columns_of_any_name_and_text_ids(spark):
    rows = [("b", "one two three four five six seven eight", 1), ("a", "one two three four five six seven eight", 2), (None, None, 3), ("c", "something else altogether", 4)]
    names = ["__id", "__none", "__mark", "__hash", "__found", "n_words__", "last__", "cls", "c2_", "mark"]
    df = spark.createDataFrame(rows, "doc_id string, text string, n long").select("*", *(F.col("n").alias(c) for c in names))
    kept = near_copies.keep_distinct(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or "", r["n"], *(r[c] for c in names)) for r in kept.collect()) == [(d, n, *[n] * len(names)) for d, n in (("", 3), ("a", 2), ("c", 4))]
    cut = substring.remove_repeats(df)
    assert cut.columns == df.columns and sorted(r["__hash"] for r in cut.collect()) == [1, 2, 3, 4]
    assert {r["doc_id"] for r in packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {"a", "b", "c", None}
    labels = df.filter("doc_id IS NOT NULL").select("doc_id", (F.col("n") % 2).cast("int").alias("toxic"))
    assert toxicity.detect(df, labels).count() == 4


@pytest.mark.parametrize("order", ["falling", "shuffled", "zero first"])
def test_components_of_long_paths_take_few_rounds(spark, order, monkeypatch):
    n = 1000
    ids = list(range(n, 0, -1)) if order != "shuffled" else random.Random(2).sample(range(1, n + 1), n)
    if order == "zero first":
        ids = [0, *ids]
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, most=None: written.append(name) or write(self, df, name, most))
    labels = simhash.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), Scratch(spark))
    assert {(r["node"], r["label"]) for r in labels.collect()} == {(i, min(ids)) for i in ids}
    assert len(written) <= 20
