"""Toxicity by multiple-instance learning: a document is a bag of sentences, each sentence gets a chance p, and the
document's score is their noisy-or, 1 - prod(1 - p). Only document labels are learned from; the sentences that make
a document toxic follow from their own p.

A sentence's features are its distinct words and their prefixes of 4 to 6 letters (lower case, letters only), each with a
weight of 0 or more. With e the sum of its features' weights, a sentence's chance is that of its evidence alone:
1 - p = (1 + exp(bias)) / (1 + exp(bias + e)), which is 1 without evidence, however many such sentences a document has.
The vocabulary is what separates documents: features in Sample.least_docs toxic documents or more, of which
Sample.features with the highest log odds are kept. The weights are fitted to the likelihood of the noisy-or of just
these chances, and the score is that noisy-or. Learned from are Sample.rows documents per label at most, by smallest
hash; their features are counted, and their sentences reduced to features, on the executors.

Rows: a null or empty text has no sentence and score 0; with nothing to learn from (no labelled row, or one label
only) all scores are 0. Null labels and labels of unknown documents are left out, a document with several labels is
toxic if one says so. Repeated rows are scored one by one. An empty table gives an empty one. Only doc_id, text and
toxic are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns, fold, id_type, session_of

#: Where sentences end (fixed value: regular expression).
BOUNDARY = re.compile(r"[.!?…。！？]+|\n")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Sample:
    """The bound on what the chances are fitted to; scoring covers every row and every text as a whole."""

    rows: int = 2500
    features: int = 1500
    least_docs: int = 4
    least_odds: float = 2.0
    steps: int = 300
    bias: float = -5.0


@dataclass(frozen=True)
class Model:
    weights: dict
    bias: float


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence that has a character."""
    out, at = [], 0
    for m in BOUNDARY.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def bag_of(text: str) -> list[set[str]]:
    """The distinct words of each sentence."""
    return [set(WORD.findall(text[a:b].lower())) for a, b in sentences(text)]


def choose(counts: list[tuple[str, int, int]], bad: int, clean: int, sample: Sample) -> list[str]:
    """The features to learn; counts: feature, toxic and clean documents that have it."""
    odds = {f: np.log((n + 0.5) / (bad + 1)) - np.log((m + 0.5) / (clean + 1)) for f, n, m in counts if n >= sample.least_docs}
    of = {f: n for f, n, _ in counts}
    return sorted((f for f, o in odds.items() if o >= sample.least_odds), key=lambda f: (-odds[f] * np.sqrt(of[f]), f))[: sample.features]


def hits_of(text: str, place: dict) -> list[list[int]]:
    """The chosen features of each sentence that has any."""
    found = ({place[f] for w in words for f in word_features(w) if f in place} for words in bag_of(text))
    return [sorted(x) for x in found if x]


def fit_weights(bags: list[list[list[int]]], toxic: list[int], chosen: list[str], sample: Sample) -> Model:
    """bags: for each document, the features of its sentences (those without any have chance 0)."""
    y = np.array(toxic, dtype=float)
    doc_of = np.array([d for d, bag in enumerate(bags) for _ in bag], dtype=np.int64)
    lines = [x for bag in bags for x in bag]
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines]).astype(np.int64)
    col = np.array([f for x in lines for f in x], dtype=np.int64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w, velocity, b = np.full(len(chosen), 0.5), np.zeros(len(chosen)), sample.bias
    for _ in range(sample.steps):
        z = np.clip(b + np.bincount(row, w[col], minlength=len(lines)), None, 30)
        hazard = np.bincount(doc_of, np.logaddexp(0, z) - np.logaddexp(0, b), minlength=len(y))
        score = np.maximum(-np.expm1(-hazard), 1e-3)
        # The likelihood is -hazard of a clean document and log(1 - exp(-hazard)) of a toxic one; d hazard / d z is the sigmoid.
        g = (share * np.where(y > 0, np.exp(-hazard) / score, -1.0))[doc_of] / (1 + np.exp(-z))
        velocity = 0.9 * velocity + np.bincount(col, g[row], minlength=len(chosen)) - 1e-5 * w
        w = np.maximum(0, w + 8 * velocity)  # evidence only: words of clean sentences add nothing
    return Model({f: float(x) for f, x in zip(chosen, w) if x > 0}, b)


def fit(texts: list[str], toxic: list[int], sample: Sample = Sample()) -> Model | None:
    """The model of texts at hand; train() takes the same steps on the executors."""
    if not len(toxic) or min(toxic) == max(toxic):
        return None
    seen = (Counter(), Counter())
    for t, label in zip(texts, toxic):
        seen[label].update({f for words in bag_of(t) for w in words for f in word_features(w)})
    chosen = choose([(f, n, seen[0][f]) for f, n in seen[1].items()], sum(toxic), len(toxic) - sum(toxic), sample)
    place = {f: i for i, f in enumerate(chosen)}
    return fit_weights([hits_of(t, place) for t in texts], toxic, chosen, sample)


def sentence_hazards(text: str, model: Model, cache: dict) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The sentences, and -log(1 - p) of each."""
    spans = sentences(text)
    z = np.zeros(len(spans))
    for k, (a, b) in enumerate(spans):
        hits = set()
        for w in set(WORD.findall(text[a:b].lower())):
            found = cache.get(w)
            if found is None:
                found = tuple(f for f in word_features(w) if f in model.weights)
                if len(cache) < 500_000:
                    cache[w] = found
            hits.update(found)
        z[k] = sum(model.weights[f] for f in sorted(hits))
    return spans, np.logaddexp(0, np.minimum(model.bias + z, 30)) - np.logaddexp(0, model.bias)


def score_one(text: str | None, model: Model | None, cache: dict, suspect: float = 0.5) -> tuple[float, list[dict]]:
    """The document's score, and the sentences whose own chance is `suspect` or more."""
    if model is None or not text:
        return 0.0, []
    spans, hazard = sentence_hazards(text, model, cache)
    if not spans:
        return 0.0, []
    p = -np.expm1(-hazard)
    worst = [{"start": spans[k][0], "end": spans[k][1], "chance": float(p[k])} for k in np.flatnonzero(p >= suspect)]
    return float(-np.expm1(-hazard.sum())), worst


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model | None:
    """docs: the rows that may be learned from. The labels' sample is taken first, so only its texts are fetched."""
    session_of(docs)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample.rows).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample.rows))
    # The picked labels number 2 * sample.rows at most: their size is bounded, so they may be broadcast.
    # An id may repeat in any number of rows; one text of it is enough.
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    scratch = Scratch(docs.sparkSession)
    texts = scratch.write(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    numbers = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(numbers) < 2:
        return None

    def features(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[label].update({f for words in bag_of(t) for w in words for f in word_features(w)})
            every = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([seen[k][f] for f in every], pa.int64()) for k in (1, 0))], names=["feature", "bad", "clean"])

    def hits(batches):
        place = shared.value
        for b in batches:
            found = [hits_of(t, place) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "hits"])

    counts = texts.select("text", "toxic").mapInArrow(features, "feature string, bad long, clean long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    counts = counts.filter(F.col("bad") >= sample.least_docs).toArrow().sort_by("feature")
    chosen = choose(list(zip(*(counts[c].to_pylist() for c in ("feature", "bad", "clean")))), numbers[1], numbers[0], sample)
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})
    got = texts.select("doc_id", "text", "toxic").mapInArrow(hits, f"doc_id {id_type(docs)}, toxic int, hits array<array<int>>").toArrow().sort_by("doc_id")
    scratch.drop("labelled")
    return fit_weights(got["hits"].to_pylist(), got["toxic"].to_pylist(), chosen, sample)


def with_score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns those in keep) with score and offending: the sentences (start, end, chance) that make a
    document toxic."""

    def run(texts):
        out = [score_one(t, model, cache) for t in texts.to_pylist()]
        return [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])))]

    cache: dict = {}
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("chance", T.DoubleType())]))
    return add_columns(docs, run, ["text"], [("score", T.DoubleType()), ("offending", span)], keep)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every row of docs; learned from rows that aren't held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))), sample)
    scored = with_score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
