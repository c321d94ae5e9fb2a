"""Language identification in two steps: the language family first, then one-versus-one linear support vector
machines among the languages of that family.

A text is the relative frequencies of its hashed byte 1- to 4-grams (bytes of the lower-cased text, whole text). Families
are told apart by one-versus-one machines as well; a step's choice is by votes, ties by the sum of margins. The
machines are trained on a bounded sample of labelled rows (Sample.rows per language at most, by smallest hash of
doc_id, of the Sample.languages languages with most rows; rows without id teach nothing), by squared-hinge loss and Nesterov steps.

Rows: `und` with score 0 where the text is null or has no letter, and everywhere if nothing was learned (no labelled
row). A language that FAMILIES doesn't name is a family of its own. Repeated rows are predicted one by one. With one
learned language, that is predicted with score 1. An empty table gives an empty one. Columns besides doc_id, text and
(for learning) lang are not read, and stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fold, session_of

#: Languages by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl", "be", "mk"),
    "uralic": ("fi", "hu", "et"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ur", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
    "sinitic": ("zh", "yue"),
}
BUCKETS = 4096
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Sample:
    """The bound on what the machines are fitted to; everything else covers all rows."""

    rows: int = 600
    languages: int = 64
    steps: int = 200
    ridge: float = 1e-4


@dataclass(frozen=True)
class Machines:
    """families: name and languages of each; weights: one column for each pair of families, then of languages within
    a family; pairs: for each of those columns, (group, i, j), group -1 being the choice of the family."""

    families: tuple
    weights: np.ndarray
    bias: np.ndarray
    pairs: tuple


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(text: str) -> np.ndarray:
    """Square roots of the n-gram frequencies (their length is 1)."""
    b = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)
    total = np.zeros(BUCKETS)
    for at in range(0, len(b), 1 << 20):  # long texts: block by block, with the three bytes that a gram can reach over
        x = b[at : at + (1 << 20) + 3].astype(np.uint32)
        n = min(len(x), 1 << 20)
        h = x
        for k in range(4):
            total += np.bincount((h[:n] * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
            if len(x) < k + 2:
                break
            h = h[:-1] * np.uint32(16777619) ^ x[k + 1 :]
            n = min(n, len(h))
    return np.sqrt(total / total.sum())


def _sparse(texts: pa.Array) -> list[pa.Array]:
    """Places and values of each text's features that aren't zero."""
    found = [features(t) for t in texts.to_pylist()]
    at = [np.flatnonzero(f) for f in found]
    return [pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([f[i].astype("<f4").tobytes() for f, i in zip(found, at)], pa.binary())]


def _svm(x: np.ndarray, y: np.ndarray, sample: Sample) -> tuple[np.ndarray, float]:
    """Squared hinge, classes weighted alike; x: rows by features, y: -1 or 1."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    vw, vb = w, b
    rate, ridge = np.float32(0.25), np.float32(sample.ridge)
    for t in range(sample.steps):
        g = -2 * c * y * np.maximum(0, 1 - y * (x @ vw + vb))
        nw, nb = vw - rate * (x.T @ g + ridge * vw), vb - rate * g.sum()
        k = np.float32(t / (t + 3))
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w.astype(float), float(b)


def train(labelled: DataFrame, sample: Sample = Sample()) -> Machines | None:
    """labelled: doc_id, text, lang, whatever their fold. None if there is no row to learn from."""
    session_of(labelled)
    rows = labelled.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    named = rows.select("doc_id", "lang").distinct()  # no text is read until the sample is known
    order = F.xxhash64("doc_id")
    most = [r["lang"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample.languages).collect()]
    if not most:
        return None
    # sample.rows keys of sample.languages at most: their size is bounded, so they may be broadcast and only their texts come.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    keys = named.filter(F.col("lang").isin(most)).withColumn("place", place).filter(F.col("place") <= sample.rows).select("doc_id", "lang")
    found = rows.filter(F.col("text").rlike(r"\p{L}")).join(F.broadcast(keys), ["doc_id", "lang"], "left_semi")
    # A key may repeat in any number of rows; one text of it is enough. Texts become features where they are.
    one = found.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    fields = [("at", T.BinaryType()), ("value", T.BinaryType())]
    got = add_columns(one, _sparse, ["text"], fields, keep=["doc_id", "lang"]).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    lang = np.array(got["lang"].to_pylist(), dtype=object)
    langs = sorted(set(lang.tolist()))
    if not langs:
        return None
    x = np.zeros((len(lang), BUCKETS), dtype=np.float32)
    for i, (at, value) in enumerate(zip(got["at"], got["value"])):
        x[i, np.frombuffer(at.as_py(), dtype="<u2")] = np.frombuffer(value.as_py(), dtype="<f4")
    names = sorted({family_of(v) for v in langs})
    families = tuple((f, tuple(v for v in langs if family_of(v) == f)) for f in names)
    family = np.array([names.index(family_of(v)) for v in lang])
    groups = [(-1, [family == i for i in range(len(families))])] + [(g, [lang == v for v in members]) for g, (_, members) in enumerate(families)]
    pairs, weights, bias = [], [], []
    for g, masks in groups:
        for i, j in combinations(range(len(masks)), 2):
            on = masks[i] | masks[j]
            w, b = _svm(x if on.all() else x[on], np.where(masks[i][on], 1, -1).astype(np.float32), sample)
            pairs.append((g, i, j))
            weights.append(w)
            bias.append(b)
    return Machines(families, np.array(weights).reshape(len(pairs), BUCKETS).T, np.array(bias), tuple(pairs))


def _choose(margins: np.ndarray, model: Machines, group: int, n: int) -> tuple[int, float]:
    """The choice with most votes, and its chance by its least decided duel."""
    votes, least = np.zeros(n), np.ones(n)
    for k, (g, i, j) in enumerate(model.pairs):
        if g == group:
            p = 1 / (1 + np.exp(-4 * np.clip(margins[k], -8, 8)))
            votes[i] += (p >= 0.5) + 1e-3 * p
            votes[j] += (p < 0.5) + 1e-3 * (1 - p)
            least[i], least[j] = min(least[i], p), min(least[j], 1 - p)
    best = int(votes.argmax())
    return best, float(least[best])


def predict_one(text: str | None, model: Machines | None) -> tuple[str, float]:
    if model is None or text is None or not LETTER.search(text):
        return "und", 0.0
    margins = features(text) @ model.weights + model.bias
    f, p = _choose(margins, model, -1, len(model.families))
    members = model.families[f][1]
    k, q = _choose(margins, model, f, len(members))
    return members[k], p * q


def with_language(docs: DataFrame, model: Machines | None, prediction: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns those in keep) with two more columns. Only text is looked at."""

    def run(texts):
        out = [predict_one(t, model) for t in texts.to_pylist()]
        return [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]

    return add_columns(docs, run, ["text"], [(prediction, T.StringType()), (score, T.DoubleType())], keep)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def identify(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), sample)
    return with_language(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05, sample: Sample = Sample()) -> DataFrame:
    """docs without the rows whose language can't be told (`und`) or is told with a score under `least`."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), sample)
    names = ["__lang_pred", "__lang_score"]
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:  # columns of any name stay as they are
        names = [f"_{n}" for n in names]
    pred, score = names
    return with_language(docs, model, pred, score).filter((F.col(pred) != "und") & (F.col(score) >= least)).select(*docs.columns)
