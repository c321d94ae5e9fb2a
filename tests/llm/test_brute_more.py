"""Languages against plain loops over bytes and machines; token totals on odd rows."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import language, rollup


def loop_features(text):
    """Every run of one to four bytes, hashed byte by byte."""
    data, counts = f" {text.lower()} ".encode(), np.zeros(language.BUCKETS)
    for i in range(len(data)):
        h = 0
        for k in range(4):
            if i + k < len(data):
                h = data[i] if k == 0 else (h * 16777619 & 0xFFFFFFFF) ^ data[i + k]
                counts[(h * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    return np.sqrt(counts / counts.sum())


@pytest.mark.parametrize("text", ["", "a", "Straße", "x" * 50, "one two\nthree 漢字 é"])
def test_features_equal_loops(text):
    assert np.allclose(language.features(text), loop_features(text), atol=1e-12)


def descended(x, y, ridge, steps=6000, rate=0.2):
    """The squared hinge by plain gradient steps in double precision, one class as heavy as the other."""
    c = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        g = -2 * c * y * np.maximum(0, 1 - y * (x @ w + b))
        w, b = w - rate * (x.T @ g + ridge * w), b - rate * g.sum()
    return w, b


def test_predictions_equal_dense_machines(spark):
    """Families first, then languages within: votes of machines fitted and asked in plain loops."""
    rnd = random.Random(5)
    words = {"en": "the and with from house river", "de": "der und mit aus haus fluss", "nl": "de en met uit huis rivier", "fr": "le et avec de maison fleuve", "es": "el y con de casa rio"}
    rows = [(i, " ".join(rnd.choice(words[v].split()) for _ in range(rnd.randint(3, 12))), v) for i, v in enumerate(rnd.choice(list(words)) for _ in range(120))]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ridge = language.Sample().ridge
    x = np.array([loop_features(t) for _, t, _ in rows])
    langs = np.array([v for *_, v in rows])
    family = np.array([language.family_of(v) for v in langs])

    def duels(names, of, on):
        return {(a, b): descended(x[on & ((of == a) | (of == b))], np.where(of[on & ((of == a) | (of == b))] == a, 1.0, -1.0), ridge) for a, b in combinations(names, 2)}

    def winner(names, machines, f):
        if len(names) == 1:
            return names[0]
        wins = dict.fromkeys(names, 0.0)
        for (a, b), (w, bias) in machines.items():
            p = 1 / (1 + np.exp(-4 * np.clip(f @ w + bias, -8, 8)))
            wins[a] += (p >= 0.5) + 1e-3 * p
            wins[b] += (p < 0.5) + 1e-3 * (1 - p)
        return max(names, key=wins.get)

    families = sorted(set(family))
    between = duels(families, family, np.ones(len(rows), bool))
    within = {f: duels(sorted(set(langs[family == f])), langs, family == f) for f in families}
    asked = [t for _, t, _ in rows] + ["the house mit fluss", "casa", "met de rivier", "zzz"]
    for t in asked:
        f = loop_features(t)
        home = winner(families, between, f)
        assert language.predict_one(t, model)[0] == winner(sorted(set(langs[family == home])), within[home], f), t


def test_token_totals_of_odd_rows(spark):
    files = {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json")}
    long = "some words " * 60_000
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "s", "en"), (2, " \n ", "s", "en"), (3, long, "s", None), (4, "same text", "s", "en"), (4, "same text", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(1) for c in ("n", "t", "estimate", "short", "tokens", "kind", "byte_bpe_50k")})
    slow, want = Tokenizer.from_file(files["byte_bpe_50k"]), {}
    for _, t, s, v in rows:
        d, n = want.get((s, v), (0, 0))
        want[s, v] = (d + 1, n + len(slow.encode(t or "", add_special_tokens=False).ids))
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.tokenizer_totals(df, files).collect()} == want
    assert rollup.tokenizer_totals(df.limit(0), files).count() == 0
