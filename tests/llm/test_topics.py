"""Topics are fitted to all documents, however many are looked at to begin with."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from shelfwise.llm import mixing
from shelfwise.llm.common import Scratch


def rows(n: int = 300):
    rnd = random.Random(8)
    out = []
    for i in range(n):
        lang, subject = ("a", "b", None)[i % 3], i % 2
        out.append((i, " ".join([f"{lang}{rnd.randrange(30)}" for _ in range(20)] + [f"{lang}s{subject}w{rnd.randrange(15)}" for _ in range(15)]), lang))
    return [*out, (n, "", "a"), (n + 1, None, "a"), (n + 2, "alone", "c")]


def test_counts_means_and_centres_are_those_of_all_documents(spark):
    topics = mixing.Topics(groups=3, words=512, sample=20, rounds=1)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = mixing.fit_topics(docs, mixing.Mix(topics=topics), Scratch(spark))
    texts = [(lang, mixing.buckets_of(t.encode().split(), topics)) for _, t, lang in rows() if t]
    x = np.zeros((len(texts), topics.words))
    for k, (_, b) in enumerate(texts):
        x[k, b] = 1
    rarity = np.log((1 + len(texts)) / (1 + x.sum(0)))
    assert np.allclose(model.rarity, rarity)
    x *= rarity
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for lang in ("a", "b", None):
        assert np.allclose(model.means[lang], x[[k for k, t in enumerate(texts) if t[0] == lang]].mean(0), atol=1e-5)
    # One more round by a plain loop from the centres found.
    want = np.zeros_like(model.centres)
    for lang, b in texts:
        if lang != "c":
            want[int(model.topic(lang, b)[6:])] += model.vector(lang, b)
    got = mixing._moved(Scratch(spark).write(spark.createDataFrame(texts, "lang string, buckets array<int>"), "x"), model)
    want /= np.maximum(np.sqrt((want * want).sum(1, keepdims=True)), 1e-9)
    assert np.allclose(got, want, atol=1e-4)


def test_the_model_does_not_depend_on_how_rows_lie(spark):
    mix = mixing.Mix(topics=mixing.Topics(groups=4, words=512, sample=50, langs=2))
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    one, other = (mixing.fit_topics(d, mix, Scratch(spark)) for d in (docs.coalesce(1), docs.repartition(9)))
    assert np.array_equal(one.centres, other.centres) and set(one.means) == set(other.means) and mixing.OTHER_LANGS in one.means


def test_first_centres_are_found_without_a_vector_for_each_text():
    rnd = random.Random(4)
    langs = [rnd.choice(["a", "b", None]) for _ in range(3000)]
    lists = [sorted(rnd.sample(range(4096), 20)) for _ in langs]
    means = {lang: np.array([rnd.random() for _ in range(4096)]) / 4096 for lang in ("a", "b", None)}
    model = mixing.TopicModel(np.array([1 + rnd.random() for _ in range(4096)]), means, np.zeros((1, 4096)))
    array = pa.array(lists, pa.list_(pa.int32()))  # loads pandas, which isn't to be counted
    tracemalloc.start()
    got = mixing._first_centres(langs, array, model, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # vectors of all texts would be 98 MB
    x = np.array([model.vector(lang, b) for lang, b in zip(langs, lists)])
    chosen = [0]
    while len(chosen) < 5:
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    assert np.allclose(got, x[chosen])
