"""Mixing sources to target weights by iterative proportional fitting.

The tokens (words) of each cell (source, language, topic) are raked to target shares of the three marginals: in turn, the
cells of each source, language and topic are scaled to its target, until the marginals stand still. A cell can't give
more than it has, so cells that reach all their tokens are held there while the others make up the marginal. A document
is then kept with its cell's probability, by a hash of its id and text: the same rows are kept in every run.

Documents without a topic column get one of `Topics.groups` topics: the nearest centre of spherical k-means over hashed
words (distinct words of a text, weighted by rarity), less the mean of the text's language, so that topics are what texts
of one language differ in. Rarity, means and centres are those of all documents: each round of k-means is a pass over
the buckets of all texts that adds up a vector a centre. Only the documents where the centres begin come from the `Topics.sample`
of smallest hash. Every document is given a topic, from its whole text. The sums are of whole numbers (steps of 2^-20), so they are
the same however the rows lie.

Texts are read once: what the cells and draws need is written beside the rows. Only sums by cell are shuffled, summed
map-side first, so a source with a third of all rows is no hot spot. Up to Mix.most_cells cells are raked on the driver
and broadcast; more are raked by the same steps as aggregates and joins.

Rows: null source, language or topic is a category of its own (None among the targets), told apart from any text; null
texts have no tokens, those without words no topic, and cells that have nothing to weigh keep all their rows. Repeated
rows are kept or not together. An empty table gives an empty one. Columns that the frame has besides stay as they are,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns, bytes_of, session_of

MARGINS = ("source", "lang", "topic")
#: Among targets: the weight that all categories not named share, by their tokens to the power Mix.smoothing.
OTHERS = ...


@dataclass(frozen=True)
class Topics:
    """words: hash buckets of words; sample: the bound on the documents of which some are the first centres; rounds: passes
    over all documents at most; langs: so many languages, those of most documents, have a mean of their own, the others
    share one."""

    groups: int = 8
    words: int = 4096
    sample: int = 4000
    rounds: int = 12
    langs: int = 256


@dataclass(frozen=True)
class Mix:
    """rate: share of all tokens to keep. targets: for a margin, weights of its categories (0 where none is given, unless
    OTHERS has one); where a margin has no targets, a category weighs its tokens to the power `smoothing`, which raises
    small ones. steps and settled bound the raking."""

    rate: float = 0.5
    smoothing: float = 0.5
    targets: dict = field(default_factory=dict)
    steps: int = 200
    settled: float = 1e-9
    seed: int = 9
    most_cells: int = 200_000
    topics: Topics = Topics()


#: Sums are of whole multiples of 1 / STEPS.
STEPS = float(1 << 20)
#: The name of the languages that share a mean: no language is called so.
OTHER_LANGS = "\x00others"


class TopicModel:
    """Centres over hashed words, and for each language what its mean scores under each centre."""

    def __init__(self, rarity: np.ndarray, means: dict[str | None, np.ndarray], centres: np.ndarray):
        self.rarity, self.means = rarity, means
        self.place(centres)

    def place(self, centres: np.ndarray) -> None:
        self.centres = centres / np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-9)
        self.weights = np.ascontiguousarray(self.centres.T * self.rarity[:, None])
        self.offsets = {lang: mean @ self.centres.T for lang, mean in self.means.items()}

    def named(self, lang: str | None) -> str | None:
        return lang if lang in self.means else OTHER_LANGS

    def topic(self, lang: str | None, buckets: list[int]) -> str | None:
        if not buckets:
            return None
        length = np.sqrt(np.square(self.rarity[buckets]).sum())
        score = self.weights[buckets].sum(0) / max(float(length), 1e-9) - self.offsets.get(self.named(lang), 0.0)
        return f"topic-{int(np.argmax(score))}"

    def vector(self, lang: str | None, buckets: list[int]) -> np.ndarray:
        """A document as centres see it: its words by rarity, less its language's mean, of length one."""
        x = np.zeros(len(self.rarity))
        x[buckets] = self.rarity[buckets]
        x = x / max(np.sqrt((x * x).sum()), 1e-9) - self.means.get(self.named(lang), 0.0)
        return x / max(np.sqrt((x * x).sum()), 1e-9)


def buckets_of(words: list[bytes], topics: Topics) -> list[int]:
    return sorted({zlib.crc32(w) % topics.words for w in set(words)})


def _lists(column: pa.Array, most: int = 2000):
    """Slices of at most so many lists: where they begin and end, their values, their lengths, where each starts."""
    for at in range(0, len(column), most):
        part = column.slice(at, most)
        sizes = np.diff(part.offsets.to_numpy())
        yield at, at + len(part), part.flatten().to_numpy(), sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _sums(features: DataFrame, add: Callable, width: int) -> dict:
    """By key, a vector of so many numbers added up over all features: each task adds up its own, then tasks' sums meet by key.
    add(totals, langs, lists): totals are vectors by key, zero at first."""

    def run(batches):
        totals: dict = defaultdict(lambda: np.zeros(width))
        for b in batches:
            add(totals, b.column(0).to_pylist(), b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["k", "v"])

    def merge(t: pa.Table) -> pa.Table:
        whole = np.zeros(width)
        for v in t.column("v"):
            whole += np.frombuffer(v.as_py())
        return pa.table({"k": t.column("k").slice(0, 1), "v": pa.array([whole.tobytes()], pa.binary())})

    parts = features.select("lang", "buckets").mapInArrow(run, "k string, v binary")
    return {r["k"]: np.frombuffer(r["v"]) for r in parts.groupBy("k").applyInArrow(merge, "k string, v binary").collect()}


def fit_topics(docs: DataFrame, mix: Mix, scratch: Scratch) -> TopicModel | None:
    """docs: doc_id, text, lang. None if no text has a word."""
    topics, n_words = mix.topics, mix.topics.words
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed + 1), "doc_id", "text"), 1)

    def run(texts):
        return [pa.array([buckets_of((t or b"").split(), topics) for t in bytes_of(texts)], pa.list_(pa.int32()))]

    rows = docs.filter(F.col("text").isNotNull()).select("lang", mark.alias("mark"), "text")
    features = scratch.write(add_columns(rows, run, ["text"], [("buckets", T.ArrayType(T.IntegerType()))], keep=["lang", "mark"]).filter(F.size("buckets") > 0), "features")
    some = features.orderBy("mark", "lang", "buckets").limit(topics.sample).select("lang", "buckets").toArrow()
    if not some.num_rows:
        return None

    def count(totals, langs, lists):
        for start, end, flat, sizes, _ in _lists(lists):
            totals["words"][:n_words] += np.bincount(flat, minlength=n_words)
            totals["words"][n_words] += end - start

    counts = _sums(features, count, n_words + 1)["words"]
    rarity = np.log((1 + counts[n_words]) / (1 + counts[:n_words]))
    most = [r["lang"] for r in features.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(topics.langs).collect()]

    def lengths(flat, starts):
        return np.maximum(np.sqrt(np.add.reduceat(np.square(rarity)[flat], starts)), 1e-9)

    def by_lang(totals, langs, lists):
        for start, end, flat, sizes, starts in _lists(lists):
            x = np.rint(rarity[flat] / np.repeat(lengths(flat, starts), sizes) * STEPS)
            names = np.array([most.index(v) if v in most else len(most) for v in langs[start:end]])
            for k in np.unique(names):
                total, mine = totals[most[k] if k < len(most) else OTHER_LANGS], names == k
                chosen = np.repeat(mine, sizes)
                total[:n_words] += np.bincount(flat[chosen], x[chosen], n_words)
                total[n_words] += mine.sum()

    means = {lang: v[:n_words] / STEPS / v[n_words] for lang, v in _sums(features, by_lang, n_words + 1).items()}
    model = TopicModel(rarity, means, np.zeros((1, n_words)))
    model.place(_first_centres(some.column("lang").to_pylist(), some.column("buckets").combine_chunks(), model, topics.groups))
    for _ in range(topics.rounds):
        centres = _moved(features, model)
        still = np.abs(centres - model.centres).max() < 1e-9
        model.place(centres)
        if still:
            break
    return model


class _Languages:
    """A model's means as rows of one array, and what they say of texts."""

    def __init__(self, model: TopicModel):
        self.model, names = model, list(model.means)
        self.places, self.means = {n: k for k, n in enumerate(names)}, np.array([model.means[n] for n in names])
        self.square = np.square(self.means).sum(1)

    def of(self, langs: list) -> np.ndarray:
        return np.array([self.places[self.model.named(v)] for v in langs])

    def measures(self, lang: np.ndarray, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """length, scale of each text: its vector is (rarity / length of its words, less its language's mean) * scale."""
        rarity = self.model.rarity[flat]
        length = np.maximum(np.sqrt(np.add.reduceat(np.square(rarity), starts)), 1e-9)
        along = np.add.reduceat(rarity * self.means[np.repeat(lang, sizes), flat], starts) / length
        scale = 1 / np.maximum(np.sqrt(np.maximum(1 - 2 * along + self.square[lang], 0)), 1e-9)
        scale[scale > 1e8] = 0.0  # a text that is its language's mean has no direction
        return length, scale


def _first_centres(langs: list, lists: pa.Array, model: TopicModel, groups: int) -> np.ndarray:
    """The vectors of the first text and of those, one by one, that are least like any so far. Texts stay lists of their words:
    the vectors of all would take up the driver's memory."""
    known = _Languages(model)
    parts = []
    for start, end, flat, sizes, starts in _lists(lists):
        lang = known.of(langs[start:end])
        parts.append((lang, flat, starts, *known.measures(lang, flat, sizes, starts)))
    chosen, nearest = [model.vector(langs[0], lists[0].as_py())], np.full(len(langs), -np.inf)
    while len(chosen) < min(groups, len(langs)):
        along, offsets = model.rarity * chosen[-1], known.means @ chosen[-1]
        like = [(np.add.reduceat(along[flat], starts) / length - offsets[lang]) * scale for lang, flat, starts, length, scale in parts]
        nearest = np.maximum(nearest, np.concatenate(like))
        k = int(nearest.argmin())
        chosen.append(model.vector(langs[k], lists[k].as_py()))
    return np.array(chosen)


def _moved(features: DataFrame, model: TopicModel) -> np.ndarray:
    """The mean direction of the documents nearest to each centre; a centre without any stays."""
    known = _Languages(model)
    shared = features.sparkSession.sparkContext.broadcast(known)
    n_words, groups, n_langs = len(model.rarity), len(model.centres), len(known.means)

    def add(totals, langs, lists):
        seen, m = shared.value, shared.value.model
        offsets = np.array([m.offsets[n] for n in seen.places])
        for start, end, flat, sizes, starts in _lists(lists):
            lang = seen.of(langs[start:end])
            length, scale = seen.measures(lang, flat, sizes, starts)
            scores = np.stack([np.add.reduceat(m.weights[:, k][flat], starts) for k in range(groups)], 1) / length[:, None] - offsets[lang]
            owner = scores.argmax(1)
            x = np.rint(m.rarity[flat] * np.repeat(scale / length, sizes) * STEPS)
            for k in np.unique(owner):
                mine = owner == k
                chosen = np.repeat(mine, sizes)
                total = totals[str(k)]
                total[:n_words] += np.bincount(flat[chosen], x[chosen], n_words)
                total[n_words:] += np.bincount(lang[mine], np.rint(scale[mine] * STEPS), n_langs)

    sums = _sums(features, add, n_words + n_langs)
    centres = model.centres.copy()
    for k, v in sums.items():
        direction = v[:n_words] - v[n_words:] @ known.means
        length = np.sqrt((direction * direction).sum())
        if length > 1e-9:
            centres[int(k)] = direction / length
    shared.unpersist()
    return centres


def prefix_for(docs: DataFrame) -> str:
    """The beginning of names that no column of docs has."""
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def measured(docs: DataFrame, mix: Mix, prefix: str, keep: list[str], scratch: Scratch) -> DataFrame:
    """The columns `keep` of docs with source, lang, topic, tokens and draw, their names after the prefix."""
    spark = session_of(docs)
    has_topic = "topic" in docs.columns
    model = None if has_topic else fit_topics(docs.select("doc_id", "text", "lang"), mix, scratch)
    shared = spark.sparkContext.broadcast(model)

    def run(texts, langs):
        topic, tokens = [], []
        for t, lang in zip(bytes_of(texts), langs.to_pylist()):
            words = (t or b"").split()
            tokens.append(len(words))
            topic.append(shared.value.topic(lang, buckets_of(words, mix.topics)) if shared.value else None)
        return [pa.array(topic, pa.string()), pa.array(tokens, pa.int64())]

    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    own = {f"{prefix}source": F.col("source"), f"{prefix}lang": F.col("lang"), f"{prefix}draw": drawn} | ({f"{prefix}given": F.col("topic").cast("string")} if has_topic else {})
    rows = docs.withColumns(own).select(*dict.fromkeys([*keep, "text", "lang", *own]))
    out = add_columns(rows, run, ["text", "lang"], [(f"{prefix}topic", T.StringType()), (f"{prefix}tokens", T.LongType())], keep=[*keep, *own])
    return out.withColumn(f"{prefix}topic", F.col(f"{prefix}given")).drop(f"{prefix}given") if has_topic else out


def target_shares(categories: list, tokens: np.ndarray, margin: str, mix: Mix) -> np.ndarray:
    given, own = mix.targets.get(margin), np.power(tokens, mix.smoothing)
    if given is None:
        w = own
    else:
        named = np.array([c in given for c in categories])
        w = np.array([float(given.get(c, 0.0)) for c in categories])
        rest = own[~named].sum()
        w[~named] = own[~named] / rest * given.get(OTHERS, 0.0) if rest else 0.0
    return w / w.sum() if w.sum() > 0 else w


def rake(cells: list[tuple], tokens: np.ndarray, mix: Mix) -> np.ndarray:
    """The probability of each cell; cells: its category in each margin."""
    total = tokens.sum()
    if not total:
        return np.ones(len(cells))
    budget, margins = mix.rate * total, []
    for k, name in enumerate(MARGINS):
        place: dict = {}
        index = np.array([place.setdefault(c[k], len(place)) for c in cells])
        margins.append((index, budget * target_shares(list(place), np.bincount(index, tokens, len(place)), name, mix)))
    w = mix.rate * tokens.astype(float)
    for _ in range(mix.steps):
        was = w.copy()
        for index, goal in margins:
            full = w >= tokens
            held = np.bincount(index, np.where(full, tokens, 0.0), len(goal))
            free = np.bincount(index, np.where(full, 0.0, w), len(goal))
            scale = np.divide(np.maximum(goal - held, 0), free, out=np.ones_like(goal), where=free > 0)
            # A margin that its full cells alone exceed scales all of them down again.
            over = held > goal
            scale_full = np.divide(goal, held, out=np.ones_like(goal), where=over)
            w = np.minimum(tokens, np.where(full, w * scale_full[index], w * np.where(over, scale_full, scale)[index]))
        if np.abs(w - was).max() <= mix.settled * total:
            break
    return np.divide(w, tokens, out=np.ones(len(cells)), where=tokens > 0)


def rake_distributed(cells: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """rake() for more cells than a driver should hold: the same steps, margin by margin, as aggregates and joins."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("p", F.lit(1.0))
    budget, goals = mix.rate * total, {}
    for name in MARGINS:
        key = f"__{name}"
        sums = cells.groupBy(key).agg(F.pow(F.sum("tokens"), F.lit(mix.smoothing)).alias("own"))
        given = mix.targets.get(name)
        if given is None:
            weights = sums.withColumn("w", F.col("own"))
        else:
            listed = [(k, float(v)) for k, v in given.items() if k is not OTHERS]
            known = cells.sparkSession.createDataFrame(listed, "__category string, listed double")
            found = sums.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("__category")), "left").drop("__category")  # as many as the caller named
            rest = found.filter("listed IS NULL").agg(F.sum("own")).first()[0] or 1.0
            weights = found.withColumn("w", F.coalesce("listed", F.col("own") / rest * float(given.get(OTHERS, 0.0))))
        whole = weights.agg(F.sum("w")).first()[0] or 1.0
        goals[name] = scratch.write(weights.select(key, (F.col("w") / whole * budget).alias("goal")), f"goal-{name}")
    state = scratch.write(cells.withColumn("w", mix.rate * F.col("tokens")), "rake0")
    for step in range(mix.steps):
        nxt = state.withColumn("was", F.col("w"))
        for name in MARGINS:
            full = F.col("w") >= F.col("tokens")
            sums = nxt.groupBy(f"__{name}").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("free"))
            goal = goals[name].withColumnRenamed(f"__{name}", "__category")
            scales = sums.join(goal, F.col(f"__{name}").eqNullSafe(F.col("__category"))).select(
                "__category",
                F.when(F.col("held") > F.col("goal"), F.col("goal") / F.col("held")).otherwise(1.0).alias("of_full"),
                F.when(F.col("held") > F.col("goal"), F.col("goal") / F.col("held")).when(F.col("free") > 0, (F.col("goal") - F.col("held")) / F.col("free")).otherwise(1.0).alias("of_free"),
            )
            nxt = nxt.join(scales, F.col(f"__{name}").eqNullSafe(F.col("__category"))).withColumn("w", F.least(F.col("tokens").cast("double"), F.col("w") * F.when(full, F.col("of_full")).otherwise(F.col("of_free")))).drop("of_full", "of_free", "__category")
        state = scratch.write(nxt, f"rake{step + 1}")
        scratch.drop(f"rake{step}")
        moved = state.agg(F.max(F.abs(F.col("w") - F.col("was")))).first()[0]
        state = state.drop("was")
        if moved <= mix.settled * total:
            break
    return state.withColumn("p", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0))


def with_probability(rows: DataFrame, mix: Mix, scratch: Scratch, prefix: str) -> DataFrame:
    """rows: measured(), written. Adds p, after the prefix: the probability of the row's cell."""
    named = [F.col(f"{prefix}{m}").alias(f"__{m}") for m in MARGINS]
    keys = [f"__{m}" for m in MARGINS]
    cells = scratch.write(rows.groupBy(*named).agg(F.sum(f"{prefix}tokens").alias("tokens")), "cells")
    if cells.count() <= mix.most_cells:
        got = sorted(cells.collect(), key=lambda r: [(r[k] is not None, r[k] or "") for k in keys])
        p = rake([tuple(r[k] for k in keys) for r in got], np.array([r["tokens"] for r in got], dtype=float), mix)
        chances = F.broadcast(rows.sparkSession.createDataFrame([(*(r[k] for k in keys), float(x)) for r, x in zip(got, p)], f"__source string, __lang string, __topic string, {prefix}p double"))
    else:
        chances = scratch.write(rake_distributed(cells, mix, scratch).select(*keys, F.col("p").alias(f"{prefix}p")), "chances")
    same = [F.col(f"{prefix}{m}").eqNullSafe(chances[f"__{m}"]) for m in MARGINS]
    return rows.join(chances, same[0] & same[1] & same[2]).drop(*(chances[k] for k in keys))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of every row."""
    scratch, x = Scratch(session_of(docs)), "__mix_"
    own = docs.select("doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else []))
    rows = scratch.write(measured(own, mix, x, ["doc_id"], scratch), "measured")
    out = with_probability(rows, mix, scratch, x)
    return out.select("doc_id", *(F.col(f"{x}{m}").alias(m) for m in MARGINS), F.col(f"{x}tokens").alias("n_tokens"), F.col(f"{x}p").alias("probability"), (F.col(f"{x}draw") < F.col(f"{x}p")).alias("kept"))


def sample_mix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that the mix keeps."""
    scratch, x = Scratch(session_of(docs)), prefix_for(docs)
    rows = scratch.write(measured(docs, mix, x, docs.columns, scratch), "measured")
    return with_probability(rows, mix, scratch, x).filter(F.col(f"{x}draw") < F.col(f"{x}p")).select(*docs.columns)
