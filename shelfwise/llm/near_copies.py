"""The SimHash operator at a wider radius: near copies by five-word similarity, for the pipeline.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is `LEAST` or more (a text of
fewer than five words is one shingle). Candidates come from two sides and are verified exactly on their texts:

* SimHash fingerprints of the shingles that link at three bits under the Golay keys of simhash.py;
* min-wise keys of the same shingles: `BANDS` keys of `ROWS` minima each, of which a pair at similarity s shares none
  with probability (1 - s**ROWS)**BANDS (0.04 % at 0.8, less above).

The fingerprints alone can't give the stage's result: at a similarity of 0.8 they differ in ten of 64 bits (15 %), where
even 24 bits of keys meet with 2 % only, so some 400 keys a text would be needed, and ever more as keys grow longer
with the corpus. The min-wise keys don't replace them: what the Golay keys link is linked.

Keys that more than `ALL_PAIRS` classes share (a template, a large group of copies) would make the square of their number
of pairs. Each of these classes is compared with one of its key, which joins true groups, and beyond that exactly: of
any two sets of shingles at `LEAST` or more, with all shingles in one order, the first (1 - LEAST) of the larger and the
first ninth of the smaller have a common one, at places that leave enough after it. In the order of their frequency these are
the rare ones, so what a template's texts have in common is no reason to meet; and the parities of two sets differ in no more
bits than the sets in shingles, which rules out nearly all others. Such pairs are looked for where they aren't in one
group yet. So no link is lost to a long run.

Rows: null texts count as empty, texts without words are one class; texts of equal words (case aside) are one class
before any key is made. Of each component the row with the smallest doc_id stays (null last, then the smallest hash of
its text), so a row goes only where another row of its component stays. An empty table gives an empty one. Columns
besides doc_id and text are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns, bytes_of, session_of
from .simhash import components, keep_rows, links, text_mark

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, ALL_PAIRS = 20, 5, 24
#: Words of 64 bits of a text's parities.
PARITY = 8
#: Odd multipliers, one for each minimum.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of the text's shingles; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, ends = [0, *ends], ends[min(SHINGLE, len(words)) - 1 :]
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip(starts, ends)], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def folded(h: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def keys_of(h: np.ndarray) -> np.ndarray:
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, (h[at : at + 2048, None] * FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], dtype=np.uint64)


def _marks(texts) -> list[pa.Array]:
    """Class, number of shingles, fingerprint and keys of each text; texts without words have no key."""
    cls, sizes, fps, keys, ends = [], [], [], [], [0]
    for t in bytes_of(texts):
        h = shingles(t)
        cls.append(xxhash.xxh3_64_intdigest(b" ".join((t or b"").lower().split())))
        sizes.append(len(h))
        fps.append(folded(h))
        if len(h):
            keys.append(keys_of(h))
        ends.append(len(keys) * BANDS)
    flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    return [pa.array(np.array(cls, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))]


def _tokens(texts) -> list[pa.Array]:
    """The shingles of each text, and in 512 bits whether an even or odd number of them has each remainder: the bits in
    which two texts differ are at most the shingles that only one of them has."""
    found = [shingles(t) for t in bytes_of(texts)]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    odd = [np.packbits(np.bincount((h & np.uint64(511)).astype(np.int64), minlength=512) & 1, bitorder="little").view("<i8") for h in found]
    eight = np.arange(len(found) + 1) * PARITY
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.ListArray.from_arrays(pa.array(eight, pa.int32()), pa.array(np.concatenate(odd) if odd else np.zeros(0, np.int64)))]


def _candidates(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) that share a key, classes of long runs). Sizes further apart than LEAST allow no such similarity."""
    keyed = classes.select(F.explode("keys").alias("key"), "cls", "size")
    pick = F.min(F.struct(F.xxhash64("cls", "key").alias("h"), "cls", "size")).alias("one")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), pick).filter("n > 1")
    met = scratch.write(keyed.join(shared, "key"), "met")
    short = met.filter(F.col("n") <= ALL_PAIRS)
    other = short.select("key", F.col("cls").alias("b"), F.col("size").alias("m"))
    fits = lambda x, y: F.least(x, y) >= LEAST * F.greatest(x, y)
    pairs = short.join(other, "key").filter((F.col("cls") < F.col("b")) & fits("size", "m")).select(F.col("cls").alias("a"), "b")
    long = met.filter(F.col("n") > ALL_PAIRS)
    stars = long.filter((F.col("cls") != F.col("one.cls")) & fits("size", "one.size")).select(F.least("cls", "one.cls").alias("a"), F.greatest("cls", "one.cls").alias("b"))
    return pairs.unionByName(stars), scratch.write(long.select("cls").distinct(), "long")


def _prefix_pairs(texts: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """texts: cls, text; groups: node, label. (a, b): all pairs of classes of different groups that can be at LEAST: their
    rarest shingles meet. Of a shingle whose classes are mostly of one group only pairs with another group are made."""
    of_text = scratch.write(add_columns(texts, _tokens, ["text"], [("h", T.ArrayType(T.LongType())), ("odd", T.ArrayType(T.LongType()))], keep=["cls"]), "tokens")
    every = of_text.select("cls", F.explode("h").alias("h"))
    often = every.groupBy("h").agg(F.count("*").alias("often"))
    ordered = every.join(often, "h").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("t"))  # one text's shingles
    n = F.col("n")
    longer, shorter = n - F.floor((4 * n + 4) / 5) + 1, n - F.floor((8 * n + 8) / 9) + 1  # exact for LEAST = 4/5
    rows = ordered.select("cls", F.size("t").alias("n"), "t").select("cls", "n", shorter.cast("int").alias("shorter"), F.posexplode(F.slice("t", F.lit(1), longer.cast("int"))).alias("at", "x"))
    label = groups.select(F.col("node").alias("cls"), "label")
    rows = rows.filter("x.often > 1").join(label, "cls", "left").select("cls", F.coalesce("label", "cls").alias("group"), "n", "at", F.col("x.h").alias("h"), (F.col("at") < F.col("shorter")).alias("first"))
    rows = scratch.write(rows, "prefixes")
    per = rows.groupBy("h", "group").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "group")).alias("top"), F.count("*").alias("groups"))
    mixed = per.filter("groups > 1").select("h", F.col("top.group").alias("most"))
    met = scratch.write(rows.join(mixed, "h").join(of_text.select("cls", "odd"), "cls"), "mixed")
    x = met.filter("first").select("h", F.col("cls").alias("a"), F.col("group").alias("ga"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("odd").alias("oa"), (F.col("group") == F.col("most")).alias("main"))
    y = met.select("h", F.col("cls").alias("b"), F.col("group").alias("gb"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("odd").alias("ob"), (F.col("group") != F.col("most")).alias("aside"))
    both = x.filter("NOT main").join(y, "h").unionByName(x.filter("main").join(y.filter("aside"), "h"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))  # what both have from there on
    common = F.floor((4 * (F.col("na") + F.col("nb")) + 8) / 9)  # the least that a pair at LEAST has
    apart = reduce(add, (F.bit_count(F.get("oa", F.lit(k)).bitwiseXOR(F.get("ob", F.lit(k)))) for k in range(PARITY)))
    enough = (left >= common) & (apart <= F.col("na") + F.col("nb") - 2 * common)
    return both.filter("ga <> gb").filter(smaller & (5 * F.col("na") >= 4 * F.col("nb")) & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(x, y) -> list[pa.Array]:
    return [pa.array([similarity(shingles(a), shingles(b)) >= LEAST for a, b in zip(bytes_of(x), bytes_of(y))], pa.bool_())]


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): classes of one fingerprint with its first class, and the first classes of linked fingerprints."""
    of_fp = classes.filter("size > 0").groupBy("fp").agg(F.min("cls").alias("one"))
    same = classes.join(of_fp, "fp").filter("cls <> one").select(F.col("one").alias("a"), F.col("cls").alias("b"))
    linked = links(of_fp).join(of_fp.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    return same.unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies."""
    scratch = Scratch(session_of(docs))
    fields = [("cls", T.LongType()), ("size", T.IntegerType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    marked = add_columns(docs.select("doc_id", "text", text_mark().alias("mark")), _marks, ["text"], fields, keep=["doc_id", "mark"])
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    classes = scratch.write(marked.groupBy("cls").agg(F.min(first).alias("first"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "classes")
    shared, long = _candidates(classes, scratch)
    pairs = scratch.write(shared.unionByName(_by_fingerprint(classes)).distinct(), "pairs")
    scratch.drop("met")
    # A class's first row stands for it; only texts of candidates move.
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(long).distinct()
    wanted = classes.join(needed, "cls", "left_semi").select("cls", "first.doc_id", "first.mark")
    source = docs.select(F.col("doc_id").alias("_id"), text_mark().alias("mark"), "text")
    texts = wanted.join(source, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (wanted["mark"] == source["mark"])).select("cls", "text").dropDuplicates(["cls"])
    texts = scratch.write(texts, "texts")

    def verified(found: DataFrame) -> DataFrame:
        both = found.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
        return add_columns(both, _near, ["x", "y"], [("near", T.BooleanType())], keep=["a", "b"]).filter("near").select("a", "b")

    edges = scratch.write(verified(pairs), "near")
    labels = components(edges, scratch)
    scratch.drop("pairs")
    if not long.isEmpty():
        labels = scratch.write(labels, "groups")
        more = _prefix_pairs(texts.join(long, "cls", "left_semi"), labels, scratch)
        labels = components(edges.unionByName(verified(scratch.write(more, "more"))), scratch)
        for name in ("tokens", "prefixes", "mixed", "more", "groups"):
            scratch.drop(name)
    scratch.drop("texts")
    of_class = classes.select("cls", "first").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    kept = of_class.groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("first").alias("first"))
    stay = scratch.write(kept.select("first.doc_id", "first.mark"), "stay")
    scratch.drop("classes")
    return keep_rows(docs, stay)
