"""Joins of texts with those that hold them.

Whatever holds a text has all its parts of three characters. So a text meets others under one of its parts only, the rarest: how
often parts occur is counted first, over all texts that may hold others, in `BUCKETS` buckets of their hashes. Parts
that share a bucket make a choice worse, not the result. Texts of one or two characters meet under themselves. All is done
between different texts; copies come back at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import parts_of
from ..store import settled

#: How many counts choose the parts; they are a constant of the plan.
BUCKETS = 4096


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


def _frequencies(wholes: DataFrame, whole: str) -> Column:
    """An array of BUCKETS numbers: how many texts have a part of each bucket."""
    buckets = F.array_distinct(F.transform(parts_of(F.col(whole), 3), _bucket))
    counts = dict(tuple(r) for r in wholes.select(F.explode(buckets).alias("b")).groupBy("b").count().collect())
    return F.split(F.lit(",".join(str(counts.get(k, 0)) for k in range(BUCKETS))), ",").cast("array<long>")


def _rarest(c: Column, often: Column) -> Column:
    """The part under which a text of three characters or more meets others."""
    scored = F.transform(parts_of(c, 3), lambda g: F.struct(F.get(often, _bucket(g)).alias("n"), g.alias("g")))
    return F.array_min(scored)["g"]


def candidates(parts: DataFrame, wholes: DataFrame, by: list[str], part: str, whole: str) -> DataFrame:
    """by, part, whole: different texts that meet; both are columns of different texts. Texts shorter than three characters
    are looked for only where there are any."""
    key = F.when(F.length(part) >= 3, _rarest(F.col(part), _frequencies(wholes, whole))).otherwise(F.col(part))
    sizes = (3,) if parts.filter(F.length(part) < 3).isEmpty() else (1, 2, 3)
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *(parts_of(F.col(whole), n) for n in sizes)))
    return parts.withColumn("_g", key).join(wholes.withColumn("_g", F.explode(keys)), [*by, "_g"]).drop("_g")


def _texts(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    return settled(rows.select(*by, text).filter(F.col(text).isNotNull()).distinct())


def _held(p: DataFrame, w: DataFrame, by: list[str], part: str, whole: str) -> DataFrame:
    return candidates(p, w, by, part, whole).filter(F.contains(whole, F.col(part))).select(*by, part, whole)


def holding(parts: DataFrame, wholes: DataFrame, by: list[str], part: str, whole: str) -> DataFrame:
    """Rows of parts with those rows of wholes whose text holds theirs; nulls hold nothing and are in nothing."""
    pairs = _held(_texts(parts, by, part), _texts(wholes, by, whole), by, part, whole)
    return parts.join(pairs, [*by, part]).join(wholes, [*by, whole])


def either_holding(a: DataFrame, b: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rows of a with those rows of b of which one text holds the other; equal ones come once."""
    p, w = _texts(a, by, x), _texts(b, by, y)
    pairs = _held(p, w, by, x, y).unionByName(_held(w, p, by, y, x)).distinct()
    return a.join(pairs, [*by, x]).join(b, [*by, y])
