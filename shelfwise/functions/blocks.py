"""Keys under which titles meet before they are compared, so that a large author's titles aren't compared all with all.

near_keys: texts within k edits of each other share one of the first 2k + 1 of their numbered pairs of characters in any
fixed order, here that of their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts_of(c: Column, size: int) -> Column:
    """The parts of so many characters, in order."""
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: c.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def near_keys(c: Column, least: float) -> Column:
    """Keys of which texts with a similarity (F22) of `least` or more share one: an array."""
    pairs = F.when(F.length(c) > 1, parts_of(c, 2)).otherwise(F.array(c))
    numbered = F.transform(pairs, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == g))))
    edits = F.floor(F.length(c) * ((1 - least) / least) + 1e-9).cast("int")  # of the longest text that is still similar
    return F.slice(F.array_sort(numbered), F.lit(1), 2 * edits + 1)
