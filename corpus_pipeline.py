"""The corpus pipeline: languages, near-duplicates, repeated substrings, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and writes nothing itself; run() writes
each stage's result to the shared folder and reads it again, so a lost executor costs one stage's tasks at most.
SQL can't express the stages (trained machines, 64-bit XXH hashes, raking to a fixed point): ORACLE_SQL is None, and
tests/llm holds each stage against a brute-force version."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import language, mixing, near_copies, packing, substring
from shelfwise.llm.common import Scratch, table
from shelfwise.llm.queries import MIX


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can't be told (a null text, one without a letter) go, and those told with a score under 0.05;
    repeated rows are judged one by one."""
    return language.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at five-word similarity 0.8 stays: that with the smallest id, null last, then
    the smallest hash of its text. Texts without words are one group."""
    return near_copies.keep_distinct(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stand earlier in the corpus (smaller id, null first) are cut out; documents left
    empty by that go, those that had no word stay."""
    return substring.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the target weights of their source, language and topic: about half of the tokens stay. Cells
    without a word keep all their rows, repeated rows stay or go together."""
    return mixing.sample_mix(docs, MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document with their place in a training sequence; a null text is the end id alone. An empty table
    passes all stages as one."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
