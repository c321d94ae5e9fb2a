"""Line-first quality cleaning, in DataFrame expressions only.

Each line is tried against navigation, boilerplate, symbol and punctuation rules and against the lines before it;
failing lines go, and a document that loses too large a share of its characters is rejected. Document-level base
counts (words, symbols, repeated lines, words in repeated three-word windows) come with it.

Nothing is shuffled: every figure of a row comes from that row. Null texts count as empty: no words, base_failed.
Repeated rows are judged one by one. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP

BLANKS = " \t\n\x0b\x0c\r"
#: The symbols counted by the base rule.
SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence or a line (regular expression), before white space or the line's end.
SENTENCE_END = r"""[.!?:;"')\]…»”’]([\x20\x09-\x0D]|$)"""
#: Separators of menus.
MENU = "|»›•·"
#: Phrases of boilerplate lines (regular expression, any case).
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|copyright \(c\)|subscribe to our|sign up for|click here|enable javascript|lorem ipsum|permission is hereby granted|licensed under the)"
#: A part of each of those phrases; only texts with one of them are tried against the expression.
BOILERPLATE_PARTS = ("rights", "policy", "terms", "copyright", "subscribe", "sign up", "click", "javascript", "ipsum", "hereby", "licensed")


@dataclass(frozen=True)
class LineRules:
    """menu_share: menu separators per word above which a line is navigation; symbol_share: symbols per word above
    which it is noise; end_words: a line of at least so many words must
    have a sentence's end somewhere; least_kept: share of the
    characters in words that must stay; least_words, repeat_percent: the base rules."""

    menu_share: float = 0.25
    symbol_share: float = 0.5
    end_words: int = 8
    least_kept: float = 0.5
    least_words: int = 50
    repeat_percent: int = 50


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def visible(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def count_any(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def may_be_boilerplate(text: Column) -> Column:
    lower = F.lower(text)
    return reduce(or_, (F.contains(lower, F.lit(p)) for p in BOILERPLATE_PARTS))


def line_fails(line: Column, rules: LineRules, suspect: Column) -> Column:
    """suspect: whether the line's text may have a boilerplate phrase. Cheap tests stand before those that they spare."""
    n = F.size(F.split(F.btrim(line, F.lit(BLANKS)), WORD_GAP))
    return (
        (~line.rlike(SENTENCE_END) & (n >= rules.end_words))
        | (line.rlike(f"[{MENU}]") & (count_any(line, MENU) > rules.menu_share * n))
        | (line.rlike(r"[#*$%&|<>]") & (count_any(line, SYMBOLS) > rules.symbol_share * n))
        | (suspect & line.rlike(BOILERPLATE))
    )


def assess(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_lines_removed, kept_chars."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
        may_be_boilerplate(F.col("text")).alias("suspect"),
    )
    n = F.size("words")
    hashes = F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    )
    counted = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(visible(F.col("text"))).cast("long").alias("word_chars"),
        count_any(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        "lines",
        "suspect",
        F.array_distinct("lines").alias("firsts"),
        hashes.alias("hashes"),
    ).select("*", (F.size("lines") - F.size("firsts")).cast("long").alias("n_dup_lines"), (F.size(F.array_distinct("hashes")) < F.size("hashes")).alias("repeats"))
    # Sorting the pairs (hash, place) is only needed where some window comes twice.
    paired = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.size("lines").cast("long").alias("n_lines"),
        F.filter("firsts", lambda x: ~line_fails(x, rules, F.col("suspect"))).alias("kept_lines"),
        F.when(F.col("repeats"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"),
    )
    at = F.sort_array(
        F.transform(
            F.filter(
                F.transform(
                    "ordered",
                    lambda x, k: F.struct(x["i"].alias("i"), ((x["h"] == F.coalesce(F.get("ordered", k - 1)["h"], F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(F.get("ordered", k + 1)["h"], F.bitwise_not(x["h"])))).alias("twice")),
                ),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    placed = paired.select("*", at.alias("at")).drop("ordered")
    # The last window covers three words, any other as many as lie before the next one, three at most.
    covered = F.aggregate(F.transform("at", lambda p, k: F.coalesce(F.least(F.get("at", k + 1) - p, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("kept_lines").cast("long").alias("n_kept"),
        F.when(F.size("kept_lines") == F.col("n_lines"), F.col("word_chars")).otherwise(F.length(visible(F.array_join("kept_lines", ""))).cast("long")).alias("kept_chars"),
    )
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("kept_chars") >= rules.least_kept * F.col("word_chars"))).alias("kept"),
        "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_lines_removed"), "kept_chars",
    )


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """docs with failing and repeated lines taken out of text; a null text stays null."""
    lines = F.array_distinct(F.filter(F.split("text", "\n"), has_word))
    suspect = may_be_boilerplate(F.col("text"))
    return docs.withColumn("text", F.array_join(F.filter(lines, lambda x: ~line_fails(x, rules, suspect)), "\n"))
