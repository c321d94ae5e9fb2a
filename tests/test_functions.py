"""Functions and classifiers on hand-made titles with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import classify as C
from shelfwise.functions import text as X


@pytest.fixture(scope="module")
def run(spark):
    def go(build, values, schema="t string"):
        """build: a function of no argument, as columns need a session."""
        df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
        return [r[0] for r in df.select(build().alias("r")).collect()]

    return go


def test_non_english_titles(run):
    cases = {
        "Sheloshah shavuʻot be-Pariz by Author Name": True, "Xjust Rewards Tegf by Author Name": True, "The English Book Title": False,
        "Harry Potter and the Philosopher's Stone": False, "Le Petit Prince": True, "Anne of Green Gables (French Edition)": True, "Book Title": False,
        "I Was Just Thinking": False, "A Compendious History Of The British Churches": False, "Die Another Day": True, "McGee": True, "Would-be-King": True,
        "Xanadu": True, "XML": False, "Polished (Polished Gems)": True, "日本": True, "¿Quién?": True, "Straße": True, "": False,
    }
    assert run(lambda: C.non_english(F.col("t"))["flag"], list(cases)) == list(cases.values())
    assert run(lambda: C.non_english(F.col("t"))["reasons"], [None, "Anne (French Edition)"]) == [[], ["Language edition in parentheses: '(French Edition)'"]]


def test_series_from_title(run):
    cases = {
        "The Sea Before Us (Sunrise at Normandy Book #1)": ("Sunrise at Normandy", 1), "X (Series, Book 3)": ("Series,", 3), "Y (Book #12)": ("Book", 12), "A (Foo 12)": ("Foo", 12),
        "A (Ages 8-12)": ("Ages", 8), "Year (1999)": (None, None), "A (1984 Series Book #2)": (None, None), "A (2nd Edition)": (None, None), "Ruby (Red River Valley)": (None, None),
        "A (x) (Saga Book #3)": (None, None), None: (None, None),
    }
    assert [tuple(r) for r in run(lambda: X.series_from_title(F.col("t")), list(cases))] == list(cases.values())


def test_names(run):
    assert run(lambda: X.author_name(F.col("t")), ["Jane  Roe, John Doe", "Ann Lee et al.", " Bo ", None]) == ["Jane Roe", "Ann Lee", "Bo", None]
    names = ["L. M. (Lucy Maud) Montgomery", "Julia R. Kelly", "Julia Kelly", "Plato", ""]
    assert [tuple(r) for r in run(lambda: X.first_last(F.col("t")), names)] == [("l", "montgomery"), ("julia", "kelly"), ("julia", "kelly"), ("plato", ""), ("", "")]
    assert run(lambda: X.author_group(F.col("t")), ["Ann Lee, Bob Ray", "Ann Lee", "Ann, B", None]) == [["Ann Lee", "Bob Ray"], None, None, None]
    assert run(lambda: C.is_publisher(F.col("t")), ["Penguin Random", "Jane Roe", "site.com", "The Oxford Press", "Ink Inc."]) == [True, False, True, True, True]
    assert run(lambda: C.publisher_label(F.col("t")), ["site.com", "Life Staff", "MIT Press", "Foo LLC", "BBC", "Penguin"]) == ["Website domains", "Staff/Editors", "Press/Publishing", "Corporate entities", "Acronyms", "Other"]


def test_titles(run):
    assert run(lambda: X.title_for_matching(F.col("t")), ["The Sea Before Us (Sunrise at Normandy Book #1)", "An  Orchid's [2nd ed.] `x", None]) == ["sea before us", "orchids x", ""]
    assert run(lambda: X.title_for_dedup(F.col("t")), ["Foo [1/2]", "Foo  Bar (Large Edition)"]) == ["foo", "foo bar"]
    assert run(lambda: X.title_advanced(F.col("t")), ["Book Title Volume 2", "The Book Title vol. iv", "Book Title [2/4]"]) == ["book title", "book title", "book title"]
    assert run(lambda: X.base_title(F.col("t")), ["Ruby (Red River Valley)", "Book Title Volume 2", "The X [y]"]) == ["Ruby", "Book Title", "The X"]
    assert run(lambda: X.series_key(F.col("t")), ["The Amish Series", "amish", "A Fine-Day  series ", None]) == ["amish", "amish", "fineday", ""]
    assert run(lambda: X.composite_parts(F.col("t")), ["The Secret/The Revealing/The Whatever", "Book 1 / Book 2 / Book 3", "Books 1-5", "a/b"]) == [["The Secret", "The Revealing", "The Whatever"], ["Book 1", "Book 2", "Book 3"], [], []]
    assert run(lambda: C.is_composite(F.col("t")), ["Books 1-5", "The Boxed Set", "One", "A|B", "Collection: Books 1 – 4"]) == [True, True, False, True, True]
    assert run(lambda: X.safe_filename(F.col("t")), ["a/b:c", "__x__ ", "", "it's"]) == ["a_b_c", "x", "empty", "it_s"]
    assert run(lambda: X.isbn_key(F.col("t")), ["978-0 1", None]) == ["97801", ""]
    assert run(lambda: X.publication_year(F.col("t")), ["January 2023", "2023-01-01", "1850", "x20234"]) == [2023, 2023, None, None]


def test_dates(run):
    assert run(lambda: X.loan_date(F.col("t")), ["January 12, 2026 02:51", "January 12, 2026", "12/1/26", None]) == [datetime.datetime(2026, 1, 12, 2, 51), datetime.datetime(2026, 1, 12), None, None]
    now = lambda: F.to_timestamp(F.lit("2026-01-31 12:00:00"))
    cases = {
        None: "Never", "": "Never", "x": "Unknown", "2026-01-31T11:59:40": "Just now", "2026-01-31T11:58:00": "2 minutes ago", "2026-01-31T11:00:00": "1 hour ago", "2026-01-31T02:00:00": "10 hours ago",
        "2026-01-30T12:00:00": "1 day ago", "2026-01-26T12:00:00": "5 days ago", "2026-01-20T12:00:00": "1 week ago", "2025-11-30T12:00:00": "2 months ago",
    }
    assert run(lambda: X.since(F.col("t"), now()), list(cases)) == list(cases.values())


def test_similarity(run):
    pairs = [("abcd", "abcd"), ("abcd", "abce"), ("", "a"), ("é", "e")]
    assert run(lambda: X.similarity(F.col("a"), F.col("b")), pairs, "a string, b string") == [1.0, 0.75, 0.0, 0.0]
    assert run(lambda: X.similar(F.col("a"), F.col("b"), 0.75), pairs, "a string, b string") == [True, True, False, False]


def test_categories(run):
    lists = [(["Fiction", "Mystery"],), (["Biography"],), (["Historical", "Love"],), ([],)]
    assert run(lambda: C.is_fiction(F.col("t")), lists, "t array<string>") == [True, False, False, True]
    assert run(lambda: C.toggled_categories(F.col("t")), lists, "t array<string>") == [["Fiction", "Mystery", "Non-Fiction"], ["Fiction"], ["Fiction", "Love"], ["Non-Fiction"]]
    assert run(lambda: C.loan_format(F.col("t")), ["Tantor Media", "Orbit", None, ""]) == ["audiobook", "ebook", "unknown", "unknown"]


def test_childrens(run):
    rows = [("Kids Book", None, None, None), ("X", None, "Juvenile Fiction", None), ("X", None, None, "for ages 8"), ("Cul-de-Sac Kids", "Cul-de-Sac Kids", None, None), ("X", None, None, "a tale"), ("Harry Potter", None, None, "young wizards")]
    col = lambda: C.childrens(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    found = run(col, rows, "a string, b string, c string, d string")
    assert [r["flag"] for r in found] == [True, True, True, True, False, True]
    assert found[3]["reasons"] == ["Children's series name: 'Cul-de-Sac Kids'"]


def test_api_languages(run):
    rows = [(["/languages/eng"], None, "x"), (["/languages/fre"], ["/languages/eng"], "x"), ([], ["/languages/ger"], "x"), (None, None, "日本"), (None, None, "x")]
    assert run(lambda: C.languages_english(F.col("a"), F.col("b"), F.col("c")), rows, "a array<string>, b array<string>, c string") == [True, False, False, False, True]
    assert run(lambda: C.volume_english(F.col("a"), F.col("b")), [("en-US", "x"), ("fr", "x"), (None, "日本"), ("", "x")], "a string, b string") == [True, False, False, True]
