"""The pipeline's stages one by one against brute force, each on its own input."""

import os
import zlib

import pytest

import corpus_pipeline
from llm_brute import brute_kept, brute_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        where = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(where)
        made = spark.read.parquet(where)
        out[name] = (docs, made)
        docs = made
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for name, (docs, made) in list(steps.items())[:-1]:
        assert made.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_language_keeps_documents_with_letters(steps):
    docs, made = steps["language_id"]
    assert texts(made) == {i: t for i, t in texts(docs).items() if any(c.isalpha() for c in t or "")}


def test_one_document_of_each_group_stays(steps):
    """Groups as near-duplicate stages define them: five-word shingles at a similarity of 0.8 or more."""
    docs, made = steps["simhash_near_dedup"]
    assert set(texts(made)) == brute_kept(list(texts(docs).items()))


def test_repeated_passages_go(steps):
    docs, made = steps["substring_dedup"]
    want, got = brute_repeats(sorted(texts(docs).items())), texts(made)
    assert set(got) == {i for i, (n, gone, _) in want.items() if n == 0 or gone < n}
    for i, t in got.items():
        words = t.encode().split()
        assert len(words) == want[i][0] - want[i][1]
    assert all(r["n_chars"] == len(r["text"]) for r in made.collect())


def test_mixture_is_a_part_of_its_input(steps):
    docs, made = steps["mixing"]
    before, after = texts(docs), texts(made)
    assert 0 < len(after) < len(before) and all(before[i] == t for i, t in after.items())


def test_packing_holds_all_documents(steps):
    docs, made = steps["packing"]
    got = made.collect()
    assert {r["doc_id"] for r in got} == set(texts(docs))
    assert all(r["offset"] + r["length"] <= 2048 for r in got)


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, steps["packing"][1].collect()))
    assert zlib.crc32(b"") == 0 and corpus_pipeline.ORACLE_SQL is None


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table, and one of nulls, repeated rows and ids that stand on several texts."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    text = "the quick brown fox jumps over the lazy dog near the old mill by the river bank today"
    other = "a tale of two towns that no one else has told in just these words before now"
    rows = [(3, text, "en", "s", 1), (5, text, "en", "s", 1), (5, other, "en", None, 1), (5, other, "en", None, 1), (None, None, None, None, None), (9, "123", None, "s", 3)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(3, text), (5, other)]
