"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import itertools
import math
import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import duck, same
from llm_brute import brute_components, brute_fingerprint, brute_repeats
from shelfwise.llm import html, language, mixing, near_copies, packing, quality, queries, rollup, simhash, substring, topk, toxicity
from shelfwise.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF2), reason="the driver's tables aren't here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators make.
EXTRA = ["score", "fp", "found", "words", "fingerprint", "key", "label", "text_hash", "kept", "probability", "title", "n_words", "sequence_id"]


def docs_of(spark, texts, start=0):
    df = spark.createDataFrame([(None if t is Ellipsis else start + i, None if t is Ellipsis else t, "en", "s", len(t) if isinstance(t, str) else None) for i, t in enumerate(texts)], DOCS)
    return df


def with_extra(df):
    return df.withColumns({c: F.lit(7) for c in EXTRA})


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 30, 120, 300]))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:  # near copies, shared passages, exact copies
        w = t.split()
        if w:
            w[rnd.randrange(len(w))] = "edited"
        out += [" ".join(w), "intro words " + " ".join(w[10:60]) + "\n\ttail", t, t.upper()]
    return out + ["", "   ", None, "a " * 70, ("x y z " * 30).strip(), "Ärger é É ß" * 3]


# Substring dedup


@pytest.mark.parametrize("spans", [substring.Spans(), substring.Spans(largest_shard=1), substring.Spans(seed=4, largest_shard=3, most_bits=20), substring.Spans(largest_shard=2, most_bits=3)])
def test_substring_equals_brute_force(spark, prose, spans):
    df = with_extra(docs_of(spark, prose)).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in substring.repeated_words(df, spans).collect()}
    assert got == brute_repeats(enumerate(prose))


def test_substring_windows_of_other_lengths(spark, prose):
    got = {r[0]: tuple(r[1:]) for r in substring.repeated_words(docs_of(spark, prose), substring.Spans(window=12, seed=5)).collect()}
    assert got == brute_repeats(enumerate(prose), 12)


def test_substring_removal_keeps_the_rest(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    df = with_extra(docs_of(spark, [passage, f"Before\t it {passage}\n after", passage, None, ""]))
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    assert rows(out, "doc_id", "text", "n_chars") == [(0, passage, len(passage)), (1, "Before\t it after", 16), (3, None, None), (4, "", 0)]


def test_substring_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(5, passage), (5, passage), (None, passage), (9, passage)], "doc_id long, text string")
    # null ids come first; a repeated row has the result of its document
    assert rows(substring.repeated_words(df), "doc_id", "n_removed") == [(5, 25), (5, 25), (9, 25), (None, 0)]


def test_suffix_automaton_statistics():
    rnd = random.Random(3)
    automaton, seen = substring.SuffixAutomaton(), []
    for _ in range(12):
        line = [rnd.choice("ab") for _ in range(14)]
        want = [max((n for n in range(i + 2) if any(line[i + 1 - n : i + 1] == s[k : k + n] for s in seen for k in range(len(s) - n + 1))), default=0) for i in range(len(line))]
        assert automaton.matching(line) == want
        automaton.add(line)
        seen.append(line)


# SimHash


def test_simhash_equals_brute_force(spark, prose):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(with_extra(docs_of(spark, prose))).collect()}
    fps = [brute_fingerprint(t) for t in prose]
    comp = brute_components(list(range(len(prose))), fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in range(len(prose))}
    assert fps[-6] == 0 and got[len(prose) - 4][0] == "0" * 16


def test_golay_keys_meet_for_every_link():
    counts, patterns = simhash.golay_patterns()
    assert set(counts.tolist()) == {1, 6}
    rnd = random.Random(2)
    fps = []
    for _ in range(400):
        f = rnd.getrandbits(64)
        g = f
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            g ^= 1 << b
        fps += [f, g]
    row, key = simhash.fuzzy_keys(np.array(fps, dtype=np.uint64), counts, patterns)
    keys = [set() for _ in fps]
    for r, k in zip(row.tolist(), key.tolist()):
        keys[r].add(k)
    assert all(keys[i] & keys[i + 1] for i in range(0, len(fps), 2))


def test_simhash_long_chains_and_large_runs(spark):
    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << i))
    rnd = random.Random(4)
    cloud = [(1 << 63) ^ sum(1 << b for b in rnd.sample(range(40, 60), rnd.randint(0, 3))) for _ in range(200)]
    fps = sorted(set(chain + cloud))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    scratch = Scratch(spark)
    got = {r["node"]: r["label"] for r in simhash.components(simhash.links(df), scratch).collect()}
    want = brute_components(signed, fps)
    by = {}
    for s, w in zip(signed, want):
        by.setdefault(w, set()).add(got.get(s, s))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_keep_representatives(spark, prose):
    df = with_extra(docs_of(spark, prose))
    df = df.union(df.filter("doc_id = 0")).union(df.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.keep_representatives(df)
    comp = brute_components(list(range(len(prose))), [brute_fingerprint(t) for t in prose])
    assert kept.columns == df.columns and [r[0] for r in rows(kept, "doc_id")] == sorted(set(comp), key=lambda i: repr((i,)))


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1), (2, 1, 0)])
def test_repeated_ids_lose_no_text(spark, order):
    """An id that stands on a copy of another id's text and on a text of its own keeps its own, in any order of the rows."""
    found = [(3, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six seven")]
    df = spark.createDataFrame([found[k] for k in order], "doc_id long, text string").coalesce(1)
    for kept in (simhash.keep_representatives(df), near_copies.keep_distinct(df)):
        assert rows(kept) == [found[0], found[2]]


# Quality rules


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, prose):
    texts = prose + ["a b c a b c", "a a a a", "x\nx\n \nx", "# * $ % & | < >", "one\x1ctwo\x85three four"]
    got = {r["doc_id"]: r for r in quality.assess(with_extra(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_by_line(spark):
    good = "This is a sentence of the text that goes on for a while, as sentences do."
    texts = [good + "\n" + good, good + "\nhome | news | about | more", good + "\nno end of the sentence here at all but many words", good + "\nAll rights reserved. See our cookie policy.", good + "\nshort"]
    assert rows(quality.clean(docs_of(spark, texts)), "text") == sorted([(good,)] * 4 + [(good + "\nshort",)], key=repr)
    long = [" ".join(f"word{i}{k}" for i in range(12)) + "." for k in range(10)]
    menu = [" | ".join(f"m{k}x{i}" for i in range(9)) for k in range(40)]
    r = quality.assess(docs_of(spark, ["\n".join(long), "\n".join(long[:3] + menu)])).orderBy("doc_id").collect()
    assert [x["kept"] for x in r] == [True, False] and not r[1]["base_failed"]


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    same(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])


# Language


@needs_tables
def test_language_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF2}/documents.parquet")
    got = language.identify(with_extra(d)).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0
    fold = got.select("doc_id").limit(5).collect()
    assert all(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in fold)


def test_language_keeps_columns_of_any_name(spark):
    df = docs_of(spark, ["the cat and the dog", "12"] * 8).withColumns({"__lang_pred": F.lit("mine"), "__Lang_Score": F.lit(2)})
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {(r["text"], r["__lang_pred"]) for r in kept.collect()} == {("the cat and the dog", "mine")}


def test_language_learns_the_most_frequent_languages(spark):
    rows_ = [(i, f"{'abcdef'[i % 3] * 5} {'ghijkl'[i % 3] * 4} {i}", ["aa", "bb", "cc"][i % 3] if i < 30 else "aa", "s", None) for i in range(60)]
    df = spark.createDataFrame(rows_, DOCS)
    assert {v for _, members in language.train(df, language.Sample(languages=2)).families for v in members} == {"aa", "bb"}
    assert language.train(df.limit(0)) is None


def test_language_odd_rows(spark):
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "el perro y el gato"] * 20 + [None, "", "123 !!", "x", "日本"]
    langs = ["en", "fr", "de", "es"] * 20 + ["en"] * 5
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, langs)), "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert [got[i]["lang_pred"] for i in (80, 81, 82)] == ["und"] * 3 and got[80]["score"] == 0
    assert [got[i]["lang_pred"] for i in range(4)] == langs[:4]
    assert rows(language.keep_identified(with_extra(df)).filter("doc_id >= 80"), "doc_id")[0] == (83,)
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(none).collect()} == {"und"}
    one = df.withColumn("lang", F.lit("xx"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(one).collect()} == {("und", 0.0), ("xx", 1.0)}


# Toxicity


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.detect(with_extra(d), labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    wrong = [r for r in got if r["toxic"] == 0 and r["predicted"]]
    assert not wrong and np.mean([r["predicted"] for r in got if r["toxic"] == 1]) > 0.7


def test_toxicity_scores_the_likelihood_it_was_fitted_to():
    """The trained weights beat their neighbours under the noisy-or of exactly the chances that scores are made of."""
    rnd = random.Random(24)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    texts, toxic = [], []
    for i in range(300):
        lines = [" ".join(rnd.choice(common) for _ in range(6)) + "." for _ in range(5)]
        if i % 3 == 0 or rnd.random() < 0.02:
            lines.append(rnd.choice(["vilest wretch", "odious vermin"]) + " " + rnd.choice(common) + ".")
        texts.append(" ".join(lines))
        toxic.append(int(i % 3 == 0))
    model = toxicity.fit(texts, toxic, toxicity.Sample(steps=2000))

    def likelihood(weights):
        scores = [toxicity.score_one(t, toxicity.Model(weights, model.bias), {})[0] for t in texts]
        bad, clean = sum(toxic), len(toxic) - sum(toxic)
        return sum(math.log(max(s, 1e-12)) / bad if y else math.log(1 - s) / clean for s, y in zip(scores, toxic))

    best = likelihood(model.weights)
    for f in list(model.weights)[:6]:
        for change in (-0.5, 0.5):
            assert likelihood(model.weights | {f: max(0.0, model.weights[f] + change)}) <= best + 2e-3
    long = " ".join(" ".join(rnd.choice(common) for _ in range(6)) + "." for _ in range(20000))
    assert toxicity.score_one(long, model, {})[0] < 0.05  # sentences without evidence add nothing


@needs_tables
def test_toxicity_trains_alike_on_executors(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = toxicity.train(d, labels)
    rows_ = sorted((r["doc_id"], r["text"], r["toxic"]) for r in d.join(labels, "doc_id").collect() if r["text"] is not None)
    two = toxicity.fit([t for _, t, _ in rows_], [y for *_, y in rows_])
    assert one.weights.keys() == two.weights.keys() and all(abs(one.weights[f] - two.weights[f]) < 1e-6 for f in one.weights)


def test_toxicity_finds_sentences(spark):
    rnd = random.Random(6)
    clean = [" ".join(rnd.choice(["tree", "lake", "road", "house", "cloud"]) for _ in range(6)) + "." for _ in range(40)]
    texts, toxic = [], []
    for i in range(200):
        some = [rnd.choice(clean) for _ in range(rnd.randint(1, 12))]
        if i % 3 == 0:
            some[rnd.randrange(len(some))] = "you are a scoundrel indeed."
        texts.append(" ".join(some))
        toxic.append(int(i % 3 == 0))
    df = with_extra(docs_of(spark, texts + [None, "", "..."]))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, 0), (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(df, labels).collect()}
    assert [got[i]["predicted"] for i in range(200)] == toxic
    assert [got[i]["score"] for i in (200, 201, 202)] == [0.0] * 3
    for i in range(200):
        spans = [texts[i][s["start"] : s["end"]].strip() for s in got[i]["offending"]]
        assert spans == (["you are a scoundrel indeed."] if toxic[i] else [])
    assert {r["score"] for r in toxicity.detect(df, labels.limit(0)).collect()} == {0.0}


# HTML


def extract(spark, pages, rules=html.Rules()):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumns({"text": F.lit(1), "tree": F.lit(2), "site": F.lit(3)})
    return [r["text"] for r in html.extract(df, rules).orderBy("page_id").collect()]


def test_html_articles(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x</p>";</script></head><body><nav><ul><li>menu<li>two</ul></nav><!-- <p>c</p> --><div class="ad">buy</div>'
        '<header><h1>Site</h1></header><article class=post><header><h1>Head &amp; line</h1></header><p>One<br>two <b>bold</b>ly&nbsp;<p>Three &lt;tag&gt; &eacute; &#233; &am<div class="share-box">share</div><section id="comments"><p>reader</p></section>'
        '<aside>side</aside><form>f</form><ul><li>a<li>b</ul></article><p>outside</p><footer>&copy; foot</footer>'
    )
    want = "Head & line One two boldly Three <tag> é é &am a b"
    assert extract(spark, [("http://a.x/1", page), ("http://a.x/2", None), ("http://a.x/3", ""), (None, "plain text only"), ("", "<p>a <p>b<div>c"), ("http://b.y", "<article><p>unclosed <b>x")]) == [want, "", "", "plain text only", "a b c", "unclosed x"]


def test_html_site_style_trees(spark):
    """Without an article, what all pages of a site share goes; what differs stays. Both ways of joining agree."""
    pages = []
    for site in ("http://one.example/", "https://two.example:80/"):
        for i in range(12):
            pages.append((f"{site}{i}", f'<body><div class="top">Welcome to the site</div><div class="body"><p>Story {site} {i} is its own.</p><p>And so {i * 7} on.</p></div><div class="end">Made by us all</div></body>'))
    got = extract(spark, pages)
    assert got == [f"Story {u.rsplit('/', 1)[0]}/ {i % 12} is its own. And so {i % 12 * 7} on." for i, (u, _) in enumerate(pages)]
    assert extract(spark, pages, html.Rules(most_broadcast=0)) == got
    assert extract(spark, pages[:2]) == [" ".join(["Welcome to the site", g, "Made by us all"]) for g in got[:2]]  # too few pages to tell


def test_html_wrappers_and_importance_with_an_article(spark):
    """Wrappers with a noise word keep their article; on a site, shared branches inside go and own text outside stays."""
    for head in ('<body class="has-sidebar">', '<body><div class="no-comments">', '<body><div id="page-search-layout">'):
        page = head + '<nav>menu</nav><article><p>Told here.</p></article><aside><article>teaser</article></aside>'
        assert extract(spark, [("http://a.x/1", page)]) == ["Told here."]
    pages = [(f"http://s.x/{i}", f'<body><div class="top">Welcome</div><div class="lead">Lead {i}</div><article><p>Story {i}.</p><div class="rules">House rules of us all</div></article></body>') for i in range(12)]
    assert extract(spark, pages) == [f"Lead {i} Story {i}." for i in range(12)]
    same = [(f"http://t.x/{i}", "<body><article><p>One for all</p></article></body>") for i in range(4)]
    assert extract(spark, same) == ["One for all"] * 4


def test_html_names_that_name_nothing_else():
    for page, want in (
        ('<article><h2 id="related-work">Related work</h2><p>Body one.</p></article>', "Related work Body one."),
        ('<article><section id="comments-on-theory">On theory</section><p class="menu-items">Items</p></article>', "On theory Items"),
        ('<article>a<div id="comments">reader</div><div class="ad-slot-3">buy</div><button>Share</button> b</article>', "a b"),
        ('<article><p>seen</p><div hidden>unseen</div><p style="display: none">unseen</p></article>', "seen"),
    ):
        assert html.extract_one(page, {}, html.Rules()) == want


def test_html_deep_and_broken_markup_takes_linear_time():
    import time

    start = time.perf_counter()
    assert html.extract_one("<div>" * 100_000 + "<article><p>x</p></article>", {}, html.Rules()) == "x"
    assert html.extract_one("<div>" * 50_000 + "</section>" * 100_000 + "y", {}, html.Rules()) == "y"
    assert time.perf_counter() - start < 30


def test_html_importances_equal_plain_entropies(spark):
    """The tree's importances against entropies counted page by page."""
    rnd = random.Random(21)
    pages = []
    for i in range(9):
        items = "".join(f"<li>{rnd.choice('abc')}</li>" for _ in range(rnd.randint(1, 3)))
        pages.append(f"<body><div class=top>Hello</div><div class=mid><p>{rnd.choice('xyz')}</p>{'<h2>t</h2>' * (i % 2)}</div><ul>{items}</ul></body>")
    df = spark.createDataFrame([(i, "http://s.x/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["path"]: (r["pages"], r["presentation"], r["content"]) for r in html.style_trees(df).collect()}
    styles, blocks = {}, {}
    for p in pages:
        own = set()
        for n in html.nodes(html.parse(p)[0]):
            own.add((n.path, 0, tuple(c.path for c in n.children if not isinstance(c, str))))
            own |= {(n.path, 1, c) for c in n.children if isinstance(c, str)}
        for path, kind, feature in own:
            of = (styles, blocks)[kind].setdefault(path, {})
            of[feature] = of.get(feature, 0) + 1
    assert set(got) == set(styles)
    for path, of in styles.items():
        m = sum(of.values())
        entropy = -sum(n / m * math.log(n / m, m) for n in of.values()) if m > 1 else 1.0
        texts = blocks.get(path, {})
        mean = sum(n * math.log(n, m) for n in texts.values()) / sum(texts.values()) if texts and m > 1 else 0.0
        assert got[path] == (m, pytest.approx(entropy), pytest.approx(1 - mean))


@needs_tables
def test_html_importances_decide_on_the_tables_pages(spark):
    """Other importances give other texts: adverts and menus of many presentations would stay, shared headlines go."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()

    class Forged(dict):
        def get(self, key, default=None):
            return (9, 1.0, 1.0)

    for r in pages:
        assert html.extract_one(r["html"], {}, html.Rules()) != html.extract_one(r["html"], Forged(), html.Rules())
        h1 = next(n.path for n in html.nodes(html.parse(r["html"])[0]) if n.tag == "h1")
        lone = html.extract_one(r["html"], {h1: (9, 0.0, 0.0)}, html.Rules())
        assert html.extract_one(r["html"], {}, html.Rules()).endswith(lone) and len(lone) < len(html.extract_one(r["html"], {}, html.Rules()))


@needs_tables
def test_html_on_the_tables_pages(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF2}/pages.parquet")
    text = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    for r in pages.collect():
        want = " ".join(unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", r["html"], re.S)[1])).split())
        assert text[r["page_id"]] == (want, len(want))


# Token totals


def test_rollup_counts_each_batch_once(spark):
    scratch = Scratch(spark)
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", 3, None)], schema)
    two = spark.createDataFrame([("revise", "a", "en", "t1", 12, 10), ("delete", "a", "en", "t1", 5, None), ("delete", None, None, "t1", 3, None), ("insert", "b", "fr", "t2", None, None)], schema)
    totals = rollup.TokenTotals(spark, f"{scratch.root}/t")
    assert totals.totals().count() == 0
    assert totals.commit("1", one) and not totals.commit("1", one)
    assert rows(totals.totals()) == sorted([("a", "en", "t1", 2, 15), (None, None, "t1", 1, 3)], key=repr)
    assert totals.compact() and not totals.commit("1", one)
    again = rollup.TokenTotals(spark, f"{scratch.root}/t")  # another process goes on from the files
    assert again.commit("2", two) and not totals.commit("2", two)
    assert rows(again.totals()) == [("a", "en", "t1", 1, 12), ("b", "fr", "t2", 1, 0)]
    assert again.compact() and again.committed() == {"1", "2"} and rows(again.totals()) == [("a", "en", "t1", 1, 12), ("b", "fr", "t2", 1, 0)]
    with pytest.raises(Exception, match="unknown kind"):
        totals.commit("3", spark.createDataFrame([("other", "a", "en", "t1", 1, None)], schema))
    assert again.committed() == {"1", "2"}


def test_rollup_compaction_and_late_writers(spark):
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "t", 10, None)], schema)
    totals = rollup.TokenTotals(spark, f"{Scratch(spark).root}/t")
    for k in range(3):
        assert totals.commit(f"{k}", one) and totals.compact()
    assert totals._names("batches") == [] and len(totals._names("snapshots")) <= 2  # nothing folded is left behind
    assert rows(totals.totals()) == [("a", "en", "t", 3, 30)] and totals.committed() == {"0", "1", "2"}
    # A writer that looked before the others committed publishes its batch after compaction: it is listed, so it doesn't count.
    assert totals._publish(rollup.deltas(one), "batches/1") and rows(totals.totals()) == [("a", "en", "t", 3, 30)]
    # A compaction that died before it removed anything leaves folders that are listed too.
    assert totals.commit("3", one) and rows(totals.totals()) == [("a", "en", "t", 4, 40)]
    remove, totals._remove = totals._remove, lambda place: None
    assert totals.compact() and rows(totals.totals()) == [("a", "en", "t", 4, 40)]
    totals._remove = remove
    assert totals.compact() and rows(totals.totals()) == [("a", "en", "t", 4, 40)] and not totals.commit("3", one)


def test_rollup_of_tokenizer_counts(spark, prose):
    path, slow = tokenizer()
    totals = rollup.TokenTotals(spark, f"{Scratch(spark).root}/t")
    totals.commit("a", rollup.inserted(docs_of(spark, prose), path, "bpe-1"))
    assert rows(totals.totals()) == [("s", "en", "bpe-1", len(prose), sum(len(slow.encode(t or "", add_special_tokens=False).ids) for t in prose))]


@needs_tables
def test_tokenizer_totals_cover_all_documents(spark):
    """The registered query counts every document, short ones too, with both tokenizer files."""
    import public_tokenizers
    from tokenizers import Tokenizer

    want = {}
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        slow = Tokenizer.from_file(public_tokenizers.path(f"{version}.json"))
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
            docs, tokens = want.get((r["source"], r["lang"], version), (0, 0))
            want[(r["source"], r["lang"], version)] = (docs + 1, tokens + len(slow.encode(r["text"] or "", add_special_tokens=False).ids))
    got = queries.queries()["op3_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in got} == want


def test_rollup_is_order_free(spark):
    rnd = random.Random(8)
    schema = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    events = [("insert", rnd.choice("ab"), "en", "t", rnd.randint(0, 9), None) for _ in range(60)]
    events += [("delete", *e[1:]) for e in events[:20]] + [("revise", *e[1:4], e[4] + 2, e[4]) for e in events[20:40]]
    want = {}
    for kind, s, _, _, n, old in events:
        d, t = want.get(s, (0, 0))
        want[s] = (d + {"insert": 1, "delete": -1, "revise": 0}[kind], t + (n if kind == "insert" else -n if kind == "delete" else n - old))
    rnd.shuffle(events)
    totals = rollup.TokenTotals(spark, f"{Scratch(spark).root}/t")
    for k in range(0, len(events), 25):
        totals.commit(f"b{k}", spark.createDataFrame(events[k : k + 25], schema))
    assert {r["source"]: (r["docs"], r["tokens"]) for r in totals.totals().collect()} == want


# Packing


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_equals_the_tokenizer():
    path, slow = tokenizer()
    encoder = packing.Encoder(path)
    rnd = random.Random(9)
    alphabet = [*"abcXYZ019 .,'\"\n\t  \r!?-_", "é", "ß", "Ö", "ñ", " ", "\x85", " ", "’", "日本", "😀", "ı", "ſ", "\x1c", "᠎", "'s", "'ll", "<|endoftext|>", "<|", "²", "Ⅷ"]
    texts = ["", " ", "  a  b ", "don't  we'll\n\n x"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert list(np.frombuffer(encoder.encode(t), dtype="<u4")) == slow.encode(t, add_special_tokens=False).ids, repr(t)
    assert encoder.fast is not None


@pytest.mark.parametrize("unit", [" ", "\n", "a", "ab \n"])
def test_encoder_on_very_long_runs(unit):
    path, slow = tokenizer()
    encoder = packing.Encoder(path)
    text = "x" + unit * (2_000_000 // len(unit)) + "y"
    assert list(np.frombuffer(encoder.encode(text), dtype="<u4")) == slow.encode(text, add_special_tokens=False).ids
    assert packing.Encoder(path.replace("byte_bpe_50k", "word_bpe_49k")).count(text) > 0


def test_encoder_on_ten_million_blanks():
    assert len(packing.Encoder(tokenizer()[0]).encode(" " * 10**7)) == 4 * 10**7


def test_word_counts_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, slow = packing.Encoder(path), Tokenizer.from_file(path)
    assert encoder.by_word and encoder.pieces
    rnd = random.Random(19)
    alphabet = [*"abcXYZéÉßøœ0189'’s_-.,;:|#t \t\n\r", "'ll", "<|endoftext|>", "Đ", "ł", "İ", "ı", "ſ", "\x1c", "\x0b", "\x85", "\u3000", "é", "ΑΣ", "日本", "😀"]
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30)))
        assert encoder.count(t) == len(slow.encode(t, add_special_tokens=False).ids), repr(t)


def best_fit_by_piece(sizes, capacity):
    """Plain best fit: piece by piece by falling size, into the open sequence with the least weighted norm of what is left."""
    limits, weights, bins = capacity.limits.astype(float), np.array(capacity.weights), []
    for n in sorted(sizes, reverse=True):
        demand = np.array([n, 1, n * n])
        fits = [(float((weights * ((b - demand) / limits) ** 2).sum()), k) for k, b in enumerate(bins) if (b >= demand).all()]
        if fits:
            bins[min(fits)[1]] -= demand
        else:
            bins.append(capacity.limits - demand)
    return len(bins)


@pytest.mark.parametrize("limits", [{}, {"documents": 6}, {"attention": 3000}, {"documents": 5, "attention": 4000}])
def test_packing_equals_best_fit_by_piece(limits):
    rnd = random.Random(20)
    capacity = packing.Capacity(tokens=100, **limits)
    for _ in range(5):
        sizes = [min(100 if "attention" not in limits else 54, int(rnd.expovariate(0.05)) + 1) for _ in range(400)]
        opened = packing.pack({n: sizes.count(n) for n in set(sizes)}, capacity)[1]
        assert abs(opened - best_fit_by_piece(sizes, capacity)) <= 1


@needs_tables
def test_capacities_bind_on_the_tables(spark):
    """Under the document and attention capacities more sequences are needed, and none exceeds either."""
    path, _ = tokenizer()
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    free = packing.pack_documents(docs, path).select("sequence_id").distinct().count()
    capacity = packing.Capacity(documents=4, attention=2_000_000 + 2048**2 // 2)
    packed = packing.pack_documents(docs.filter("length(text) < 4000"), path, packing.Capacity(documents=2, attention=2048**2))
    most = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t"))
    assert most.filter("n > 2 OR t > 2048").isEmpty() and capacity.limits[1] == 4
    assert most.count() > packing.pack_documents(docs.filter("length(text) < 4000"), path).select("sequence_id").distinct().count() and free > 0


def test_packing_round_trip(spark, prose):
    path, slow = tokenizer()
    texts = prose + ["word " * 5000, "other thing " * 1024, None]
    df = with_extra(docs_of(spark, texts)).repartition(4)
    got = packing.pack_documents(df, path).collect()
    ids = {i: slow.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
    assert set(pieces) == set(ids)
    for i, p in pieces.items():
        p.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in p] == list(range(len(p))) and [(r["start"], r["length"]) for r in p] == packing.cut(len(ids[i]), 2048)
        assert sum(r["length"] for r in p) == len(ids[i]) and all(r["length"] == 2048 for r in p[1:])
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [0, *itertools.accumulate(r["length"] for r in s)][:-1] and sum(r["length"] for r in s) <= 2048
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_packed_sequences_hold_the_ids(spark, prose):
    path, slow = tokenizer()
    packed = packing.pack_documents(docs_of(spark, prose), path, packing.Capacity(tokens=256, documents=5), with_ids=True)
    got = packing.sequences(packed).collect()
    assert all(len(r["input_ids"]) == sum(r["doc_lengths"]) <= 256 and len(r["doc_lengths"]) <= 5 for r in got)
    by_doc = {}
    for r in packed.orderBy("doc_id", "piece").collect():
        by_doc.setdefault(r["doc_id"], []).extend(r["ids"])
    assert by_doc == {i: slow.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(prose)}
    assert sorted(x for r in got for x in r["input_ids"]) == sorted(x for ids in by_doc.values() for x in ids)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_respects_every_capacity(rule):
    rnd = random.Random(10)
    capacity = packing.Capacity(tokens=100, documents=4, attention=5000, rule=rule)
    sizes = [rnd.choice([1, 2, 3, 7, 20, 33, 50, 60, 70]) for _ in range(3000)]
    histogram = {n: sizes.count(n) for n in set(sizes)}
    rules, opened = packing.pack(histogram, capacity)
    bins = {}
    for length, rank, n, first, copies, offset in rules.tolist():
        for k in range(n):
            bins.setdefault(first + k // copies, []).append((offset + k % copies * length, length))
    assert sum(map(len, bins.values())) == 3000 and len(bins) == opened
    for n in histogram:
        at = sorted((r[1], r[2]) for r in rules.tolist() if r[0] == n)
        assert [a for a, _ in at] == [0, *itertools.accumulate(c for _, c in at)][:-1] and sum(c for _, c in at) == histogram[n]
    for b in bins.values():
        b.sort()
        assert len(b) <= 4 and sum(n for _, n in b) <= 100 and sum(n * n for _, n in b) <= 5000
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1]
    least = max(math.ceil(sum(sizes) / 100), math.ceil(len(sizes) / 4), math.ceil(sum(n * n for n in sizes) / 5000))
    assert opened <= 1.15 * least
    with pytest.raises(ValueError):
        packing.pack({101: 1}, capacity)


# Top-k


def brute_topk(data, queries_, k=5):
    out = []
    for qid, q in queries_:
        scored = [(-sum(math.floor(256 * float(a)) * math.floor(256 * float(b)) for a, b in zip(q, v)), i) for i, v in data if i != qid and len(v) == len(q)]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rnd = np.random.default_rng(11)
    centres = rnd.normal(size=(12, 16))
    vectors = [(centres[i % 12] + rnd.normal(scale=0.05, size=16)).astype(np.float32).tolist() for i in range(1500)]
    vectors += [vectors[0]] * 20 + [[0.0] * 16] * 3 + [[1.0, -2.0]] * 4
    data = list(enumerate(vectors))
    odd = [(5000, None), (5050, [None] + [1.0] * 15), (5100, [float("nan")] + [1.0] * 15), (5150, [float("inf")] + [0.0] * 15), (5200, [])]
    df = with_extra(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")).repartition(6)
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), topk.Search(block=12, slice=200, leaf=16, fan=6))
    assert rows(got) == sorted(brute_topk(data, [(i, v) for i, v in data if i % 50 == 0]), key=repr)


def test_topk_prunes_and_ranks_exactly():
    rnd = np.random.default_rng(12)
    centres = rnd.normal(size=(40, 8)) * 50
    points = np.floor(np.repeat(centres, 100, 0) + rnd.normal(scale=1, size=(4000, 8)))
    ask = points[::10]
    search = topk.Search(leaf=16)
    best = topk.Answers(len(ask), 5)
    ids = np.arange(4000)
    done = topk.dual_search(topk.CoverTree(ask, search), np.full(len(ask), -1), topk.CoverTree(points, search), ids, best)
    score = (ask @ points.T).astype(np.int64)
    for j in range(len(ask)):
        order = np.lexsort((ids, -score[j]))[:5]
        assert best.id[j].tolist() == order.tolist() and best.score[j].tolist() == score[j][order].tolist()
    assert done < 0.5 * score.size


def test_topk_few_rows_large_values_and_ties(spark):
    def ranked(x):
        df = spark.createDataFrame([(0, [x, 1.0]), (50, [x, 2.0]), (7, [x, 2.0]), (None, [x, 2.0])], "vec_id long, embedding array<double>")
        return rows(topk.top_k(df, df.filter("vec_id % 50 = 0")), "query_id", "rank", "vec_id")

    # beyond doubles' integers the scores are exact, and beyond longs they still rank as the integers they are
    for x in (1.0, 1e7, 1e10, 1e200):
        assert ranked(x) == sorted([(0, 1, 7), (0, 2, 50), (0, 3, None), (50, 1, 7), (50, 2, None), (50, 3, 0)], key=repr)
    digits = [topk._digits(n) for n in (-(10**30), -(10**25) - 1, -(10**25), 10**25, 10**25 + 1, 10**30)]
    assert digits == sorted(digits) and topk._digits(5) is None


def test_cover_tree_levels():
    rnd = np.random.default_rng(14)
    points = np.concatenate([rnd.normal(size=(3, 5))[i % 3] * 100 + rnd.normal(size=(200, 5)) * 10 ** (i % 2) for i in range(6)])
    tree = topk.CoverTree(points, topk.Search(leaf=8))
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (tree.children[:, 1] > 0).sum() > 20
    for n, (a, b) in enumerate(tree.children):
        own = points[tree.order[tree.lo[n] : tree.hi[n]]]
        assert np.isclose(np.sqrt(((own - points[tree.centre[n]]) ** 2).sum(1)).max(), tree.radius[n])
        if b:
            within = 2.0 ** (np.ceil(np.log2(tree.radius[n])) - 1)
            c = points[tree.centre[a:b]]
            gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[np.triu_indices(b - a, 1)]
            assert tree.centre[a] == tree.centre[n] and (gaps > within).all() and (tree.radius[a:b] <= within + 1e-9).all()
            assert tree.lo[a] == tree.lo[n] and tree.hi[b - 1] == tree.hi[n]


def test_topk_holds_one_tile_of_scores():
    """Vectors without structure are one leaf a side; their scores don't lie in memory at once. Repeated vectors tie."""
    rnd = np.random.default_rng(15)
    points = np.floor(rnd.normal(size=(9000, 32)) * 40)[np.arange(9000) % 4500]
    ids, query_ids = rnd.permutation(9000), np.arange(0, 9000, 3)
    at = np.argsort(ids)[query_ids]
    tracemalloc.start()
    parts, done = topk.search_group(query_ids, points[at], ids, points, topk.Search())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done > 0.9 * 3000 * 9000 and peak < 80e6  # as integers these are 216 MB
    got = sorted((q, -s, i) for q, i, s, _ in zip(*parts[0]))
    score = points[at] @ points.T
    score[np.arange(3000), at] = -np.inf
    best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :5]
    assert got == sorted((q, -score[n, c], ids[c]) for n, q in enumerate(query_ids) for c in best[n])


def test_topk_large_values_in_parts(monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 3)
    rnd = np.random.default_rng(16)
    points = np.floor(rnd.normal(size=(40, 4)) * 1e12)
    got = sorted((q, -s, i) for q, i, s, _ in topk._large(np.arange(0, 40, 5), points[::5], np.arange(40), points, 5))
    exact = lambda a, b: sum(int(x) * int(y) for x, y in zip(points[a], points[b]))
    clamped = lambda s: max(topk.NONE + 1, min(topk.LAST_ID, s))
    want = [(q, i) for q in range(0, 40, 5) for i in sorted((i for i in range(40) if i != q), key=lambda i: (-exact(q, i), i))[:5]]
    assert got == sorted((q, -clamped(exact(q, i)), i) for q, i in want)


def test_topk_groups_of_wide_vectors_are_smaller(spark, monkeypatch):
    """Groups are bounded by components, not rows alone, and give the same rows."""
    rnd = np.random.default_rng(17)
    data = [(i, rnd.normal(size=128).tolist()) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    found, seen = topk._group, spark.sparkContext.accumulator(0)

    def counted(search):
        run = found(search)

        def group(data, asked):
            assert len(data) < 60, len(data)
            seen.add(1)
            return run(data, asked)

        return group

    monkeypatch.setattr(topk, "_group", counted)
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), topk.Search(slice=60))
    assert rows(got) == sorted(brute_topk(data, [(i, v) for i, v in data if i % 50 == 0]), key=repr) and seen.value >= 10


# Mixing


def brute_ipf(weights, goals, rounds=500):
    """Classical proportional fitting of a table of three margins."""
    w = weights.copy()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            other = tuple(a for a in range(3) if a != axis)
            sums = w.sum(axis=other)
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * np.divide(goal, sums, out=np.ones_like(goal), where=sums > 0).reshape(shape)
    return w


def test_raking_equals_classical_fitting(spark):
    rnd = np.random.default_rng(13)
    tokens = rnd.integers(50, 200, size=(4, 3, 2)).astype(float)
    mix = mixing.Mix(rate=0.2, smoothing=0.5, steps=500)
    cells = [(f"s{i}", f"l{j}", f"t{k}") for i in range(4) for j in range(3) for k in range(2)]
    p = mixing.rake(cells, tokens.ravel(), mix)
    goals = []
    for axis in range(3):
        m = np.sqrt(tokens.sum(axis=tuple(a for a in range(3) if a != axis)))
        goals.append(0.2 * tokens.sum() * m / m.sum())
    assert np.allclose(p * tokens.ravel(), brute_ipf(0.2 * tokens, goals).ravel(), rtol=1e-6)
    df = spark.createDataFrame([(*c, int(n)) for c, n in zip(cells, tokens.ravel())], "__source string, __lang string, __topic string, tokens long")
    far = mixing.rake_distributed(df, mixing.Mix(rate=0.2, steps=6), Scratch(spark)).select(*(f"__{m}" for m in mixing.MARGINS), "p").collect()
    near = dict(zip(cells, mixing.rake(cells, tokens.ravel(), mixing.Mix(rate=0.2, steps=6))))
    assert all(abs(near[tuple(r[:3])] - r["p"]) < 1e-9 for r in far)


def test_raking_holds_what_is_used_up():
    cells = [("a", "x", "t"), ("b", "x", "t")]
    p = mixing.rake(cells, np.array([10.0, 990.0]), mixing.Mix(rate=0.5, targets={"source": {"a": 0.5, "b": 0.5}}))
    assert p[0] == 1.0 and 0 < p[1] <= 1.0


def test_mixing_documents(spark):
    rnd = random.Random(14)
    data = [(i, " ".join(["w"] * rnd.randint(1, 40)), rnd.choice(["en", "en", "en", "fr"]), "big" if i % 4 else f"s{i % 3}", None) for i in range(4000)] + [(None, None, None, None, None), (9, "", "en", "big", 0)]
    df = with_extra(spark.createDataFrame(data, DOCS))
    mix = mixing.Mix(rate=0.4, targets={"source": {"big": 0.4, "s0": 0.2, "s1": 0.2, "s2": 0.2}, "lang": {"en": 0.6, "fr": 0.4, None: 0.0}, "topic": {mixing.OTHERS: 1.0}})
    got = mixing.mix_documents(df, mix).collect()
    kept = [r for r in got if r["kept"]]
    total = sum(r["n_tokens"] for r in got)
    assert len(got) == len(data)
    for column, want in (("source", mix.targets["source"]), ("lang", mix.targets["lang"])):
        for value, share in want.items():
            found = sum(r["n_tokens"] for r in kept if r[column] == value) / (0.4 * total)
            assert abs(found - share) < 0.05, (value, found)
    again = {(r["doc_id"], r["n_tokens"]): r["kept"] for r in mixing.mix_documents(df.repartition(7), mix).collect()}
    assert all(again[r["doc_id"], r["n_tokens"]] == r["kept"] for r in got)
    sample = mixing.sample_mix(df, mix)
    assert sample.columns == df.columns and sample.count() == len(kept)


def test_targets_of_named_and_other_categories(spark):
    mix = mixing.Mix(targets={"source": {"a": 3.0, None: 1.0, mixing.OTHERS: 4.0}})
    shares = mixing.target_shares(["a", "b", None, "c"], np.array([10.0, 100.0, 50.0, 900.0]), "source", mix)
    assert np.allclose(shares, [3 / 8, 4 / 8 * 10 / 40, 1 / 8, 4 / 8 * 30 / 40])
    rnd = np.random.default_rng(22)
    tokens = rnd.integers(50, 200, size=(4, 3)).astype(float)
    cells = [(s, lang, "t") for s in ("a", "b", None, "(none)") for lang in ("x", "y", None)]
    some = mixing.Mix(rate=0.2, steps=5, targets={"source": {"a": 3.0, None: 1.0, mixing.OTHERS: 4.0}})
    near = dict(zip(cells, mixing.rake(cells, tokens.ravel(), some)))
    df = spark.createDataFrame([(*c, int(n)) for c, n in zip(cells, tokens.ravel())], "__source string, __lang string, __topic string, tokens long")
    far = {tuple(r[:3]): r["p"] for r in mixing.rake_distributed(df, some, Scratch(spark)).select("__source", "__lang", "__topic", "p").collect()}
    assert set(far) == set(near) and all(abs(near[c] - p) < 1e-9 for c, p in far.items())


def test_topics_follow_subjects_not_languages(spark):
    """Two languages, two subjects each: topics tell subjects apart within each language, though languages differ more."""
    rnd = random.Random(23)
    data = []
    for i in range(400):
        lang, subject = "ab"[i % 2], i // 2 % 2
        words = [f"{lang}{rnd.randrange(30)}" for _ in range(60)] + [f"{lang}s{subject}w{rnd.randrange(15)}" for _ in range(25)]
        data.append((i, " ".join(words), lang, "s", None))
    mix = mixing.Mix(topics=mixing.Topics(groups=4, sample=300))
    got = mixing.mix_documents(spark.createDataFrame(data, DOCS), mix).collect()
    for lang in "ab":
        of = [{r["topic"] for r in got if r["lang"] == lang and r["doc_id"] // 2 % 2 == subject} for subject in (0, 1)]
        assert of[0] and of[1] and of[0].isdisjoint(of[1])


def test_mixing_keeps_columns_of_any_name(spark):
    df = docs_of(spark, ["a b c d"] * 40).withColumns({"__source": F.lit("mine"), "__mix_source": F.lit("too"), "__p": F.lit(3), "tokens": F.lit(5)})
    kept = mixing.sample_mix(df)
    assert kept.columns == df.columns and {(r["__source"], r["__mix_source"], r["tokens"]) for r in kept.collect()} <= {("mine", "too", 5)}


@needs_tables
def test_registered_mixture_meets_its_targets(spark):
    got = queries.queries()["op9_mixing"](spark, SF2).collect()
    total = sum(r["n_tokens"] for r in got)
    cells = {}
    for r in got:
        cells.setdefault((r["source"], r["lang"], r["topic"]), []).append(r["n_tokens"])
    keys = sorted(cells, key=repr)
    p = mixing.rake(keys, np.array([sum(cells[k]) for k in keys], dtype=float), queries.MIX)
    chance = dict(zip(keys, p))
    assert all(abs(chance[r["source"], r["lang"], r["topic"]] - r["probability"]) < 1e-9 for r in got)
    for lang, share in (("en", 0.5), ("fr", 0.15), ("de", 0.15)):
        expected = sum(r["probability"] * r["n_tokens"] for r in got if r["lang"] == lang)
        assert abs(expected / (0.5 * total) - share / 0.95) < 0.06
    assert len({r["topic"] for r in got}) >= 6


# Repeated rows and very long texts


def test_repeated_rows_get_equal_results(spark):
    base = docs_of(spark, ["You are a fine fellow. It was a good day.", "le chat et le chien", "", None, "#a b *c\n" * 30])
    df = base.union(base)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.x/", "<p>one</p>")] * 3, "page_id long, url string, html string")
    for out, n in ((toxicity.detect(df, labels), 10), (language.identify(df), 10), (quality.assess(df), 10), (html.extract(pages), 3)):
        got = rows(out)
        assert len(got) == n and all(got.count(r) >= 2 for r in got)


def test_very_long_texts(spark):
    """Two million characters in one word, in one line, and in many words."""
    texts = ["a" * 2_000_000, "word " * 400_000, "\n" * 2_000_000, " ".join(f"w{i}" for i in range(250_000))]
    df = docs_of(spark, texts)
    path, slow = tokenizer()
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.detect(df, labels).count() == 4 and language.identify(df).count() == 4
    assert {r["doc_id"]: r["n_words"] for r in quality.assess(df).collect()} == {0: 1, 1: 400_000, 2: 0, 3: 250_000}
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.repeated_words(df).collect()}
    assert found == {0: (1, 0), 1: (400_000, 399_999), 2: (0, 0), 3: (250_000, 0)}
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df).collect()} == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert near_copies.keep_distinct(df).count() == 4 and mixing.mix_documents(df).count() == 4
    packed = {r["doc_id"]: r["n"] for r in packing.pack_documents(df, path).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    page = spark.createDataFrame([(1, "http://a.x/", "<p>" + texts[1] + "</p>" + "<div>" * 200_000)], "page_id long, url string, html string")
    assert html.extract(page).first()["n_chars"] == 5 * 400_000 - 1


# Empty tables


def test_empty_tables(spark):
    docs = with_extra(spark.createDataFrame([], DOCS))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path, _ = tokenizer()
    for df in (
        toxicity.detect(docs, labels), language.identify(docs), quality.assess(docs), quality.clean(docs), simhash.near_duplicates(docs), simhash.keep_representatives(docs), substring.repeated_words(docs),
        substring.remove_repeats(docs), mixing.mix_documents(docs), mixing.sample_mix(docs), packing.pack_documents(docs, path), rollup.maintained_totals(docs),
        html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none).collect() == []


def test_null_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    path, _ = tokenizer()
    assert simhash.near_duplicates(docs).count() == 3 and simhash.keep_representatives(docs).count() == 1
    assert rows(substring.repeated_words(docs), "n_words") == [(0,)] * 3
    assert quality.assess(docs).filter("base_failed AND NOT kept").count() == 3
    assert packing.pack_documents(docs, path).count() == 3 and mixing.mix_documents(docs).filter("kept").count() == 3
    assert rows(rollup.maintained_totals(docs)) == [(None, None, "bytes-1", 3, 0), (None, None, "words-2", 3, 0)]
