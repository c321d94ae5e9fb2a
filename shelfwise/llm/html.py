"""Main text of web pages by site style trees.

Pages are parsed to their block elements (inline elements are part of the text around them). The pages of a host are
merged: elements with the same path of tags and classes are one node of the host's style tree. A node's presentation
importance is the entropy, to the base of its page count, of the sequences of children it has over the pages; its
content importance is what is left of 1 after the mean entropy of its text blocks over the pages, so text that most
pages share scores near 0 and text of one page scores 1. Nodes seen on fewer than `Rules.least_pages` pages count as
text of one page in one presentation. On a page, an element's importance is that of its own text and of its children,
weighted by the length of their text, and of its presentation by the share `Rules.presentation`.

A branch goes if its own importance and that of all its descendants are under a threshold. An element that names itself
as something else than content (navigation, forms, adverts, comments, ...) has `Rules.against` taken off, so it stays
only where it is more than text of its own: in many presentations. An element that such a name is part of a longer one
names nothing. A wrapper that names itself so but holds the article (of several articles, those inside the fewest such
elements count) stays without its own text. Elements that aren't shown go. On pages with an article, text outside stays
only where its node is known on `Rules.least_pages` pages and has a content importance of `Rules.outside` or more;
inside, the threshold is lowered to half of the article's own score where that is less, so that an article whose pages
are copied widely loses nothing but what is lower than the rest of it.

Two parses, no shuffle of pages: what is shuffled are counts by host, node and feature, summed map-side first, so a
host with a third of all pages costs as much as its distinct nodes and blocks.

Rows: null or empty html gives the empty text; pages without a host form a site of their own; broken markup never
fails (an open element ends with the page). Repeated rows are extracted one by one, and counted as pages of the site.
Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns, session_of

#: Elements whose content is no text.
SILENT = "script|style|noscript|template|iframe|object|svg|math|canvas|title|textarea|select|button|audio|video"
#: Elements that end a text block; all others are inline.
BLOCKS = frozenset(
    "html head body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset details summary address hr dialog menu center".split()
)
#: Elements without content.
VOID = frozenset("br hr img meta link input area base col embed source track wbr param".split())
#: Elements that an opening element of the right side ends.
ENDS = {
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "head": frozenset(("body",)),
}
#: Elements, roles and words of class or id that name something else than content.
NOISE_TAGS = frozenset("head nav footer aside form menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing "
    "related recommended comment comments reply replies disqus widget pagination pager skip toolbar search".split()
)
#: What may stand beside such words in a name without telling something else.
AFFIXES = frozenset("area bar block bottom box button buttons container content global inner left links list main outer page primary right secondary section site slot top unit wrap wrapper zone".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_ROLES = frozenset(("article", "main"))

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})\b[^>]*+>.*?(?:</(?P=silent)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Rules:
    threshold: float = 0.4
    outside: float = 0.8
    presentation: float = 0.3
    against: float = 0.5
    least_pages: int = 3
    most_broadcast: int = 200_000


#: Priors: what isn't shown, what names itself as something else, all others, the article.
HIDDEN, AGAINST, PLAIN, ARTICLE = -2, -1, 0, 1


class Node:
    __slots__ = ("tag", "path", "prior", "children", "texts")

    def __init__(self, tag: str, path: int, prior: int):
        self.tag, self.path, self.prior, self.children, self.texts = tag, path, prior, [], []


def _names_noise(value: str, within: bool) -> bool:
    """Whether one of the class or id names is a word against content, alone or with affixes and numbers only."""
    for name in value.split():
        words = {w for w in SPLIT.split(name) if w and not w.isdigit()} - AFFIXES
        if words and words <= NOISE_WORDS and not (within and "header" in words):
            return True
    return False


def _prior(tag: str, attrs: str, within: bool) -> tuple[int, str]:
    """(prior, style): style is what tells elements of a kind apart."""
    if tag in CONTENT_TAGS:
        prior = ARTICLE
    else:
        prior = AGAINST if tag in NOISE_TAGS or (tag == "header" and not within) else PLAIN
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return prior, tag
    style = tag
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), entities.unescape(value.strip("\"'")).lower()
        if name in ("class", "id"):
            if name == "class":
                style += "." + re.sub(r"\d+", "#", value)
            if prior > HIDDEN and _names_noise(value, within):
                prior = AGAINST
        elif name == "role":
            prior = min(prior, AGAINST) if value in NOISE_ROLES else ARTICLE if value in CONTENT_ROLES and prior == PLAIN else prior
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            prior = HIDDEN
    return prior, style


def parse(page: str) -> tuple[Node, bool]:
    """The tree of block elements, and whether an element is marked as the article. Text blocks are strings and stand
    among the children in page order."""
    root = Node("", 0, 0)
    stack, text, articles, within = [root], [], False, 0
    open_tags: dict[str, int] = {}

    def flush():
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                stack[-1].children.append(block)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append("\n")
        if tag not in BLOCKS:
            continue
        flush()
        if m["end"]:
            while open_tags.get(tag):
                closed = stack.pop()
                open_tags[closed.tag] -= 1
                within -= closed.prior > 0
                if closed.tag == tag:
                    break
            continue
        while stack[-1].tag in ENDS and tag in ENDS[stack[-1].tag]:
            closed = stack.pop()
            open_tags[closed.tag] -= 1
            within -= closed.prior > 0
        prior, style = _prior(tag, m["attrs"] or "", within > 0)
        node = Node(tag, xxhash.xxh3_64_intdigest(style, stack[-1].path) >> 1, prior)
        articles |= prior > 0
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            within += prior > 0
    if at < len(page):
        text.append(page[at:])
    flush()
    return root, articles


def nodes(root: Node):
    queue = [root]
    while queue:
        n = queue.pop()
        yield n
        queue += (c for c in n.children if not isinstance(c, str))


def site_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _features(batches):
    """(site, path, kind, feature, n): in how many pages of the batch a node has a sequence of children (kind 0) or a
    text block (kind 1)."""
    for b in batches:
        seen: dict = {}
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            site, own = site_of(url), set()
            for n in nodes(parse(page or "")[0]):
                tags = [c.path for c in n.children if not isinstance(c, str)]
                own.add((n.path, 0, xxhash.xxh3_64_intdigest(repr(tags)) >> 1))
                own.update((n.path, 1, xxhash.xxh3_64_intdigest(c) >> 1) for c in n.children if isinstance(c, str))
            for x in own:
                seen[(site, *x)] = seen.get((site, *x), 0) + 1
        cols = list(zip(*seen)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(cols[i], pa.int64()) for i in (1, 2, 3)), pa.array(list(seen.values()), pa.int64())], names=["site", "path", "kind", "feature", "n"])


def _paths(batches):
    """(mark, site, path): the nodes of each page; their number bounds what a page gathers."""
    for b in batches:
        mark, site, path = [], [], []
        for k, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            own = {n.path for n in nodes(parse(page or "")[0])}
            mark += [k] * len(own)
            site += [site_of(url)] * len(own)
            path += own
        yield pa.RecordBatch.from_arrays([pa.array(mark, pa.int64()), pa.array(site, pa.string()), pa.array(path, pa.int64())], names=["mark", "site", "path"])


def style_trees(pages: DataFrame) -> DataFrame:
    """site, path, pages, presentation, content: the importances of each node of each host's tree."""
    session_of(pages)
    counts = pages.select("url", "html").mapInArrow(_features, "site string, path long, kind long, feature long, n long").groupBy("site", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    sums = counts.groupBy("site", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("style"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("blocks"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("shared"),
    )
    base = F.log("pages")
    # Entropy of counts n out of m: log m - sum(n log n) / m. A block on n pages has entropy log n.
    return sums.select(
        "site", "path", "pages",
        F.when(F.col("pages") > 1, (base - F.col("style") / F.col("pages")) / base).otherwise(1.0).alias("presentation"),
        F.when((F.col("pages") > 1) & (F.col("blocks") > 0), 1 - F.col("shared") / F.col("blocks") / base).otherwise(1.0).alias("content"),
    )


def _around_articles(root: Node) -> set[int]:
    """The elements around the articles that the fewest elements with a word against them hold."""
    found, stack = [], [(root, 0, ())]
    while stack:
        n, against, above = stack.pop()
        if n.prior > 0:
            found.append((against, above))
            continue
        above = (id(n), above)
        stack += [(c, against + (n.prior < 0), above) for c in n.children if not isinstance(c, str)]
    least, out = min((against for against, _ in found), default=0), set()
    for against, above in found:
        while against == least and above and above[0] not in out:
            out.add(above[0])
            above = above[1]
    return out


def extract_one(page: str | None, tree: dict, rules: Rules) -> str:
    """tree: (pages, presentation, content) by path, for the page's host."""
    if not page:
        return ""
    root, articles = parse(page)
    order = list(nodes(root))
    unknown = (0, 0.0, 1.0)  # text of one page, in one presentation
    known: dict = {}
    for n in reversed(order):  # children come after their parents in order
        m, style, content = tree.get(n.path, unknown)
        if m < rules.least_pages:
            m, style, content = unknown
        total = length = best = 0.0
        for c in n.children:
            size, imp, top = (len(c), content, 0.0) if isinstance(c, str) else known[id(c)][:3]
            total, length, best = total + size * imp, length + size, max(best, top)
        inner = total / length if length else content
        own = (1 - rules.presentation) * inner + rules.presentation * style
        known[id(n)] = (length, own, max(own, best), content if m else 0.0)
    spared = _around_articles(root) if articles else set()
    out: list[str] = []

    stack = [(root, False, rules.threshold, 0)]
    while stack:
        n, within, least, k = stack.pop()
        best = known[id(n)][2]
        if k == 0 and n.path and id(n) not in spared:
            if n.prior == ARTICLE and not within:
                within, least = True, min(least, best / 2)
            elif n.prior == HIDDEN or best + min(n.prior, 0) * rules.against < least:
                continue
        for i in range(k, len(n.children)):
            c = n.children[i]
            if isinstance(c, str):
                if within or not articles or n.prior >= 0 and known[id(n)][3] >= rules.outside:
                    out.append(c)
            else:
                stack += [(n, within, least, i + 1), (c, within, least, 0)]
                break
    return " ".join(out)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    spark = session_of(pages)
    scratch = Scratch(spark)
    trees = scratch.write(style_trees(pages).filter(F.col("pages") >= rules.least_pages), "trees")
    source = pages.select("page_id", "url", "html")
    fields = [("text", T.StringType()), ("n_chars", T.LongType())]

    def made(texts: list[str]):
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    if trees.count() <= rules.most_broadcast:
        by_site: dict = {}
        for r in trees.collect():
            by_site.setdefault(r["site"], {})[r["path"]] = (r["pages"], r["presentation"], r["content"])
        shared = spark.sparkContext.broadcast(by_site)
        out = add_columns(source, lambda url, page: made([extract_one(p, shared.value.get(site_of(u), {}), rules) for u, p in zip(url.to_pylist(), page.to_pylist())]), ["url", "html"], fields, keep=["page_id", "url"])
    else:  # more nodes than may be broadcast: each page meets the scores of its own nodes
        marked = source.withColumn("mark", F.xxhash64("page_id", "url", "html"))
        wanted = marked.select("mark", "url", "html").dropDuplicates(["mark"]).mapInArrow(_paths, "mark long, site string, path long")
        scores = wanted.join(trees, ["site", "path"]).groupBy("mark").agg(F.collect_list(F.struct("path", "pages", "presentation", "content")).alias("tree"))
        joined = marked.join(scores, "mark", "left")

        def run(page, tree):
            return made([extract_one(p, {x["path"]: (x["pages"], x["presentation"], x["content"]) for x in t or ()}, rules) for p, t in zip(page.to_pylist(), tree.to_pylist())])

        out = add_columns(joined, run, ["html", "tree"], fields, keep=["page_id", "url"])
    return out.select("page_id", "url", "text", "n_chars")
