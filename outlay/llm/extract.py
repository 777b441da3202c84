"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

Every element of a page gets features: text, link and punctuation density of its subtree,
its depth, its siblings, its own and its ancestors' tag and attribute tokens (hashed; no list of
words says what a token means). Boosted trees give
the chance that it belongs to the main text. Decoding is a best assignment over the whole
tree with three states, *around*, *kept* and *dropped*: around may hold any, kept may hold kept or
dropped, dropped holds only dropped. So no kept node stands below a dropped one, and main
text is always a part of a main node.

Training: up to ``SAMPLE`` pages, chosen by a hash of page_id, whose single <article> marks the
main nodes, and twice as many (200 at least) composed from their words with the parts listed in ``PARTS``, whose
nodes are known by how they were made. Of a real page, what stands in the article below an element
with attributes or a part's tag may be either, so such nodes are not learnt from.
The trees are fitted by Spark ML and read into arrays; each page is parsed, scored and
decoded in its own task, without a shuffle.

Blocks are the text between block-level tags; white space in them becomes one space
(a <br> is white space), they are trimmed and joined by one newline. Defined results: null
or empty html gives an empty text; broken markup is read as far as it goes; repeated rows
stay; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 150
ROUNDS = 30
DEPTH = 4

# Fixed values of the HTML standard and of common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text of a page: code, styles, the head, what stands for a frame, the values of form controls.
UNSEEN = frozenset("script style head title template iframe select option button textarea".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "a", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "span", "b"]
#: Buckets that attribute tokens are hashed to.
BUCKETS = 64
_WORD = re.compile(r"[a-z]+")

FEATURES = [f"tag_{t}" for t in TAGS] + "chrome_above article_above depth children text own_text link_share punctuation per_tag place siblings sibling_text paragraph_share".split() + [f"{who}_{i}" for who in ("own", "above") for i in range(BUCKETS)]
_OWN_AT = len(FEATURES) - 2 * BUCKETS
_CHROME = {"nav", "header", "footer", "aside", "form"}


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


class Node:
    __slots__ = ("attrs", "children", "features", "index", "parent", "state", "tag")

    def __init__(self, tag: str, attrs: set[str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Builder(HTMLParser):
    """An element tree with text; unclosed and misplaced tags are read as browsers do, roughly."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", set(), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag not in ("html", "body"):
            self._close({"p"}, {"table", "td", "th", "div", "section", "article", "blockquote", "li"})
        if tag in CLOSES:
            self._close(CLOSES[tag], {"ul", "ol", "dl", "table"})
        words = {w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v.lower())}
        node = Node(tag, words, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def _close(self, tags: set[str], until: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def walk(root: Node) -> list[Node]:
    """Elements whose text can be seen, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(out)
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in UNSEEN and c.tag not in VOID]
    return out


def node_features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    own, links, marks, tags, paragraphs = ([0] * n for _ in range(5))
    up = [0] * n
    for k, node in enumerate(nodes):
        up[k] = node.parent.index if node.parent is not None and k else 0
        for c in node.children:
            if isinstance(c, str):
                own[k] += len(c.split()) and len(c)
                marks[k] += c.count(".") + c.count(",")
    text = own[:]
    for k in range(n - 1, 0, -1):
        node, p = nodes[k], up[k]
        if node.tag == "a":
            links[k] = text[k]
        text[p] += text[k]
        links[p] += links[k]
        marks[p] += marks[k]
        tags[p] += tags[k] + 1
        paragraphs[p] += node.tag == "p"
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    flags = [(False, False)] * n
    tokens, above_tokens = [frozenset()] * n, [frozenset()] * n
    depth = [0] * n
    tag_at = {t: i for i, t in enumerate(TAGS)}
    place, kin = [0] * n, [1] * n
    for node in nodes:
        seen = [c.index for c in node.children if isinstance(c, Node) and c.tag not in UNSEEN and c.tag not in VOID]
        for i, k in enumerate(seen):
            place[k], kin[k] = i, len(seen)
    for k, node in enumerate(nodes):
        above = flags[up[k]]
        if k:
            depth[k] = depth[up[k]] + 1
            own_above = tokens[up[k]]
            above_tokens[k] = above_tokens[up[k]] if own_above <= above_tokens[up[k]] else above_tokens[up[k]] | own_above
        flags[k] = (above[0] or node.tag in _CHROME, above[1] or node.tag in ("article", "main"))
        if node.attrs:
            tokens[k] = frozenset(map(_bucket, node.attrs))
            out[k, [_OWN_AT + i for i in tokens[k]]] = 1
        if above_tokens[k]:
            out[k, [_OWN_AT + BUCKETS + i for i in above_tokens[k]]] = 1
        if node.tag in tag_at:
            out[k, tag_at[node.tag]] = 1
        kids = sum(isinstance(c, Node) for c in node.children)
        out[k, len(TAGS) : _OWN_AT] = (
            *above, depth[k], math.log1p(kids), math.log1p(text[k]), math.log1p(own[k]), links[k] / (text[k] + 1), marks[k] / (text[k] + 1),
            text[k] / (tags[k] + 1), place[k] / kin[k], math.log1p(kin[k]), math.log1p(text[up[k]] - text[k]) if k else 0, paragraphs[k] / (kids + 1),
        )
    return out


AROUND, KEPT, DROPPED = 0, 1, 2


def decode(nodes: list[Node], chance: np.ndarray) -> None:
    """The best consistent states: each node's log-likelihood summed over the tree."""
    p = np.clip(chance.astype(float), 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    best = [[no[k], yes[k], no[k]] for k in range(len(nodes))]
    for k in range(len(nodes) - 1, 0, -1):
        a, b, c = best[k]
        up = best[nodes[k].parent.index]
        up[AROUND] += max(a, b, c)
        up[KEPT] += max(b, c)
        up[DROPPED] += c
    for k, node in enumerate(nodes):
        a, b, c = best[k]
        above = node.parent.state if k else AROUND
        if above == DROPPED:
            node.state = DROPPED
        elif above == KEPT:
            node.state = KEPT if b >= c else DROPPED
        else:
            node.state = AROUND if k == 0 or (a >= b and a >= c) else KEPT if b >= c else DROPPED


def main_text(root: Node) -> str:
    """The kept nodes' text, block by block."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        if line:
            blocks.append(line)
        held.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            held.append(x[0])
        elif x.tag in VOID:
            held.append(" ")
        elif x.tag not in UNSEEN:
            block = x.tag in BLOCK or x.state != KEPT
            if block:
                flush()
                todo.append(None)
            todo += [((c,) if isinstance(c, str) else c) for c in reversed(x.children) if not isinstance(c, str) or x.state == KEPT]
    flush()
    return "\n".join(blocks)


# ---- training ------------------------------------------------------------------------------

#: Openings of a composed page's main part and of its other parts, with the kind of content; "~": one of the kind's tokens.
MAIN = ['<article>', '<article>', '<main>', '<div id="~">', '<div class="~">', '<div class="~ ~">', '<section class="~">', '<article class="~">', '<div role="main">']
MAIN_TOKENS = "article content main post entry story body text maincontent prose page copy".split()
PARTS = [
    ('<nav>', "links", ""), ('<nav class="~">', "links", "nav"), ('<div class="~">', "links", "nav"), ('<ul class="~">', "links", "nav"), ('<header>', "line", ""), ('<div class="~">', "line", "head"),
    ('<div class="~">', "text", "ad"), ('<div class="~">', "text", "ad"), ('<aside>', "text", ""), ('<aside class="~">', "text", "side"), ('<div id="~">', "links", "side"), ('<div class="~">', "text", "side"),
    ('<div class="~">', "text", "notice"), ('<form>', "text", ""), ('<form class="~">', "text", "form"), ('<div class="~">', "text", "form"), ('<div class="~">', "links", "share"),
    ('<section id="~">', "talk", "talk"), ('<div class="~">', "talk", "talk"), ('<footer>', "line", ""), ('<div id="~">', "text", "foot"), ('<div class="~">', "line", "foot"),
]
PART_TOKENS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toolbar pagination pager tags".split(), "head": "header head masthead banner top".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion".split(), "side": "sidebar side widget related aside".split(),
    "notice": "notice alert cookie cookies consent popup modal legal copyright".split(), "form": "login search form subscribe newsletter signup".split(),
    "share": "share social follow related".split(), "talk": "comment comments reply replies discussion disqus".split(), "foot": "footer foot copyright legal".split(),
}


def _compose(rng: random.Random, words: list[str]) -> tuple[Node, set[int]]:
    """A page of main text with other parts around and inside it; and the main nodes' indices."""
    some = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b))) + "."
    close = lambda tag: f"</{_WORD.search(tag)[0]}>"

    def named(tag: str, tokens: list[str]) -> str:
        while "~" in tag:
            tag = tag.replace("~", rng.choice(tokens), 1)
        return tag

    def part() -> str:
        tag, kind, tokens = rng.choice(PARTS)
        tag = named(tag, PART_TOKENS.get(tokens, []))
        body = {
            "links": lambda: "<ul>" + "".join(f'<li><a href="/">{some(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>",
            "line": lambda: "&copy; " + some(2, 12),
            "text": lambda: rng.choice(["", "<p>"]) + some(4, 60),
            "talk": lambda: "".join(f'<div class="comment"><p>{some(5, 60)}</p></div>' for _ in range(rng.randint(1, 4))),
        }[kind]()
        return f'{tag}{body}{close(tag)}'.replace(">", ' data-x="0">', 1)

    def paragraph() -> str:
        return rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<p>{} <a href='/'>x</a></p>", "<blockquote>{}</blockquote>", "<div>{}</div>"]).format(some(2, 90))

    tag = named(rng.choice(MAIN), MAIN_TOKENS)
    inside = [f"<h1>{some(2, 8)}</h1>"] * rng.randint(0, 1) + [paragraph() for _ in range(rng.randint(1, 9))] + [part() for _ in range(rng.choice([0, 0, 1, 2]))]
    rng.shuffle(inside)
    before, after = ["".join(part() for _ in range(rng.randint(0, 4))) for _ in range(2)]
    wrap = rng.choice(["{}", "<div>{}</div>", '<div id="wrapper"><div class="row">{}</div></div>'])
    page = f"<html><body>{wrap.format(before + tag.replace('>', ' data-main=1>', 1) + ''.join(inside) + close(tag) + after)}</body></html>"
    marker = _Marker()
    marker.feed(page)
    marker.close()
    return marker.root, marker.main_nodes()


class _Marker(_Builder):
    """Knows composed parts by their marks."""

    def __init__(self) -> None:
        super().__init__()
        self.begins, self.other = [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        keys = {k for k, _ in attrs}
        if "data-main" in keys:
            self.begins.append(self.at)
        elif "data-x" in keys:
            self.other.append(self.at)

    def main_nodes(self) -> set[int]:
        return _inside(walk(self.root), self.begins, self.other)


def _inside(nodes: list[Node], begins: list[Node], other: list[Node]) -> set[int]:
    state = {}
    for node in nodes:
        above = state.get(id(node.parent), 0)
        state[id(node)] = 2 if above == 2 or any(node is x for x in other) else 1 if above == 1 or any(node is x for x in begins) else 0
    return {n.index for n in nodes if state[id(n)] == 1}


def training_nodes(pages: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of marked pages and of composed ones."""
    rng = random.Random(seed)
    x, y = [], []
    words: list[str] = []
    for html in pages:
        root = parse(html)
        nodes = walk(root)
        begins = [n for n in nodes if n.tag == "article"]
        if len(begins) == 1:
            main = _inside(nodes, begins, [])
            unsure = main - _inside(nodes, begins, [n for n in nodes if n is not begins[0] and (n.attrs or n.tag in _CHROME)])
            known = [n.index for n in nodes if n.index not in unsure]
            x.append(node_features(nodes)[known])
            y.append([k in main for k in known])
            words += "".join(c for n in nodes for c in n.children if isinstance(c, str)).split()[:500]
    for _ in range(max(200, 2 * len(x))):
        root, main = _compose(rng, words or ["text", "word", "line", "and", "more"])
        nodes = walk(root)
        x.append(node_features(nodes))
        y.append([n.index in main for n in nodes])
    return np.concatenate(x), np.concatenate(y).astype(float)


class Trees:
    """A boosted ensemble as arrays: leaves are nodes that are their own children."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float]) -> None:
        self.trees, self.weights = trees, weights

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, cut, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = np.where(x[np.arange(len(x)), feature[at]] <= cut[at], left[at], right[at])
            total += w * value[at]
        return 1 / (1 + np.exp(-2 * total))


def _arrays(root) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    rows: list[list[float]] = []

    def add(node) -> int:  # noqa: ANN001
        k = len(rows)
        rows.append([0, math.inf, k, k, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[k][:2] = split.featureIndex(), split.threshold()
            rows[k][2] = add(node.leftChild())
            rows[k][3] = add(node.rightChild())
        return k

    add(root)
    a = np.array(rows)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def train(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits the trees on the nodes of a bounded sample of pages."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = pages.sparkSession
    marked = pages.where("html like '%<article%' and page_id is not null").select("page_id", "html")
    # ids alone are ordered first: each task sends the driver its own `sample` rows
    chosen = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    texts = marked.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    x, y = training_nodes([r["html"] for r in sorted(texts.collect(), key=lambda r: r["page_id"])])
    nodes = spark.createDataFrame(pd.DataFrame({"x": x.astype(float).tolist(), "label": y})).coalesce(2)
    model = GBTClassifier(featuresCol="v", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=5, minInstancesPerNode=5).fit(nodes.select(array_to_vector("x").alias("v"), "label"))
    return Trees([_arrays(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 100):
                part = pdf.iloc[at : at + 100]
                roots = [parse(h) for h in part["html"]]
                nodes = [walk(r) for r in roots]
                chance = shared.value.chance(np.concatenate([node_features(n) for n in nodes]))
                first, texts = 0, []
                for root, own in zip(roots, nodes, strict=True):
                    decode(own, chance[first : first + len(own)])
                    first += len(own)
                    texts.append(main_text(root))
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # pandas would make floats of numbers beside nulls: ids go as text
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
