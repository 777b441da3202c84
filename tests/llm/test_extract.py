"""Main text: held-out composed pages, the given pages against their markup, very long pages."""

import html
import random
import re

import pytest

from outlay.llm import extract


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return extract.train(pages)


def by_markup(page):
    """The text of a page's one article, without its advert, block by block."""
    body = re.search(r"<article[^>]*>(.*)</article>", page, re.S)[1]
    body = re.sub(r'<!--.*?-->|<(script|style)\b.*?</\1>', "", body, flags=re.S)
    body = re.sub(r'<div class="ad">.*?</div>', "\0", body, flags=re.S)
    body = re.sub(r"</?(?:p|h1|ul|li|div)[^>]*>", "\0", re.sub(r"\s+", " ", re.sub(r"<br\s*/?>", " ", body)))
    lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]+>", "", body).split("\0"))
    return "\n".join(x for x in lines if x)


def test_given_pages(pages, trees):
    source = {r["page_id"]: r["html"] for r in pages.collect() if r["html"] and r["html"].count("<article") == 1}
    got = {r["page_id"]: r["text"] for r in extract.extract(pages, trees).collect()}
    assert len(source) > 10 and all(got[i] == by_markup(h) for i, h in source.items())


def test_held_out_composed_pages(trees):
    rng, hit, kept, main_nodes = random.Random(12345), 0, 0, 0
    for _ in range(150):
        root, main = extract._compose(rng, "ab cd ef gh ij kl mn op qr st uv wx yz".split())
        nodes = extract.walk(root)
        extract.decode(nodes, trees.chance(extract.node_features(nodes)))
        own = {n.index for n in nodes if n.state == extract.KEPT}
        hit, kept, main_nodes = hit + len(own & main), kept + len(own), main_nodes + len(main)
    precision, recall = hit / kept, hit / main_nodes
    assert 2 * precision * recall / (precision + recall) >= 0.9


def test_no_kept_node_below_a_dropped_one(trees):
    rng = random.Random(3)
    for _ in range(40):
        nodes = extract.walk(extract._compose(rng, ["w", "x y", "z"])[0])
        extract.decode(nodes, trees.chance(extract.node_features(nodes)))
        assert all(n.state == extract.DROPPED for n in nodes[1:] if n.parent.state == extract.DROPPED)


def test_a_page_of_very_many_siblings(trees):
    nodes = extract.walk(extract.parse("<html><body><article><ul>" + '<li class="a b">x y</li>' * 100_000 + "</ul></article></body></html>"))
    extract.decode(nodes, trees.chance(extract.node_features(nodes)))
    assert len(nodes) == 100_005


def test_text_of_any_element_but_code_counts():
    root = extract.parse("<article><p>a<math><mi>b</mi></math><object>c</object><noscript>d</noscript><svg><text>e</text></svg><script>f</script><style>g</style></p></article>")
    nodes = extract.walk(root)
    for n in nodes:
        n.state = extract.KEPT
    assert extract.main_text(root) == "abcde"
