import random
import time
import tracemalloc
from itertools import product

import pytest

from panelloom.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b> text<br>goes   on.<p>Second one &lt;here&gt;, caf&eacute; &#233;.</p>
<form><input value=x>Search it</form><aside>Related things.</aside><script>x()</script><!-- no --><ul><li>Point one</li><li>Point two</li></ul>
<div class="comments"><p>A reader says a whole sentence here.</p></div></article><div class="ad">Buy now.</div><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert html.main_text(PAGE) == "Title & more\n\nFirst bold text goes on.\n\nSecond one <here>, café é.\n\nPoint one\n\nPoint two"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<a href='x", "&amp", "<p>" * 3000, "\x00<p>\x00"])
def test_odd_pages(page):
    assert isinstance(html.main_text(page), str)


def test_page_without_landmarks():
    body = "".join(f"<p>This is sentence number {i}, with a good many words that read like running text. It goes on for a while.</p>" for i in range(5))
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
    text = html.main_text(f"<body><ul>{menu}</ul><div>{body}</div><ul>{menu}</ul></body>")
    assert "sentence number 0" in text and "sentence number 4" in text and "Item" not in text


def test_min_cut_against_all_labellings():
    dice = random.Random(5)
    for _ in range(150):
        n = dice.randint(1, 7)
        source, sink = ([round(dice.random() * 4, 2) for _ in range(n)] for _ in range(2))
        edges = [(u, v, round(dice.random() * 3, 2)) for u in range(n) for v in range(u) if dice.random() < 0.5]

        def cost(label):
            return sum(sink[i] if x else source[i] for i, x in enumerate(label)) + sum(c for u, v, c in edges if label[u] != label[v])

        assert cost(html.min_cut(source, sink, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def _cheapest(blocks, tree, weights=html.WEIGHTS):
    z = [html.log_odds(b, weights) for b in blocks]
    edges = html.smoothness(blocks, tree)

    def cost(label):
        return sum(max(0, -z[i]) if x else max(0, z[i]) for i, x in enumerate(label)) + sum(c for u, v, c in edges if label[u] != label[v])

    return cost, min(map(cost, product([False, True], repeat=len(blocks))))


def test_labels_are_the_cheapest():
    dice = random.Random(6)
    for _ in range(60):
        n, tree = dice.randint(1, 7), html.Tree()
        tops = [tree.add(tree.add(0, dice.random() < 0.3), dice.random() < 0.3) for _ in range(3)]
        blocks = [html.Block("word " * dice.randint(1, 40), dice.choice([0, 0, 3]), "p", tree.add(dice.choice(tops), False), dice.random() < 0.3, dice.random() < 0.2, 0, False) for _ in range(n)]
        cost, least = _cheapest(blocks, tree)
        assert cost(html.content(blocks, tree)) == pytest.approx(least)


def test_labels_are_the_cheapest_on_real_pages(spark, sf_dir):
    """Pages of the table, as many blocks of each as can be tried in every way."""
    tried = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()[:12]:
        blocks, tree = html.blocks_of(r.html)
        for k in range(0, len(blocks), 9):
            part = blocks[k : k + 9]
            cost, least = _cheapest(part, tree)
            assert cost(html.content(part, tree)) == pytest.approx(least)
            tried += 1
    assert tried > 15


PROSE = [f"This is paragraph {i} of a report that runs on for a good many words, as such reports do. It ends here." for i in range(2)]


@pytest.mark.parametrize("name", ["elementor-widget", "widget-area", "ad-free", "social-science", "legal-news", "copyright-law", "login-required article", "menu-open", "sidebar", "comments"])
def test_names_of_the_whole_layout_do_not_lose_the_text(name):
    page = f'<html><body><div class="{name}"><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div></body></html>'
    assert html.main_text(page) == "\n\n".join(PROSE)


def test_names_count_where_the_text_is_elsewhere():
    side = "By going on you agree that we use cookies to keep you signed in. You can change this at any time."
    talk = "A reader says that this is a very fine report with a good many words. Thank you."
    page = f'<body><div class="cookie-notice"><p>{side}</p></div><div><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div><div class="comments"><p>{talk}</p><p>{talk}</p></div></body>'
    assert html.main_text(page) == "\n\n".join(PROSE)


def test_the_cut_mends_labels():
    """Articles of plain divs with short lines in them, menus with a long entry: labelled by construction."""
    dice = random.Random(13)
    alone = cut = total = 0
    for _ in range(40):
        parts, want = [], {}

        def put(text, tag, mine, parts=parts, want=want):
            text = text.replace("#", str(len(want)))
            want[text] = mine
            parts.append(f"<{tag}>{text}</{tag}>" if tag == "p" else f"<li>{text}</li>" if "Terms" in text else f'<li><a href="/">{text}</a></li>')

        parts.append("<ul>")
        for k in range(8):
            put("Terms # of the use of this site, and all that comes with it." if k == 4 else f"{dice.choice(['Home', 'News', 'All about us'])} #", "li", False)
        parts.append("</ul><div>")
        for _ in range(dice.randint(6, 12)):
            put(dice.choice(["Yes #", "He left #", "So it was #"]) if dice.random() < 0.4 else f"# {PROSE[0]} {PROSE[1]}", "p", True)
        parts.append("</div>")
        blocks, tree = html.blocks_of("".join(parts))
        for b, keep in zip(blocks, html.content(blocks, tree), strict=True):
            total += 1
            alone += (html.log_odds(b) > 0) == want[b.text]
            cut += keep == want[b.text]
    assert cut > alone + 0.05 * total and cut > 0.97 * total


@pytest.mark.parametrize("page", ["<div>word " * 50_000, "<b>word " * 50_000, "<div>" * 50_000 + "</p></x>" * 50_000, "<ul><li>a " * 25_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 20


def test_deep_pages_take_linear_memory():
    tracemalloc.start()
    html.main_text("<div>word " * 50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 4)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html.extract(odd).collect()), key=str)
    n = len(html.main_text(PAGE))
    assert got == sorted([(None, None, 0), (1, "u", 0), (1, "u", n), (1, "u", n), (2, None, 0)], key=str)
    assert html.extract(odd.limit(0)).count() == 0


def test_weights_are_learned_from_marked_blocks(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    w = html.fit_weights(pages)
    assert w != html.WEIGHTS and w[2] < 0
    assert html.fit_weights(["<p>no landmarks</p>"]) == html.WEIGHTS
