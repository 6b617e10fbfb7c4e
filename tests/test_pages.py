import random

import pytest
from pyspark.sql import functions as F

from wareloom.functions import markup
from wareloom.operators import nodes as nd
from wareloom.operators import pages as pg


PAGE = """<div id="top" class="a b"><p class="x">one &amp; two</p><div><p>three</p><img src="data:,x" data-src="/i/1.jpg"><img src="/i/2.png" width="50" height="40">
<img srcset="/i/3.jpg 1x, /i/4.jpg 2x" src="/blank.gif"></div></div><form><input name="maxq" value="0"><button disabled>구매</button></form>"""


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, "https://s.example/v?goodsno=7", PAGE)], "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def nodes(page):
    return nd.store(page)


@pytest.mark.parametrize("selector, texts", [
    ("p", ["one & two", "three"]), ("#top p.x", ["one & two"]), (".a.b div p", ["three"]), ("p.x, button[disabled]", ["one & two", "구매"]), ("[class*=b] [class]", ["one & two"]),
    ("div.missing p", [])])
def test_selectors(nodes, selector, texts):
    assert [r.text for r in nd.with_text(nd.select(nodes, {"x": selector}), nodes).orderBy("ord").collect()] == texts


def test_unsupported_selectors_are_told():
    assert not nd.supported("div > p") and not nd.supported("a:has-text('x')") and nd.supported("ul.list li a[href^='/p']")


def extract(page, nodes, field, extractor):
    return pg.extract_fields(nodes, page, {field: extractor}).first()["values"]


def test_field_extraction_and_fallbacks(page, nodes):
    assert extract(page, nodes, "name", {"selector": ".x"}) == ["one & two"]
    assert extract(page, nodes, "detail", {"selector": "p.x", "html": True}) == ["one &amp; two"]
    assert extract(page, nodes, "images", {"selector": "#top", "attribute": "src", "multiple": True}) == ["/i/1.jpg", "/i/3.jpg"]
    assert extract(page, nodes, "images", {"selector": "#top", "attribute": "src", "multiple": True, "skip_first": 1}) == ["/i/3.jpg"]
    assert extract(page, nodes, "code", {"selector": ".none", "fallback_from": "url", "url_param": "goodsno"}) == ["7"]
    assert extract(page, nodes, "status", {"fallback_from": "maxq"}) == ["sold_out"]
    assert extract(page, nodes, "status", {"selector": "button", "fallback_from": "cart_button"}) == ["구매"]
    assert extract(page, nodes, "origin", {"selector": ".none", "fallback": " 국산 "}) == ["국산"]
    assert extract(page, nodes, "origin", {"selector": ".none"}) == []


def test_many_fields_at_once(page, nodes):
    fields = {"name": {"selector": ".x"}, "all": {"selector": "p", "multiple": True}, "detail": {"selector": "p.x", "html": True}, "images": {"selector": "div div", "attribute": "src", "multiple": True},
              "value": {"selector": "input", "attribute": "value"}, "status": {"fallback_from": "maxq"}, "odd": {"selector": "div > p", "fallback": "x"}}
    got = {r.field: (r["values"], r.problem) for r in pg.extract_fields(nodes, page, fields).collect()}
    assert got == {"name": (["one & two"], None), "all": (["one & two", "three"], None), "detail": (["one &amp; two"], None), "images": (["/i/1.jpg", "/i/3.jpg"], None),
                   "value": (["0"], None), "status": (["sold_out"], None), "odd": (["x"], "unsupported selector: div > p")}


@pytest.mark.parametrize("html, status", [
    ("<p>품<b>절</b></p><a>Buy</a>", "sold_out"), ("<p>품절 <b>아님</b></p><a>구매</a>", "available"), ("<p><b>품절</b> 아님</p>", "sold_out"), ("<script>품절</script><a>Cart</a>", "available"),
    ("<p>Buy</p>", None), (None, None)])
def test_stock_from_texts_and_buttons(spark, html, status):
    page = spark.createDataFrame([(5, "u", html)], "page_id bigint, url string, html string")
    assert extract(page, nd.parse(page), "status", {"fallback_from": "cart_button"}) == ([status] if status else [])


def plain_select(rows, selector):
    """Ancestors by walking up the parents, one element after the other."""
    def fits(n, simple):
        return n.tag != nd.TEXT and {"div": n.tag == "div", "p": n.tag == "p", ".a": "a" in n.classes, "#x": n.id == "x", "*": True}[simple]

    by_ord = {n.ord: n for n in rows}

    def chain(n, steps):
        if not fits(n, steps[-1]):
            return False
        above, rest = n.parent, steps[:-1]
        while rest and above >= 0:
            if chain(by_ord[above], rest):
                return True
            above = by_ord[above].parent
        return not rest

    return [n.ord for n in rows if any(chain(n, g.split()) for g in selector.split(","))]


def test_nested_selectors_equal_brute_force(spark):
    rng = random.Random(3)
    sources = []
    for i in range(30):
        html, open_tags = "", []
        for _ in range(60):
            if open_tags and rng.random() < 0.45:
                html += f"</{open_tags.pop()}>"
            else:
                open_tags.append(rng.choice(["div", "p", "b"]))
                html += f"<{open_tags[-1]}{rng.choice(['', ' class=a', ' id=x'])}>{rng.choice(['', 'word '])}"
        sources.append((i, html))
    nodes = nd.store(spark.createDataFrame(sources, "page_id bigint, html string"))
    pages = {}
    for n in nodes.orderBy("page_id", "ord").collect():
        pages.setdefault(n.page_id, []).append(n)
    selectors = ["div p", "div div .a", ".a p, #x div", "p", "* * * p", "#x, .a .a"]
    got = nd.with_text(nd.select(nodes, {s: s for s in selectors}), nodes).collect()
    for s in selectors:
        for page, rows in pages.items():
            want = plain_select(rows, s)
            mine = sorted((r.ord, r.text) for r in got if r.name == s and r.page_id == page)
            assert mine == [(o, "".join(n.text for n in rows if n.tag == nd.TEXT and o < n.ord <= rows[o].last)) for o in want], (s, page)


def test_stored_nodes_are_read_without_a_shuffle(nodes):
    plan = nd.select(nodes, {"x": "div p", "y": ".a div img"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan


def test_detail_images(evaluate):
    rows = [("https://x/a.jpg",), ('<p><img alt="a>b" src=\'1.jpg\'><img data-src="no.jpg"><IMG SRC=2.jpg><!-- <img src="c.jpg"> --></p>',), (None,), (" ",)]
    assert evaluate(rows, "s string", pg.detail_images(F.col("s"))) == [["https://x/a.jpg"], ["1.jpg", "2.jpg"], [], []]


def test_image_sources_are_chosen_once(spark):
    pages = spark.createDataFrame([(1, '<div class="g"><img src="blank.gif" data-src="/a.jpg"><img src="/icon-x.png"></div>')], "page_id long, html string")
    found = pg.collect_images(nd.parse(pages), pages, ".g")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("spacer") == 2  # the pattern stands for attributes and for srcset, not again in each test on their result
    assert [r.images for r in found.collect()] == [["/a.jpg"]]


def test_plain_start_tags_read_like_others():
    plain = '<div id="m" class="a b">x<IMG src="1" SRC="2"><br/><i/><p>y</div><script type="t">z</script>'
    other = plain.replace('"m"', "'m'").replace('"1"', "'1'").replace("<p>", "<p >").replace('"t"', "'t'")
    rows = markup.nodes(plain)
    assert [r[:9] for r in rows][:3] == [[0, 6, -1, "div", "m", ["a", "b"], {"id": "m", "class": "a b"}, None, 24], [1, 1, 0, "#text", None, None, None, "x", None],
                                         [2, 2, 0, "img", "", [], {"src": "1"}, None, 46]]
    assert [r[:8] for r in rows] == [r[:8] for r in markup.nodes(other)]
    assert [plain[r[8]:r[9]] for r in rows if r[3] == "script"] == ["z"] and rows[-1][7] is None
