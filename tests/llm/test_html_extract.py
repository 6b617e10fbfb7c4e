import pytest

from wareloom.llm import html_extract


def test_article_without_its_surroundings():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav-open"><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, yes, really</div><div id=content><div class="post"><h2>Title, here</h2>
    <p>First &amp; more,&nbsp;text<br>line two <a href=x>link</a>. <b>bold<p>Second <i>para</i>, with commas, many, of them.
    <ul><li>one<li>two</ul><form><input><label>Name</label></form><pre>a  b
    c</pre></div><div class="comments"><p>Nice post, really, wow, great, a long comment here</p></div></div><aside><p>Side, bar</p></aside><footer>&copy; me</footer>"""
    want = ["Title, here", "First & more, text line two link . bold".replace(" .", "."), "Second para, with commas, many, of them.", "one", "two", "a b c"]
    assert html_extract.main_text(page) == "\n\n".join(want)


def test_siblings_of_the_best_container_are_kept_and_link_lists_not():
    prose = "Some prose with commas, many of them, and enough words to count as a paragraph of the article, it goes on, and on."
    page = f"<body><div><div><p>{prose}<p>{prose}<p>{prose}</div><p>{prose}</p><div>" + "".join(f"<a href=x>Link, {i}</a> " for i in range(40)) + "</div></div></body>"
    assert html_extract.main_text(page) == "\n\n".join([prose] * 4)


def test_names_that_describe_the_layout_and_uneven_sections():
    prose = "Some prose with commas, many of them, and enough words to count."
    page = f"<body class=x><div class='wrap sidebar-right has-sidebar'><main><h1>Title</h1><section><p>{prose}<p>{prose}<p>{prose}</section><section><p>{prose}</section></main></div></body>"
    assert html_extract.main_text(page) == "\n\n".join(["Title", *[prose] * 4])
    page = f"<div class='sidebar'><p>{prose}</div><div class='content no-footer'><p>{prose}</div><section class=related><article><p>{prose}</article></section>"
    assert html_extract.main_text(page) == prose


def test_odd_pages():
    assert [html_extract.main_text(h) for h in ("", None, "plain <b>text", "<p>a</p>" * 3, "<nav>x</nav>", "a &lt; b < c")] == ["", "", "plain text", "a\n\na\n\na", "", "a < b < c"]
    assert html_extract.main_text("<div>" * 20000 + "x") == "x"
    assert html_extract.main_text("<p>" + "long " * 50000) == ("long " * 50000).strip()


def test_one_row_per_page(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_extract.extracted(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "v", "")], key=str)
    assert html_extract.extracted(pages.limit(0)).collect() == []


def test_nothing_beside_the_best_container_is_cut_by_its_size():
    prose = "Some prose with commas, many of them, and enough words to count as a paragraph of the article, it goes on, and on."
    page = f"<body><article><section>{f'<p>{prose}' * 40}</section><section><p>In short, done.</section><p>Short.</p><pre>x = 1</pre><figure><figcaption>A figure</figcaption></figure>bare"
    page += "<details>More</details><address>By me</address></article></body>"
    assert html_extract.main_text(page) == "\n\n".join([prose] * 40 + ["In short, done.", "Short.", "x = 1", "A figure", "bare", "More", "By me"])
    page = f"<main><div><div><p>{prose}<p>{prose}<p>{prose}</div></div><div><div><p>End.</div></div></main>"
    assert html_extract.main_text(page) == "\n\n".join([prose] * 3 + ["End."])
    page = f"<body><div><div><p>{prose}<p>{prose}<p>{prose}</div>bare<pre>x = 1</pre><p>Short.</p><div><p>Too.</div></div></body>"
    assert html_extract.main_text(page) == "\n\n".join([prose] * 3 + ["bare", "x = 1", "Short.", "Too."])


def test_form_around_the_page_is_a_container_and_others_are_not():
    prose = "Some prose with commas, many of them, and enough words to count as a paragraph of the article, it goes on, and on."
    controls = "<input type=hidden name=__VIEWSTATE value=x><input name=q><select><option>All</option></select><label>Find</label><button>Go</button>"
    article = f"<article><h1>Title</h1><p>{prose}</p><p>End.</p></article>"
    want = "\n\n".join(["Title", prose, "End."])
    assert html_extract.main_text(f"<body><form id=aspnetForm>{controls}{article}</form></body>") == want
    assert html_extract.main_text(f"<body><form id=aspnetForm>{controls}<div><h1>Title</h1><p>{prose}</p><p>End.</p></div></form></body>") == want
    assert html_extract.main_text(f"<body><form class=sidebar><div>{article}</div></form><form><p>Stay in touch</p>{controls}</form></body>") == want
    assert html_extract.main_text(f"<body>{article}<form><textarea>x</textarea><p>Leave a reply</p><input name=a><button>Send</button></form></body>") == want
    assert html_extract.main_text(f"<body><div><p>{prose}<p>{prose}</div><form><input type=hidden><p>Without controls.</form></body>") == "\n\n".join([prose, prose, "Without controls."])


PROSE = "Some prose with commas, many of them, and enough words to count as a paragraph of the article, it goes on, and on."
BODY = f"<p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p>"
#: (page, blocks beside or inside the three paragraphs that belong to the text)
UNNAMED = [
    (f"<body><div>Weekly deals...</div><div id=content>{BODY}</div><div>Visit our store...</div></body>", [], []),
    (f"<body><div><div>Weekly deals</div><div>{BODY}</div><div>Visit our store</div></div></body>", [], []),
    (f"<body><div><span>Sale</span> <b>now</b></div><article>{BODY}</article></body>", [], []),
    (f"<body><div><article>{BODY}</article><div><p>Buy one <a href=x>here</a></p></div></div></body>", [], []),
    (f"<body><div><a href=x>Top offers</a></div><div>{BODY}</div></body>", [], []),
    (f"<body><div><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><main>{BODY}</main></body>", [], []),
    (f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><div>{BODY}</div></body>", [], []),
    (f"<body><table><tr><td><a href=x>Deals</a> of the day<td>{BODY}<td>Call us now</table></body>", [], []),
    (f"<body><a href=x>Home</a><div>{BODY}</div>Deals<div>Low prices</div></body>", [], []),
    (f"<body><section><div>Free shipping</div></section><section>{BODY}</section></body>", [], []),
    (f"<body><main>{BODY}</main><div><h3>More</h3><p><a href=1>Story</a></p><p><a href=2>Story</a></p></div></body>", [], []),
    (f"<body><center>Win a prize</center><div><div>{BODY}</div></div></body>", [], []),
    (f"<body><div>Weekly deals</div><h1>Title</h1><div>{BODY}<ul><li><a href=1>Source</a><li><a href=2>Source</a><li><a href=3>Source</a></ul></div></body>", ["Title"], ["Source"] * 3),
    (f"<body><div><h1>Title</h1></div><article>{BODY}<div><a href=1>Ref, 1</a> <a href=2>Ref, 2</a> <a href=3>Ref, 3</a></div></article><div>Deals</div></body>", ["Title"], ["Ref, 1 Ref, 2 Ref, 3"]),
    (f"<body><div>{BODY}<div>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> here.</div></div><div>Deals</div></body>", [], ["Energy is E=m here."]),
]


@pytest.mark.parametrize("page, before, after", UNNAMED)
def test_adverts_without_a_name_go(page, before, after):
    tree = html_extract.Tree()
    tree.feed(page)
    tree.close()
    unscored = html_extract.blocks(tree.root, set(), set(), set(), None)
    want = before + [PROSE] * 3 + after
    assert html_extract.main_text(page).split("\n\n") == want != unscored


def plain_text(html):
    """Points, shares and the best container found anew for every element by walking its whole subtree."""
    tree = html_extract.Tree()
    tree.feed(html)
    tree.close()
    h = html_extract
    elements = [n for n in tree.order if not n.dropped]

    def below(node):
        return [node] + [m for c in node.children if isinstance(c, h.Node) and not c.dropped for m in below(c)]

    def text(node):
        return " ".join(h.own_text(node).split())

    def worth(node):
        return 1 + text(node).count(",") + min(len(text(node)) / 100, 3)

    def level(node, ancestor):
        at, n = node.parent, 0
        while at is not ancestor:
            n += at.tag in h.CONTAINERS
            at = at.parent
        return n

    def rated(node):
        inside = below(node)
        length = sum(len(text(m)) for m in inside if m.tag in h.PARAGRAPHS)
        linked = sum(len(text(m)) for m in inside if m.tag == "a")
        points = sum(worth(m) / (1, 2, 6, 9, 12, 15)[level(m, node)] for m in inside[1:] if m.tag in h.PARAGRAPHS and text(m) and level(m, node) < 6)
        return points * (1 - (min(1, linked / length) if length else 0)) * (1.5 if node.tag in ("article", "main") else 1)

    ratings = {n: rated(n) for n in elements if n.tag in h.CONTAINERS}
    best = max(ratings, key=lambda n: (round(ratings[n], 9), -n.depth))
    around = [best]
    while around[-1].parent is not None:
        around.append(around[-1].parent)
    outer = next((n for n in reversed(around) if n.tag in ("article", "main")), best)
    return outer, h.blocks(outer, set(around), set(), set(), None)


def test_equals_a_plain_scorer_on_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for page in pages + [p for p, _, _ in UNNAMED[:12]]:
        outer, text = plain_text(page)
        tree = html_extract.Tree()
        tree.feed(page)
        tree.close()
        html_extract.measure(tree.order)
        mine = html_extract.main_node(tree)[0]
        assert (mine.tag, mine.depth) == (outer.tag, outer.depth)
        assert html_extract.main_text(page) == "\n\n".join(text)
