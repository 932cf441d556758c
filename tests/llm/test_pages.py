"""Main text of pages."""

from tracegauge.llm.html_text import best_container, blocks, extract

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:"<p>"}}</style></head><body class="page-{n}">
<header class="site">Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="wrap"><div class="post-{n}"><h2>Title {n} &amp; more</h2>
<p title="a>b">First <b>bold</b>
   text<script>var x = "</p>";</script> of {n}.<p>Second <a href="#">link</a> &eacute;&#233;&#x65;<br>line 3 &lt; 4
<form><input value="q"><button>Send</button></form><ul><li>one<li>two</ul><!-- hidden > note -->
<div class="comments"><p>A reader says a long, long thing about this and that and more.</p></div></div>
<div class="sidebar">Other posts</div></div><aside>Aside</aside><footer>&copy; us</footer></body></html>"""


def want(n):
    return f"Title {n} & more\nFirst bold text of {n}.\nSecond link éée line 3 < 4\none\ntwo"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_text_and_path_by_host(spark):
    rows = [(n, f"https://H.example.org/x{n}", SITE.format(n=n)) for n in range(12)] + [(99, "nonsense", SITE.format(n=99))]
    got = {r.page_id: r for r in extract(pages(spark, rows)).collect()}
    for n in [*range(12), 99]:
        assert got[n].text == want(n) and got[n].n_chars == len(want(n))
        assert got[n].container == "/html/body.page-0/div/div.post-0"


def test_host_decides_where_a_page_misleads(spark):
    long_aside = "<html><body><div class='story'><p>Short story.</p></div><div class='teasers'><p>" + "Words of another kind. " * 40 + "</p></div></body></html>"
    usual = "<html><body><div class='story'><p>" + "A long story. " * 30 + "</p></div><div class='teasers'><p>See more.</p></div></body></html>"
    rows = [(i, "http://a.example/", usual) for i in range(5)] + [(9, "http://a.example/z", long_aside)]
    assert {r.page_id: r.text for r in extract(pages(spark, rows)).collect()}[9] == "Short story."


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://b.example", "plain text"), (4, "http://b.example", "<p>a &am"), (5, "http://c.example", "<div><p>cut <b>off</b> in a <a hre"), (5, "http://c.example", "<div><p>cut <b>off</b> in a <a hre")]
    got = sorted((r.page_id, r.text) for r in extract(pages(spark, rows)).collect())
    assert got == [(1, ""), (2, ""), (3, "plain text"), (4, "a &am"), (5, "cut off in a"), (5, "cut off in a")]
    assert extract(pages(spark, rows).limit(0)).count() == 0


def test_header_inside_an_article_is_text():
    found = blocks("<html><body><header>Site</header><article class=a1><header class=entry-header><h1>Head</h1></header><p>Body text</article></body></html>")
    assert [t for _, t, _ in found] == ["Head", "Body text"]
    assert best_container(found)[0] == "/html/body/article.a0"


def texts(page):
    return [t for _, t, _ in blocks(page)]


def test_svg_ends_where_browsers_end_it():
    assert texts('<body><p>One <svg class="i" /> two</p><p>Three</p><svg><path d="x"/><text>no</text></svg><p>Four') == ["One two", "Three", "Four"]
    assert texts("<body><svg width=1/><p>One</p><svg><g/><p>Two</p><svg></svg>") == ["One", "Two"]
    assert texts("<body><svg><foreignObject><div>no</div></foreignObject></svg><p>One") == ["One"]


def test_names_alone_do_not_hide_most_of_a_page():
    for name in ("commentary", "social-policy", "side", "share-prices"):
        assert texts(f"<body><p>Intro</p><div class='{name}'><p>{'A long article. ' * 9}</p><div class=share>Share it</div></div>") == ["Intro", ("A long article. " * 9).strip()]
    for name in ("side", "social", "related", "comment", "comments", "commentlist", "comment-12"):
        assert texts(f"<body><p>{'A long article. ' * 9}</p><div class='{name}'>Beside it</div>") == [("A long article. " * 9).strip()]
    assert texts(f"<body><p>Short</p><div class=comments>{'A reader says this. ' * 9}</div>") == ["Short"]


def test_text_beside_the_best_box(spark):
    entry = "<div class=entry>" + "<p>A paragraph of the article. </p>" * 99 + "</div>"
    post = f"<body><div class=wrap><div class=post><h1>Headline</h1>{entry}<div class=box><p>A box.</p></div></div></div>"
    flat = f"<body><h1>Headline</h1><p>Lead.</p>{entry}<div class=teasers><p>See more.</p></div>"
    rows = [(i, "http://a.example/", post) for i in range(3)] + [(i, "http://b.example/", flat) for i in range(3, 6)]
    article = "A paragraph of the article.\n" * 98 + "A paragraph of the article."
    for r in extract(pages(spark, rows)).collect():
        assert r.text == (f"Headline\n{article}\nA box." if r.page_id < 3 else f"Headline\nLead.\n{article}")


def test_two_templates_on_a_host(spark):
    one = "<body><div class=story><p>" + "A long story. " * 30 + "</p></div>"
    two = "<body><div class=story><p>One line.</p></div><div class=review><p>" + "A long review. " * 30 + "</p></div>"
    rows = [(i, "http://a.example/", one) for i in range(5)] + [(i, "http://a.example/", two) for i in range(5, 8)]
    got = {r.page_id: r.text for r in extract(pages(spark, rows)).collect()}
    assert all(got[i] == ("A long story. " * 30).strip() for i in range(5))
    assert all(got[i] == "One line.\n" + ("A long review. " * 30).strip() for i in range(5, 8))
