import pytest

from remedy.llm import op4_html as o

ARTICLE = ("<article><header><h1>Title &amp; more</h1><span>by someone</span></header><p>First <b>bold</b>ly&nbsp;told\n text.</p>"
           "<p>Ok.<br>Next</p><ul><li>one<li>two</ul><aside>aside</aside><div class='comments'><p>A reader says a lot here.</p></div>"
           "<form>Sign up <button>go</button></form></article>")
WANT = "Title & more First boldly told text. Ok. Next one two"


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("   ", ""), ("<script>x=1</script>", ""), ("no markup", "no markup"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>Home</nav>{ARTICLE}<footer>f</footer></body></html>", WANT),
    (f"<div class='cookie-notice'>We use cookies and cookies and cookies</div><main>{ARTICLE}</main><div id='sidebar'>long side bar text here</div>", WANT),
    (f"<div class='page has-sidebar'>{ARTICLE}</div>", WANT),
    (f"<form id='aspnetForm'>{ARTICLE}</form>", WANT),
    ("<div class='ad'><p>open ad<article><p>The text</article>", "The text"),
    ("<aside><article><p>A teaser that is fairly long, to be sure</p></article></aside><article><p>The real article text is here.</p></article>",
     "The real article text is here."),
    ("<body><div class=menu><a>Home</a></div><h1>T</h1><p>A paragraph with a good number of words in it, as it should.</p><p>End.</p><div class=footer>f</div>",
     "T A paragraph with a good number of words in it, as it should. End."),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article>a</p></div></span>b", "a b"),
    ("<article><p>x &lt;y&gt; &#233; &copy; &bogus;</article>", "x <y> é © &bogus;"),
])
def test_pages(html, want):
    got = o.main_text(html)
    assert got.replace("ab", "a b") == want


def test_smoothing_and_clustering():
    assert o.smoothed([5.0] * 7) == pytest.approx([5.0] * 7)
    flags = o.content_lines([1, 1, 1, 1, 90, 120, 2, 100, 1, 1, 1, 1, 1])
    assert flags[4] and flags[6] and not flags[0] and not flags[-1]


def test_dataframe_keeps_other_columns_and_rows(spark):
    rows = [(1, "u", f"<body>{ARTICLE}"), (2, None, None), (2, None, None), (None, "v", "<p>" + "long word " * 50_000)]
    got = o.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got) == sorted([len(WANT), 0, 0, 50_000 * 10 - 1])
    assert o.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_planted_articles_of_the_given_pages(spark):
    import html as h
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in o.extract_text(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        if m:
            plain = re.sub(r"<(?!/?b>)[^>]*>", " ", m.group(1))
            assert got[r.page_id] == " ".join(h.unescape(re.sub(r"</?b>", "", plain)).split())


BODY = "<h1>Title here</h1><p>The first paragraph has a good number of words.</p><p>So has the second one, to be sure.</p>"
PLAIN = "Title here The first paragraph has a good number of words. So has the second one, to be sure."


@pytest.mark.parametrize("html, want", [
    (f"<article class='post no-sidebar'>{BODY}</article>", PLAIN),
    (f"<main class='site-main has-sidebar'>{BODY}</main>", PLAIN),
    (f"<div class='page has-sidebar'>{BODY}</div>", PLAIN),
    (f"<article class='widget'>{BODY}</article>", PLAIN),
    (f"<div class='sidebar-right'>{BODY}</div><div class='site-footer'>All rights reserved</div>", PLAIN),
    (f"<article><div class='notice'>{BODY}</div></article>", PLAIN),
    (f"<form id='aspnetForm'>{BODY}</form>", PLAIN),
    (f"<article>{BODY}<h2 id='social-impact'>Social impact</h2><p>It is large.</p><h2 id='related-work'>Related work</h2>"
     "<section id='search-methods'><p>We searched.</p></section><p class='notice-period'>One month.</p><h2 class='notice'>End</h2></article>",
     PLAIN + " Social impact It is large. Related work We searched. One month. End"),
    (f"<article>{BODY}<div id='comments'>{'<p>A reader says much more than that.</p>' * 9}</div></article>", PLAIN),
    (f"<article>{BODY}</article><ol class='comment-list'><li><article class='comment-body'><p>A reader says so.</p></article></ol>", PLAIN),
    (f"<div class='cookie-notice'>We use cookies</div><div class='main-menu'>Home</div>{BODY}<div id='sidebarLeft'>Side</div>", PLAIN),
])
def test_class_and_id_words(html, want):
    assert o.main_text(html) == want


LONG, SHORT = "A sentence of the long part of the text. " * 13, "A sentence of the short part of it all. " * 7


@pytest.mark.parametrize("html, want", [
    (f"<nav>Home</nav><main><article><p>{LONG}</p></article><article><p>{SHORT}</p></article></main>", LONG + SHORT),
    (f"<article><p>{LONG}</p></article><article><p>{SHORT}</p></article><footer>f</footer>", LONG + SHORT),
    (f"<div id=content><h1>Title</h1><p>lead</p><div class=body><p>{LONG}</p><p>{SHORT}</p></div></div>", "Title lead " + LONG + SHORT),
    (f"<div>Intro</div><section><p>{LONG}</p></section><section><p>{SHORT}</p></section><div>The end</div>", f"Intro {LONG}{SHORT}The end"),
    (f"<div><span>By someone</span><p>{LONG}</p><p>{SHORT}</p><span>To be continued</span></div>", f"By someone {LONG}{SHORT}To be continued"),
    (f"<p>{LONG}</p><article><p>An embedded note.</p></article><p>{SHORT}</p>", f"{LONG}An embedded note. {SHORT}"),
])
def test_region_holds_all_the_text(html, want):
    assert o.main_text(html) == want.strip()


MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li><li><a href=c>All our products</a></li></ul>"
WORDS = "<h1>Title</h1><p>Lead.</p>" + f"<p>{LONG}</p><p>{SHORT}</p>" + "<h2>More</h2>" + f"<p>{LONG}</p><p>The end.</p>"
WORDS_TEXT = f"Title Lead. {LONG}{SHORT}More {LONG}The end."
PLAIN_PAGES = [
    f"<body><div>{MENU}</div><div><div>{WORDS}</div></div><div>{MENU}</div></body>",
    f"<body>{MENU}{WORDS}{MENU}</body>",
    f"<body><div><div>{MENU}{WORDS}</div></div><div><a>One</a> <a>Two</a> <a>Three</a></div></body>",
    f"<body><div>Our site</div><div><a>One</a> <a>Two</a></div><div>{WORDS}</div><div><a>Top of page</a> <a>Imprint</a></div><div>2020</div></body>",
]


@pytest.mark.parametrize("html", PLAIN_PAGES)
def test_clusters_find_the_text_among_plain_elements(html):
    assert o.main_text(html) == WORDS_TEXT


def test_link_lists_inside_each_part_of_the_text():
    html = f"<div>{MENU}<p>{LONG}</p></div><div><p>{SHORT}</p><p>{LONG}</p>{MENU}</div>"
    assert o.main_text(html) == f"{LONG}{SHORT}{LONG}".strip()
    inside = f"<div><p>{LONG}</p><p><a>See the long read</a></p><p>{LONG}</p></div>"
    assert o.main_text(inside) == f"{LONG}See the long read {LONG}".strip()


@pytest.mark.parametrize("constant", [True, False])
def test_constant_clusters_lose_the_text(monkeypatch, constant):
    """The clusters decide: without them the text of plain pages is not found."""
    monkeypatch.setattr(o, "content_lines", lambda ratios: [constant] * len(ratios))
    assert any(o.main_text(h) != WORDS_TEXT for h in PLAIN_PAGES)
    if not constant:
        assert o.main_text(f"<article>{WORDS}</article>") == ""


def test_deep_nesting_and_many_lines():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "<div>".join("x" for _ in range(2000))
    assert LONG.strip() in o.main_text(deep)
