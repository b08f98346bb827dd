import itertools
import random

import pytest
from proofline.llm.pages import blocks, edges, extract, main_text, minimum_cut

WORDS = "the brewer filled every barrel with cold water and then waited for the malt to settle before dawn".split()


def para(rng, n=45):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def pages():
    rng = random.Random(1)
    a, b, c, d = (para(rng) for _ in range(4))
    junk, long_junk = para(rng, 9), para(rng, 120)
    title = "How barrels are filled"
    nav = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    yield f"<html><head><title>x</title></head><body>{nav}<article><h1>{title}</h1><p>{a}</p><p>{b}</p></article><footer>&copy; {junk}</footer></body></html>", [title, a, b]
    yield f'<body><div id="cookie-notice">{junk} <button>OK</button></div><div class="site-header"><a href="/">Site</a></div><div id="content"><h1>{title}</h1><p>{a}<p>{b}</div><div class="sidebar"><p>{long_junk}</p></div>', [title, a, b]
    yield f'<main><article><header><h1>{title}</h1></header><p>{a}</p><div class="ad-slot">{long_junk}</div><p>{b}</p><form><p>{long_junk}</p><input></form><p>{c}</p></article><section id="comments"><article class="comment"><p>{long_junk}</p></article></section></main>', [title, a, b, c]
    yield f'<article><p>{a}</p><p>See <a href="x">the list</a></p><ul><li>{b}<li>{c}</ul><blockquote>{d}</blockquote><aside>{long_junk}</aside></article><script>if (1 < 2) document.write("<p>no</p>")</script>', [a, "See the list", b, c, d]
    yield f"<article><p>1 &lt; 2 &amp;amp; caf&eacute;&#160;x\n\n  {a}</p><!-- <p>no</p> --><style>p > a {{}}</style><p hidden>{junk}</p><h2>Part</h2><p>{b}<br>{c}</p></article><!-- open <p>{d}</p>", ["1 < 2 &amp; café x " + a, "Part", f"{b} {c}"]
    yield f'<table><tr><td><div role="navigation"><a>One</a> <a>Two</a></div></td><td><p>{a}</p><p>{b}</p></td></tr></table>', [a, b]
    yield f'<body><div class="wrap"><div class="entry-header"><h1>{title}</h1></div><div class="entry-content"><p>{a}</p><p>{b}</p></div><div class="related-posts"><h3>More</h3><p>{junk}</p></div></div></body>', [title, a, b]


@pytest.mark.parametrize("page, want", list(pages()))
def test_articles(page, want):
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize("name", ["table-responsive", "embed-responsive", "formatted", "formula", "navy", "review", "reviews"])
def test_names_that_only_begin_like_boilerplate(name):
    rng = random.Random(4)
    a, b, c = (para(rng) for _ in range(3))
    assert main_text(f'<body><article><p>{a}</p><div class="{name}"><p>{b}</p></div><p>{c}</p></article></body>').split("\n") == [a, b, c]
    assert main_text(f'<body><article class="{name}"><p>{a}</p><p>{b}</p></article></body>').split("\n") == [a, b]


@pytest.mark.parametrize("name", ["nav", "navbar", "site-navigation", "respond", "responses", "contact-form", "forms", "reviews"])
def test_names_of_boilerplate(name):
    rng = random.Random(4)
    a, b, c = (para(rng) for _ in range(3))
    assert main_text(f'<body><article><p>{a}</p><p>{b}</p></article><div class="{name}"><p>{c}</p></div></body>').split("\n") == [a, b]


@pytest.mark.parametrize("name", "button select svg canvas object audio video iframe noscript template".split())
def test_unclosed_elements_do_not_end_the_page(name):
    rng = random.Random(6)
    a, b, c = (para(rng) for _ in range(3))
    assert main_text(f"<article><p>{a}</p><p>{b} <{name} class=x>no</p><p>{c}</p></article>").split("\n") == [a, b, c]
    assert main_text(f"<article><p>{a} <b><{name}>no</b> yes</p><{name}>no<p>{b} <{name}>no</{name}></p><p>{c}</p></article>").split("\n") == [a + " yes", b, c]
    assert main_text(f"<article><p>{a}</p><{name}><p>no</p><{name}>no</{name}></{name}><p>{b}</p></article>").split("\n") == [a, b]
    assert main_text(f"<article><p>{a}</p><p>{b}</p><script><p>no</p>").split("\n") == [a, b]


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p><!--") == ""
    for page in ("<", "<p", "a < b", "</p></div>", "<a <b <c", "<![CDATA[x", "<script>", '<p class="', "<p>x</article></html></p>", "<p/>", "&#xD800; &#0;", "<svg/>x"):
        main_text(page)
    deep = "<div>" * 20_000 + "some text" + "<b>" * 20_000
    main_text(deep)
    long = "<article>" + f"<p>{para(random.Random(2))}</p>" * 5000 + "</article>"
    assert main_text(long).count("\n") == 4999
    assert main_text("<article>" + "<p>a b c" * 3 + "</article>") == "a b c\na b c\na b c"


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 9)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        links = [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(keep, source=source, sink=sink, links=links):
            return sum(b if k else a for a, b, k in zip(source, sink, keep, strict=True)) + sum(c for a, b, c in links if keep[a] != keep[b])

        got = minimum_cut(source, sink, links)
        assert abs(cost(got) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-6


def test_links_join_near_blocks():
    found = blocks("<div><p>a</p><p>b</p></div><ul><li>c</li></ul>")
    links = {(a, b): c for a, b, c in edges(found)}
    assert links[0, 1] > links[1, 2]


def test_rows(spark):
    rows = [(1, "u", "<article><p>One two.</p></article>"), (1, "u", "<article><p>One two.</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "😀 <p>x")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(a, b, main_text(h), len(main_text(h))) for a, b, h in rows], key=str)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["legal", "post-review", "press-alert", "form-guide", "notice", "search-tips"])
def test_an_article_is_not_judged_by_what_it_is_about(name):
    said = "A sentence of some words, and more of them. " * 4
    assert main_text(f'<nav><a href="/">Menu</a></nav><article class="{name}"><p>{said}</p></article>') == said.strip()
    assert main_text(f'<article><p>{said}</p></article><article class="comment"><p>{said} indeed</p></article>') == said.strip()


def test_formulas_are_text():
    said = "The sum of the squares, which is written out below, is never smaller than twice the product: "
    assert main_text(f"<article><p>{said}<math><mi>x</mi> &gt; 2</math> holds.</p></article>") == f"{said}x > 2 holds."


PARAGRAPH = "The brewery opened in 1874 near the river and has made ale there ever since, with water from its own well. "
ARTICLE = "<h1>The old brewery</h1>" + f"<p>{PARAGRAPH * 2}</p>" * 3
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav><header><a href="/">Site</a></header>'
SIDE = '<div class="sidebar-left"><ul><li><a href="/x">Related one</a></li><li><a href="/y">Other two</a></li></ul><p>Follow us now.</p></div>'
COMMENTS = f'<div id="comments"><article class="comment"><p>{PARAGRAPH * 4} I agree.</p></article><article class="comment"><p>{PARAGRAPH * 9} Me too.</p></article></div>'
FOOT = "<footer><p>Copyright 2024. All rights reserved.</p></footer>"
LAYOUTS = [
    *[f'<div class="{c}">{MENU}{a}{SIDE}{COMMENTS}</div>{FOOT}' for c in ("layout sidebar-left", "page header-fixed", "menu-open", "search-page", "banner-top-page") for a in (f"<article>{ARTICLE}</article>", f'<div class="post">{ARTICLE}</div>', f"<main>{ARTICLE}</main>")],
    f'<form id="aspnetForm">{MENU}<article>{ARTICLE}</article>{SIDE}{COMMENTS}{FOOT}</form>',
    f'<form id="aspnetForm">{MENU}<div class="content">{ARTICLE}</div>{SIDE}{FOOT}</form>',
    f'{MENU}<article class="post comments-open">{ARTICLE}</article>{SIDE}{COMMENTS}{FOOT}',
    f'{MENU}<div class="post social-enabled">{ARTICLE}</div>{SIDE}{COMMENTS}{FOOT}',
    f'{MENU}<article><section class="legal">{ARTICLE}</section></article>{SIDE}{COMMENTS}{FOOT}',
    f'{MENU}<article>{ARTICLE}<div class="share">Share this on all networks now.</div></article>{SIDE}{COMMENTS}{FOOT}',
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_names_of_layout_say_nothing_of_the_article(page):
    """Wrappers, forms and articles with names of menus, sidebars and comments keep the article; parts of these names go."""
    assert main_text(f"<html><body>{page}</body></html>").split("\n") == ["The old brewery", *[(PARAGRAPH * 2).strip()] * 3]
