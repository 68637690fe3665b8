"""Pages of unusual shapes and hosts of several layouts."""

import pytest

from corpusloom.llm import html_extract

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def texts_of(spark):
    def run(pages):
        rows = [(k, url, source) for k, (url, source) in enumerate(pages)]
        return [r.text for r in sorted(html_extract.extract(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r.page_id)]

    return run


def test_deep_pages_keep_their_text(texts_of):
    deep = 5_000
    pages = [
        ("http://a.x/1", "<body>" + "<div>" * deep + "inner words" + "</div>" * deep + "<p>last words</p>"),
        ("http://a.x/2", "<body>" + "<div>" * deep + "unclosed words"),
        ("http://a.x/3", "<body><p>" + "<b>" * deep + "bold words"),
        ("http://a.x/4", "<body>" + "<font><a>" * deep + "linked <div>block words</div> end"),
    ]
    assert texts_of(pages) == ["inner words\n\nlast words", "unclosed words", "bold words", "linked\n\nblock words\n\nend"]


def test_every_layout_of_a_host_has_its_template(texts_of):
    """Unmarked boilerplate that only pages of one layout have, an error page and an empty one beside them."""
    news = [f"<body><h1>n{k}</h1><div class=x><p>news {k} text</p></div><div class=foot>All news reserved</div>" for k in range(8)]
    shop = [f"<body><section><h2>s{k}</h2><p>shop {k} text</p></section><section class=legal>Prices with tax</section>" for k in range(8)]
    pages = [("http://h.x/a", p) for p in [*news, *shop, "", None, "<body><em>error</em>"]]
    got = texts_of(pages)
    assert got[:8] == [f"n{k}\n\nnews {k} text" for k in range(8)]
    assert got[8:16] == [f"s{k}\n\nshop {k} text" for k in range(8)]
    assert got[16:] == ["", "", "error"]


def test_a_block_in_pages_of_many_layouts_is_template(texts_of):
    pages = [f"<body>{''.join(f'<div class=only{k}x{n}>part {k} {n}</div>' for n in range(3))}<div class=foot>Same end</div>" for k in range(9)]
    got = texts_of([("http://h.x/a", p) for p in pages])
    assert got == ["\n\n".join(f"part {k} {n}" for n in range(3)) for k in range(9)]


def test_merged_tree_holds_every_page():
    one, other = html_extract.unfolded("a.(b.(x.) d.)"), html_extract.unfolded("a.(b.(y. x.) c. d.(z.))")
    html_extract.merge(one, other)
    assert html_extract.skeleton(one) == "a.(b.(y. x.) c. d.(z.))"


ARTICLE = "<article><h1>{t} title</h1><p>First words of {t} in the article, quite some of them.</p><p>More {t} words.</p></article>"
WANTED = "{t} title\n\nFirst words of {t} in the article, quite some of them.\n\nMore {t} words."


@pytest.mark.parametrize(
    "shape",
    [
        '<div class="content-sidebar-wrap">{a}</div>',
        '<div class="site-content has-sidebar">{a}<div class="sidebar">Side {t}</div></div>',
        '<main class="no-comments">{a}</main><div id="comments"><p>Nice {t}</p></div>',
        '<form id="aspnetForm"><div id="main">{a}</div></form>',
        '<div class="widget-area"><div class="menu"><a href=/>Menu {t}</a></div>{a}</div>',
        '{a}<section class="related"><article><p>Other {t}</p></article></section><section id="comments"><article class="comment">Mine {t}</article></section>',
    ],
)
@pytest.mark.parametrize("pages", [1, 8])
def test_names_of_wrappers_do_not_drop_the_article(texts_of, shape, pages):
    made = [("http://w.x/a", "<body><nav>Top</nav>" + shape.format(a=ARTICLE.format(t=f"t{k}"), t=f"t{k}")) for k in range(pages)]
    assert texts_of(made) == [WANTED.format(t=f"t{k}") for k in range(pages)]


def test_names_inside_an_article(texts_of):
    page = (
        '<body><article class="post category-social-media"><section class="menu-of-the-day"><p>Soup of the day</p></section>'
        '<p class="reply-quote">A quoted reply</p><p class="advert">Buy this</p><div class="social share"><p>Share it</p></div><p>The end</p></article>'
    )
    assert texts_of([("http://w.x/a", page)]) == ["Soup of the day\n\nA quoted reply\n\nThe end"]


def test_headings_that_all_articles_share_stay(texts_of):
    pages = [f"<body><article><h1>Weekly report</h1><h2>Summary</h2><p>Week {k} was fine.</p></article><div class=foot>All rights</div>" for k in range(8)]
    got = texts_of([("http://h.x/a", p) for p in pages])
    assert got == [f"Weekly report\n\nSummary\n\nWeek {k} was fine." for k in range(8)]


def test_ids_of_single_pages_make_no_layouts(texts_of):
    pages = [f'<body><div id="box-{k}"><div class=tag>Always the same</div><p id="p{k}x">Words {k} here.</p></div>' for k in range(8)]
    assert texts_of([("http://h.x/a", p) for p in pages]) == [f"Words {k} here." for k in range(8)]
    trees = {html_extract.skeleton(html_extract.fold([html_extract.parse(p)])) for p in pages}
    assert len(trees) == 1


def test_many_pages_with_ids_of_their_own(spark):
    rows = spark.range(10_000).selectExpr(
        "id AS page_id", "'http://big.x/p' AS url",
        "concat('<body><div id=\"c', id, '\"><p>Same words above</p><article id=\"a', id, '\"><h1>Head ', id, '</h1><p class=\"k', id, '\">Body ', id, '</p></article></div>') AS html",
    )
    got = html_extract.extract(rows)
    assert got.count() == 10_000
    assert got.where("text <> concat('Head ', page_id, '\n\nBody ', page_id)").count() == 0


def test_a_quote_that_never_closes_is_no_text(texts_of):
    assert texts_of([("http://q.x/1", '<p title="x>para one</p><p>two</p>')]) == ["para one\n\ntwo"]


def test_a_page_without_an_article_in_a_form(texts_of):
    page = '<body><form id="aspnetForm"><div id="content"><p>Some words of the page, long enough to be most of it.</p></div></form><div class="nav">Go</div>'
    assert texts_of([("http://f.x/1", page)]) == ["Some words of the page, long enough to be most of it."]
