import random
import re

import pytest

from lodestone.llm import html_extract as H


def page(*paragraphs, extra="", tail="</article><footer>&copy; me</footer></body></html>"):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li><li>More</li></ul></nav>" + extra + "<div class=ad>Buy</div><article><h1>Head</h1>" + "".join(f"<p>{p}" for p in paragraphs) + tail


PAGES = [
    ("http://a.com/1", page("One &amp; two", "thr<b>ee</b>  f&ouml;ur\n"), "Head\nOne & two\nthree föur"),
    ("http://a.com/2", page("x<br>y"), "Head\nx y"),
    ("http://a.com/3", page("a</p>", "b</p>", "c</p>", "d", extra="<aside><p>side</p></aside><form><input><p>form</p></form><div class='cookie-notice'>we use</div>"), "Head\na\nb\nc\nd"),
    ("http://a.com/4", page("cut", tail=""), "Head\ncut"),
    ("http://a.com/5", page("t", tail="</article><section id='comments'><h2>2 comments</h2><p>nice</p></section></body></html>"), "Head\nt"),
    ("http://a.com/6", "<html><body><header>top</header><p>no article<div>here</div></body></html>", "no article\nhere"),
    ("http://b.com/1", "<body><div class=header>x</div><main><p>main<!-- c --> text&#33;</p><table><tr><td>1<td>2</table><div class='share'>s</div></main><footer>f</footer>", "main text!\n1\n2"),
    (None, "just text &lt;b&gt;", "just text <b>"),
    ("notaurl", "<p>a<p>b", "a\nb"),
    ("http://c.com", None, ""),
    ("http://c.com", "", ""),
    ("http://c.com", "<<<>>> < b <p", "<<<>>> < b"),
]


def test_main_text(spark):
    rows = [(i, u, h, "clash") for i, (u, h, _) in enumerate(PAGES * 2)]
    out = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, c1 string"))
    assert out.columns == ["page_id", "url", "html", "c1", "_main"]
    got = {r.page_id: r._main for r in out.collect()}
    assert got == {i: PAGES[i % len(PAGES)][2] for i in range(2 * len(PAGES))}


def test_empty_table_and_long_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.main_text(empty).count() == 0
    long = page(*(f"paragraph {i}" for i in range(5000)))
    got = H.main_text(spark.createDataFrame([(1, "http://a.com", long)], "page_id long, url string, html string")).first()._main
    assert got == "\n".join(["Head", *(f"paragraph {i}" for i in range(5000))])


def marks(items):
    return [[x[0], marks(x[1])] if isinstance(x, list) else x for x in items]


def test_folding_and_alignment():
    a = H.fold(list("xabababy"))
    assert a == ["x", ["+", ["a", "b"]], "y"]
    assert H.fold(list("aaab")) == [["+", ["a"]], "b"] and H.fold(list("xaby")) == list("xaby")
    assert H.align(a, list("xaby")) == a  # once meets repeated
    merged = H.align(["a", "b", "c"], ["a", "c"])
    assert merged == ["a", ["?", ["b"]], "c"]
    assert H.align(merged, ["a", "b", "c"]) == merged and H.align(merged, ["a", "c"]) == merged


def raw(page):
    """A page's tokens, as text: tags and slot keys."""
    return [x.key if isinstance(x, H.Slot) else x for x in H.tokens(page)[0]]


def expression(wrapper, codes):
    """The wrapper as a regular expression over one character for each token."""
    return "".join(f"(?:{expression(x[1], codes)}){'' if not x[0] else x[0]}" if isinstance(x, list) else re.escape(codes[x.key if isinstance(x, H.Slot) else x]) for x in wrapper)


@pytest.mark.parametrize("seed", range(25))
def test_every_page_matches_the_wrapper_of_its_host(seed):
    """Brute force: the wrapper, as a plain regular expression, takes every page's tokens whole, in whatever order pages come."""
    rng = random.Random(seed)

    def some():
        parts = [f"<p>{rng.choice('abc')}</p>" * rng.randint(0, 3), f"<ul>{'<li>x</li>' * rng.randint(0, 4)}</ul>" * rng.randint(0, 2), "<div class=box><h2>t</h2><p>y</p></div>" * rng.randint(0, 3), "<aside>s</aside>"]
        rng.shuffle(parts)
        return page(*("z" * rng.randint(1, 2) for _ in range(rng.randint(0, 3))), extra="".join(parts[: rng.randint(0, 4)]))

    pages = [some() for _ in range(8)]
    wrapper = H.stream(pages[0])
    for p in pages[1:]:
        wrapper = H.align(wrapper, H.stream(p))
    wrapper = H.unpacked(H.packed(wrapper))
    codes = {t: chr(0x4E00 + i) for i, t in enumerate(sorted({t for p in pages for t in raw(p)}))}
    for p in pages:
        assert re.fullmatch(expression(wrapper, codes), "".join(codes[t] for t in raw(p)))


def host_texts(pages):
    wrapper = H._merge([H.packed(H.stream(p)) for p in pages])
    return [H.extract(p, H.choice(wrapper)) for p in pages]


@pytest.mark.parametrize(
    ("around", "expected"),
    [
        ("<body class='single comments-open'><article><h1>T</h1><p>%s</p><p>two</p></article></body>", "T\n%s\ntwo"),
        ("<body class='home has-sidebar'><div id=x><h1>T</h1><p>%s</p></div></body>", "T\n%s"),
        ("<body><article class='post share-enabled'><p>%s</p></article></body>", "%s"),
        ("<body><div data-id='notice'><p>%s</p><p>more</p></div></body>", "%s\nmore"),
        ("<main><h1 class='article-title'>T</h1><div class='body'><p>%s</p></div></main>", "T\n%s"),
        ("<body><div class='ad'>buy</div><div class='wrap sidebar-left'><p>%s</p></div></body>", "%s"),
    ],
)
def test_names_around_the_article_empty_no_page(around, expected):
    for texts in (["some long text of the article here"], ["some long text of the article here", "quite another long text of another page"]):
        assert host_texts([around % t for t in texts]) == [expected % t for t in texts]


SHOP = "<body><div class=x1><div>Shop of the year</div><div class=x2><p>%s</p><div>Read more at our shop</div><p>%s</p></div><div>All rights</div></div></body>"


def test_alignment_decides_what_is_content():
    texts = [("first page has this long paragraph", "and this one"), ("the second page says something else", "and ends so")]
    pages = [SHOP % t for t in texts]
    assert host_texts(pages) == ["\n".join(t) for t in texts]  # what both pages hold alike is the template's
    assert host_texts(pages[:1])[0] != "\n".join(texts[0])  # one page cannot tell
    assert host_texts([pages[0], pages[0]]) == host_texts(pages[:1]) * 2 and "Read more" in host_texts(pages[:1])[0]


def test_partial_wrappers_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN_IN", 2)
    texts = [(f"page {i} has the long paragraph number {i * 7}", f"and an end of its own {i}") for i in range(40)]
    rows = [(i, "http://hot.com/%d" % i, SHOP % t) for i, t in enumerate(texts)]
    out = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)).collect()
    assert {r.page_id: r._main for r in out} == {i: "\n".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("tag", ["<img class=banner src=x>", '<img class="header-image">', '<input class="search">', "<source class=promo>", "<wbr class=ad>"])
def test_elements_without_content_exclude_nothing_after_them(tag):
    html = f"<body><article>{tag}<p>one {tag}two</p><p>three</p></article></body>"
    assert H.extract(html, None) == "one two\nthree"


def test_deep_nesting():
    deep = "<div>" * 3000 + "<p>text</p>" + "</div>" * 3000
    assert H.extract(f"<body>{deep}</body>", None) == "text"
