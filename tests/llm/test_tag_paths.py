import html
import random
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from nearwave.llm.tag_paths import _MARKS, main_text, main_texts, parse, path_sums
from tests.llm.odd_texts import ODD_TEXTS

ARTICLE = [
    "A title & more",
    "First paragraph, with a clause; and a link inside. It goes on for a while, as paragraphs do.",
    "Short.",
    "Second paragraph is longer: it has several sentences, commas, and a quote – nothing else. Really, nothing.",
    "Third one. With <angle> brackets, and 100% of what it needs to be seen as text, not as a menu.",
]


def paragraphs():
    return "".join(f"<p>{html.escape(p)}</p>\n" for p in ARTICLE[1:])


NAV = '<nav><ul><li><a href="/">Home</a><li><a href="/a">About us</a></ul></nav>'
COMMENTS = '<section id="comments"><h2>Comments</h2><div class="comment"><p>I disagree, strongly, with all of it. Really. I do, and I say so at length, again and again.</p></div></section>'
FOOTER = "<footer><p>&copy; Example. All rights reserved.</p></footer>"
TITLE = f"<h1>{html.escape(ARTICLE[0])}</h1>"

LAYOUTS = {
    "article": f"<html><head><title>x</title><style>p{{a:b}}</style></head><body>{NAV}<article>{TITLE}{paragraphs()}</article>{COMMENTS}{FOOTER}</body></html>",
    "div": f"<body><div id=header><a href=/>Site</a></div><div id='menu'><p>Menu, one. Two.</p></div><div class=\"content\">{TITLE}{paragraphs()}</div><div class='sidebar'><p>Related: this, that.</p></div>{FOOTER}",
    "nested": f"<div><div><div class=wrap><main>{TITLE}<div><div>{paragraphs()}</div></div><form><p>Subscribe now!</p><input></form></main></div></div>{COMMENTS}</div>",
    "comments inside": f"<article>{TITLE}{paragraphs()}<div class='comments-area'><p>Nice, nice.</p></div><aside>See, also.</aside></article>",
    "article header": f"<header><h1>Site</h1></header><article><header>{TITLE}<p>By someone, today.</p></header>{paragraphs()}<footer>Tags: a, b.</footer></article>",
    "scripts": f"<script>var a='<p>no</p>';</script><article>{TITLE}<script>if (a < b) {{}}</script>{paragraphs()}<!-- <p>gone</p> --><noscript><p>No, no.</p></noscript></article>",
    "unclosed": f"<body>{NAV}<article>{TITLE}" + "".join(f"<p><b>{html.escape(p)}<br>" for p in ARTICLE[1:]) + f"</article>{FOOTER}",
    "nameless": "<body><div><ul><li><a href=/>Home, page</a><li><a href=/a>About us, and more</a></ul></div><div>" + TITLE + paragraphs() + "</div><div><span><a href=/x>Terms</a></span></div>",
    "cookie notice": f"<div class='cookie-notice' role=dialog><p>We use cookies, and so on. Accept, please.</p></div><article>{TITLE}{paragraphs()}</article>",
    "adverts": f"<article>{TITLE}<div class=\"ad\">Buy, now.</div>{paragraphs()}<p class='advert-slot'>Buy.</p></article>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    assert main_text(LAYOUTS[layout]) == "\n\n".join(ARTICLE)


def test_blocks_and_space():
    page = "<article><p> a\n\t b&nbsp;c &lt;d&gt; <i>e</i>f<br>g</p>tail &amp; end<ul><li>one, two<li>three</ul></article>"
    assert main_text(page) == "a b c <d> ef g\n\ntail & end\n\none, two\n\nthree"


def test_long_articles_are_whole():
    lines = [f"Sentence number {i}, which is here." for i in range(5000)]
    page = f"{NAV}<article>{''.join(f'<p>{x}</p>' for x in lines)}</article>"
    assert main_text(page) == "\n\n".join(lines)


def test_broken_pages_end():
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<div class='a", "'>", "<", ">", "<!--", "-->", "<script>", "text, ", "&amp", "</", "<article>", '"', "<td>", "<li"]
    for _ in range(500):
        main_text("".join(rng.choices(parts, k=rng.randint(0, 40))))
    for page in ("<" * 100_000, "<div>" * 5_000, "<a b=" * 20_000, "<!--" * 30_000, "<script>" * 20_000):
        main_text(page)


def test_query(spark):
    rows = [(i, f"u{i}", t) for i, t in enumerate(ODD_TEXTS)] + [(50, None, LAYOUTS["article"]), (None, "u", LAYOUTS["div"])]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = {r.page_id: r for r in main_texts(pages).collect()}
    assert found[0].text == "" and found[1].text == "" and found[3].text == "one"
    assert found[50].text == found[None].text == "\n\n".join(ARTICLE)
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert main_texts(pages.limit(0)).count() == 0


LEAD = "What this is about, in a line."
LAST = "Corrected on Monday, after a hint."
BODY = "".join(f"<p>{html.escape(p)} {html.escape(p)}</p>" for p in ARTICLE[1:] * 3)
BODY_TEXT = [f"{p} {p}" for p in ARTICLE[1:] * 3]
UNDECLARED = {
    "divs": f"<div id=content>{TITLE}<div>{LEAD}</div><div>{BODY}</div><div>{LAST}</div></div>",
    "section": f"<div id=content>{TITLE}<p>{LEAD}</p><section>{BODY}</section><p>{LAST}</p></div>",
    "list": f"<div id=content>{TITLE}<p>{LEAD}</p><ul>{BODY.replace('<p>', '<li>').replace('</p>', '</li>')}</ul><p>{LAST}</p></div>",
    "shares": f"<div id=content>{TITLE}<div class=share>Share, now.</div><div>{LEAD}</div><div>{BODY}</div><div>{LAST}</div></div>",
}


@pytest.mark.parametrize("kind", UNDECLARED)
def test_heading_lead_and_end_outside_the_body(kind):
    page = f"<body>{NAV}{UNDECLARED[kind]}{FOOTER}</body>"
    assert main_text(page) == "\n\n".join([ARTICLE[0], LEAD, *BODY_TEXT, LAST])


NAMED = {
    "container named after its sidebar": f"<body>{NAV}<div class='content with-sidebar'><article>{TITLE}{BODY}</article><div class=sidebar><p>Tags</p></div></div>",
    "page named after its header": f"<body><div id='page' class='hfeed site has-header-image'>{NAV}<article>{TITLE}{BODY}</article>{FOOTER}</div>",
    "page in a form": f"<body><form action=/>{NAV}<div id=content>{TITLE}{BODY}</div>{FOOTER}</form>",
    "post header": f"<article><div class='post-header'>{TITLE}</div>{BODY}</article>",
    "menu in main": f"<main><ul><li><a href=/>Home</a><li><a href=/a>About us</a><li><a href=/b>Terms</a></ul>{TITLE}{BODY}</main>",
    "comments longer than the article": f"<body><div id=content>{TITLE}{BODY}</div><div id=comments>{'<p>I disagree, strongly, with all of it. Really.</p>' * 200}</div>",
}


@pytest.mark.parametrize("kind", NAMED)
def test_names_are_weighed(kind):
    assert main_text(NAMED[kind]) == "\n\n".join([ARTICLE[0], *BODY_TEXT])


@pytest.mark.parametrize("attrs", ["id='social-policy'", "class='social-care'", "class='related-work'"])
def test_prose_with_a_doubtful_name(attrs):
    section = "It is about care, and about policy; which is what the name says. It is prose."
    page = f"<article>{TITLE}{BODY}<section {attrs}><p>{section}</p></section></article>"
    assert main_text(page) == "\n\n".join([ARTICLE[0], *BODY_TEXT, section])
    links = "<a href=/x>One</a> <a href=/y>Two</a>"
    assert main_text(f"<article>{TITLE}{BODY}<div {attrs}><p>{links}</p></div></article>") == "\n\n".join([ARTICLE[0], *BODY_TEXT])


class PlainPaths(HTMLParser):
    """Sums per path of well-formed pages, by another parser and a plain loop."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.links, self.sums = [], 0, {}

    def handle_starttag(self, tag, attrs):
        self.path.append(tag)
        self.links += tag == "a"

    def handle_endtag(self, tag):
        self.path.pop()
        self.links -= tag == "a"

    def handle_data(self, data):
        text = " ".join(data.split())
        if text:
            key = "/".join(t for t in self.path if t != "a")
            n, chars, marks, links = self.sums.get(key, (0, 0, 0, 0))
            self.sums[key] = (n + 1, chars + len(text), marks + len(_MARKS.findall(text)), links + len(text) * (self.links > 0))


def test_path_sums_against_a_plain_loop():
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join(rng.choices(["word,", "other.", "more", "end!"], k=rng.randint(1, 9)))
            return f"<a href=/>{text}</a>" if rng.random() < 0.3 else text
        tag = rng.choice(["div", "section", "ul", "blockquote"])
        return "".join(f"<{tag}>{tree(depth - 1)}</{tag}>" for _ in range(rng.randint(1, 4)))

    for _ in range(30):
        page = f"<div>{tree(5)}</div>"
        plain = PlainPaths()
        plain.feed(page)
        _, blocks = parse(page)
        assert sorted(path_sums(blocks).values()) == sorted(plain.sums.values())


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 20_000 + "x" + "</i>" * 20_000,
        "<div>" * 20_000 + "x, y.",
        "<div>x, y." * 20_000,
        "<a>" + "<div>" + "<b>" * 20_000 + "</a>" * 20_000,
        "<b>" * 20_000 + "<div></div>" * 20_000,
        "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000,
        "<article><header>" * 10_000 + "<h1>x</h1>" * 10_000,
    ],
)
def test_time_and_memory_grow_with_the_page(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3
    tracemalloc.start()
    main_text(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000
