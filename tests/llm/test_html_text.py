"""Main text of hand-made pages, densities against a recursive version, and the cases of rows."""

import math
import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest

from palimpsest.llm import html_text as H

SF = Path("/root/testdata/sf0.001")
LONG = "A sentence of the article that goes on for a good while, so that its density is high. " * 4
BODY = LONG.strip()


def page(main, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{main}{after}</body></html>"


MENU = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><header class="site"><a href="/">Home</a> Slogan</header><div class="cookie-notice">We use cookies. <button>OK</button></div>'
TAIL = '<aside class="sidebar">Most read <a href="/x">x</a></aside><section id="comments"><h2>Comments</h2><p>Nice article, I liked it a lot, and more words of a reader.</p></section><form><input><label>Mail</label></form><footer>&copy; Someone</footer><script>var a = "<p>no</p>";</script>'


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', "<div><div><div>{}</div></div></div>", "<table><tr><td>{}</td></tr></table>"])
def test_article_without_what_is_around(wrap):
    main = wrap.format(f"<h1>Title &amp; more</h1><p>{BODY}</p><p>Second   <b>bold</b>\n<i>words</i> &eacute;&#33;</p><ul><li>item one of the list</li><li>item two of the list</li></ul>")
    assert H.main_text(page(main, MENU, TAIL)) == f"Title & more\n{BODY}\nSecond bold words é!\nitem one of the list\nitem two of the list"


def test_parts_inside_the_article_that_are_not_of_it():
    main = f'<article><header><h1>Title</h1></header><div class="ad">Buy this now</div><p>{BODY}</p><div class="share"><a href="#">Share</a></div><p style="display: none">hidden</p><p>End of it.</p><script>x()</script><div class="comments"><p>I am a reader</p></div></article>'
    assert H.main_text(page(main, MENU, TAIL)) == f"Title\n{BODY}\nEnd of it."


def test_broken_markup():
    main = f"<article><h1>Title</h1><p><b>Bold start<br><p>{BODY}<p>Next<div>Block</div></b> tail</article>"
    assert H.main_text(page(main, MENU, TAIL)) == f"Title\nBold start\n{BODY}\nNext\nBlock\ntail"
    assert H.main_text(f"<article><p>{BODY} a < b and <3</p><!-- never closed <p>no</p>") == f"{BODY} a < b and <3"
    assert H.main_text("just text, no markup") == "just text, no markup"
    assert H.main_text(f"<p>{BODY}</p></div></span></article>") == BODY


def test_empty_pages():
    for p in ("", "   ", "<html></html>", "<script>x</script>", page("", MENU, TAIL), "<!-- only -->"):
        assert H.main_text(p) in ("",), p


def test_two_articles_and_deep_nesting():
    deep = "<div>" * 3000 + f"<p>{BODY}</p>" + "</div>" * 3000
    assert H.main_text(deep) == BODY
    big = page("<article>" + f"<p>{BODY}</p>" * 3000 + "</article>", MENU, TAIL)
    assert H.main_text(big) == "\n".join([BODY] * 3000)


def recursive(node, body):
    """(chars, tags, link chars, link tags) of a node by the definition, depth first."""
    import html

    chars = sum(len(" ".join(html.unescape(c).split())) for c in node.children if isinstance(c, str))
    tags = link_chars = link_tags = 0
    for c in node.children:
        if not isinstance(c, str):
            a, b, x, y = recursive(c, body)
            chars, tags, link_chars, link_tags = chars + a, tags + b + 1, link_chars + x, link_tags + y
    if node.tag == "a":
        link_chars, link_tags = chars, link_tags + 1
    return chars, tags, link_chars, link_tags


def test_densities_follow_the_definition():
    root = H.parse(f"<div><p>{BODY}</p><p>Some <a href='#'>link text</a> here</p></div><ul><li><a>menu</a></li><li><a>menu two</a></li></ul>")
    nodes = H._order(root)
    H._densities(nodes)
    share = recursive(root, root)[2] / recursive(root, root)[0]
    for node in nodes:
        c, t, lc, lt = recursive(node, root)
        if not c:
            assert node.density == 0
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        want = c / max(1, t) * max(0.0, math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / base)
        assert node.density == pytest.approx(want)
        assert node.total == pytest.approx(sum(x.density for x in node.children if not isinstance(x, str)))
    assert H._target(nodes).tag == "div"


def test_names_that_only_contain_a_word():
    main = f'<article><h1>T</h1><p>{BODY}</p><div class="search-engines"><p>Engines.</p></div><section id="notice-of-appeal"><p>Appeal.</p></section><p>So <math><mi>x</mi></math></p></article>'
    assert H.main_text(page(main, MENU, TAIL)) == f"T\n{BODY}\nEngines.\nAppeal.\nSo x"
    assert H.main_text(f'<div class="widget"><article><p>{BODY}</p></article></div>') == BODY


def chosen(root):
    """The selection by its definition: recursive, with everything computed anew at each node."""
    share = recursive(root, root)[2] / recursive(root, root)[0] if recursive(root, root)[0] else 0.0

    def density(x):
        if isinstance(x, str):
            n = len(" ".join(x.split()))
            return H.density(n, 0, 0, 0, share)
        return H.density(*recursive(x, root), share)

    def up(x):
        return [] if x.parent is None else [x.parent, *up(x.parent)]

    def known(x):
        inside = any(y.tag in ("article", "main") for y in up(x))
        wraps = any(not isinstance(c, str) and (c.tag in ("article", "main") or holds(c)) for c in x.children)
        return x.parent is not None and (H.boilerplate(x, inside, wraps) or known(x.parent))

    def holds(x):
        return any(not isinstance(c, str) and (c.tag in ("article", "main") or holds(c)) for c in x.children)

    def walk(x):
        return [x, *(y for c in x.children if not isinstance(c, str) for y in walk(c))]

    def total(x):
        return sum(density(c) for c in x.children if not isinstance(c, str))

    free = [x for x in walk(root) if not known(x)]
    most = max(map(total, free))
    target = next(x for x in free if total(x) == most) if most > 0 else root
    while target.tag not in H._CONTAINERS:
        target = target.parent
    threshold = min(density(x) for x in [target, *up(target)])

    def usable(x):
        return isinstance(x, str) or (not known(x) and recursive(x, root)[2] * 2 <= recursive(x, root)[0])

    def plain(x):
        return isinstance(x, str) or x.tag in H._PLAIN or x.tag not in H._BLOCK

    def around(x):
        if x.parent is None:
            return [], []
        kids = x.parent.children
        at = [i for i, c in enumerate(kids) if c is x][0]
        dense = [i for i, c in enumerate(kids) if i != at and usable(c) and density(c) >= threshold > 0]
        first, last = min([*dense, at]), max([*dense, at])
        heads = [i for i in range(first) if not isinstance(kids[i], str) and kids[i].tag in H._HEADINGS and all(map(usable, kids[i:first]))]
        first = min([first, *heads])
        if x.parent.parent is not None:
            first = min([first, *(i for i in range(first) if all(plain(c) and usable(c) for c in kids[i:first]))])
            last = max([last, *(i for i in range(last, len(kids)) if all(plain(c) and usable(c) for c in kids[last + 1 : i + 1]))])
        before, after = around(x.parent)
        return before + [c for c in kids[first:at] if usable(c)], [c for c in kids[at + 1 : last + 1] if usable(c)] + after

    before, after = around(target)
    return [*before, target, *after]


def test_selection_follows_the_definition():
    rng = random.Random(3)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return " ".join(rng.choice(["some", "words", "of", "text"]) for _ in range(rng.choice([0, 2, 5, 40])))
        tag = rng.choice(["div", "div", "p", "section", "article", "ul", "a", "b", "h2", "nav", 'div class="ad"', 'section id="comments"', 'div class="widget"'])
        return f"<{tag}>{''.join(made(depth - 1) for _ in range(rng.randrange(4)))}</{tag.split()[0]}>"

    for _ in range(400):
        root = H.parse("".join(made(4) for _ in range(rng.randrange(1, 5))))
        assert [id(x) if not isinstance(x, str) else x for x in H.content(root)] == [id(x) if not isinstance(x, str) else x for x in chosen(root)]


@pytest.mark.parametrize("broken", ["<div>" * 100_000 + "x", "<div>" * 50_000 + "</p>" * 50_000, "</b>" * 100_000, '<a href="x>' * 50_000, "<p a='" * 50_000, "<ul><li>" * 50_000, "<b><div>" * 30_000 + "</b>" * 30_000, "<head>" * 50_000, "<" * 200_000])
def test_broken_pages_take_linear_time(broken):
    began = time.process_time()
    H.main_text(broken)
    assert time.process_time() - began < 5


class Article(HTMLParser):
    """The article of the tables' pages by the standard library: its own reading, no densities."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks, self.parts = False, [], []

    def end(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "footer", "nav"):
            self.end()
            self.on = tag == "article"
        elif tag in ("h1", "p"):
            self.end()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.end()
            self.on = self.on and tag != "article"

    def handle_data(self, data):
        if self.on:
            self.parts.append(data)


def article(text):
    reader = Article()
    reader.feed(text)
    reader.close()
    reader.end()
    return "\n".join(reader.blocks)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, page(f"<p>{BODY}</p>"), "z"), (3, f"<p>{BODY}</p>", "w"), (3, f"<p>{BODY}</p>", "w")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == sorted([("1", "", 0), ("2", "", 0), ("None", BODY, len(BODY)), ("3", BODY, len(BODY)), ("3", BODY, len(BODY))])
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = H.op10_html_text(spark, str(SF)).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) > 0
        assert r.text == article(pages[r.page_id].html or "")
        assert all(b and b == " ".join(b.split()) for b in r.text.split("\n"))


@pytest.mark.skipif(not SF.exists(), reason="no test data")
@pytest.mark.parametrize("tag", ["div", "section"])
def test_density_finds_the_article_without_its_element(tag):
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        assert H.main_text((page or "").replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == article(page or "")
