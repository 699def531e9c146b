from __future__ import annotations

import json
import random
from html.parser import HTMLParser

from quotemill.llm import html_wrappers as h

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First   line<br><p>Second
line &copy; 1 &lt;2&gt;</p><aside>beside</aside><form><p>field</p></form><p>a<i>b</i>c</p><div class="comments"><p>me too</p></div><p>&amp</article>
<div id="sidebar"><p>side</p></div><footer>&copy; foot <p>x</p></footer></body></html>"""


def test_article_without_the_rest():
    assert h.main_text(PAGE) == "Head & more\nFirst line\nSecond line © 1 <2>\nabc\n&"


def test_odd_pages():
    assert h.main_text(None) == "" and h.main_text("") == ""
    assert h.main_text("just text <") == "just text <"
    assert h.main_text("<article><p>cut of") == "cut of"
    assert h.main_text("<article><p>a</p><script>never closed <p>b</p>") == "a"
    assert h.main_text('<main class="x"><p title="a>b">in</p></main><p>out</p>') == "in"
    assert h.main_text('<div role="main"><p>in</p></div><p>out</p>') == "in"
    assert h.main_text("<body><p>one</p><div>two<p>three</div>four</body>") == "one\ntwo\nthree\nfour"
    assert h.main_text("<article>" + "<p>long " * 20_000) == "\n".join(["long"] * 20_000)
    assert h.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert h.main_text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre> e\n f </pre></article>") == "a\nb\nc\nd\ne f"
    assert h.main_text('<article><p>x <a href="b"y">z</a></article>') == "x z"
    assert h.main_text("<article><p>a&nbsp;&nbsp;b\u3000c</p><hr><p>d</p></article>") == "a b c\nd"
    assert h.main_text('<article class="post related"><p>kept</p><section id="comments"><article class="comment">not</article></section></article>') == "kept"


def test_an_article_keeps_its_parts_of_any_class():
    inner = '<div class="share-price">Share price rose</div><section class="related-work"><p>Related work</p></section><p class="search">Search</p>'
    assert h.main_text(f"<article><p>a</p>{inner}<div class='ad'>x</div><div class='cookie-notice'>y</div></article>") == "a\nShare price rose\nRelated work\nSearch"


def test_folding_and_alignment():
    fold = lambda text: [t for t, _ in h.fold(text.split())]
    assert fold("a b b b c") == ["a", "(b)+", "c"]
    assert fold("p # /p p # /p x") == ["(p # /p)+", "x"]
    long = [f"t{i}" for i in range(40)]
    assert fold("a " + " ".join(long * 3) + " b") == ["a", "(" + " ".join(long) + ")+", "b"]
    assert h.fold("u p # /p p # /p v u p # /p p # /p p # /p v".split()) == [("(u (p # /p)+ v)+", 5)]
    assert fold("<div> <p> # </p> </div> </div>") == "<div> <p> # </p> </div> </div>".split()
    assert fold("<p> # <p> # </p> </div> </div>") == ["(<p> #)+", "</p>", "</div>", "</div>"]
    one = [["p", False, "", 1, 1], ["#", False, "same", 1, 1], ["/p", False, "", 1, 1]]
    two = [["p", False, "", 2, 2], ["#", False, "other", 2, 2], ["/p", False, "", 2, 2], ["q", False, "", 2, 2]]
    assert h.as_pattern(h.align(one, one)) == 'p "same" /p'
    assert h.as_pattern(h.align(one, two)) == "p # /p (q)?"
    assert h.as_pattern(h.align([["(p # /p)+", False, "a\x1fb", 3, 3]], one)) == "(p # /p)+"


def page(i: int, items: int, notice: bool = True) -> str:
    listed = "".join(f"<li>item {i} {k}</li>" for k in range(items))
    top = "<div class='top'>We use cookies</div>" if notice else ""
    return f"<html><body>{top}<ul>{listed}</ul><div class='body'><p>Text of {i}</p></div></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], "page_id long, url string, html string, host string, wrapper string, text string, n_chars int")


def texts(spark, rows) -> dict:
    return {r.page_id: r.text for r in h.extract_text(pages(spark, rows)).collect()}


def plainly(rows) -> dict:
    """The same without Spark: each host's pages aligned one after the other."""
    wrappers: dict[str, list] = {}
    for _, url, page in rows:
        host = url.split("/")[2]
        items = h.page_items(page)[0]
        wrappers[host] = h.align(wrappers[host], items) if host in wrappers else items
    return {i: h.main_text(page, h.Wrapper(wrappers[url.split("/")[2]])) for i, url, page in rows}


def test_wrappers_do_not_depend_on_fan_in(spark):
    rows = [(i, "http://h.org/x" if i % 3 else "http://k.org/", page(i, i % 5, i % 4 > 0)) for i in range(40)]
    frame = pages(spark, rows).repartition(6)
    wide = {r.host: (r.n_pages, h.as_pattern(json.loads(r.wrapper))) for r in h.infer_wrappers(frame).collect()}
    tall = {r.host: r.n_pages for r in h.infer_wrappers(frame, fan_in=2).collect()}
    assert {k: v[0] for k, v in wide.items()} == tall == {"h.org": 26, "k.org": 14}
    assert all("+" in p and ")?" in p for _, p in wide.values())
    want = {i: "\n".join([f"item {i} {k}" for k in range(i % 5)] + [f"Text of {i}"]) for i in range(40)}
    assert texts(spark, rows) == plainly(rows) == want


def test_template_texts_go_where_no_article_is_marked(spark):
    rows = [(i, "http://h.org/x", page(i, 2)) for i in range(6)] + [(9, "http://k.org/y", PAGE), (None, None, None), (10, "odd", "")]
    rows.append(rows[0])
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in h.extract_text(pages(spark, rows).where("page_id is null or page_id <> 9")).collect())
    want = [(str(i), f"item {i} 0\nitem {i} 1\nText of {i}", 27) for i in range(6)]
    want += [want[0], ("None", "", 0), ("10", "", 0)]
    assert got == sorted(want)
    assert h.extract_text(pages(spark, rows).where("false")).count() == 0
    assert texts(spark, rows)[9].startswith("Head & more\nFirst line")


def test_wrappers_are_joined_when_they_are_large(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/x", page(i, 2)) for i in range(12)]
    want = texts(spark, rows)
    monkeypatch.setattr(h, "MAX_BROADCAST_BYTES", 1)
    assert texts(spark, rows) == want


def test_copies_of_a_page_are_no_template(spark):
    same = "<html><body><h1>T</h1><p>A</p></body></html>"
    rows = [(i, "http://h.org/x", same) for i in range(3)] + [(100 + i, "http://k.org/x", same) for i in range(2000)] + [(5000 + i, "odd", f"<p>same</p><p>{i}</p>") for i in range(4)]
    got = texts(spark, rows)
    assert {v for k, v in got.items() if k < 5000} == {"T\nA"} and got[5001] == "same\n1"


def test_template_texts_go_by_position(spark):
    of = lambda i, text: f"<body><div class='top'>Notice</div><ul><li>{i}</li></ul><section><p>{text}</p></section></body>"
    rows = [(i, "http://h.org/x", of(i, f"text {i}")) for i in range(4)] + [(9, "http://h.org/x", of(9, "Notice"))]
    got = texts(spark, rows)
    assert got[1] == "1\ntext 1" and got[9] == "9\nNotice"


def test_a_constant_after_a_list_goes_and_one_in_a_content_region_stays(spark):
    of = lambda i: (
        f"<body><ul>{''.join(f'<li>l{i} {k}</li>' for k in range(2 + i % 3))}</ul><table><tr><td>Imprint</td></tr></table>"
        f"<div class='story'><h2>Summary</h2><p>story {i}</p><div><p>All rights of the author</p></div></div><div class='end'><p>Write to us</p></div></body>"
    )
    rows = [(i, "http://h.org/x", of(i)) for i in range(5)]
    want = {i: "\n".join([f"l{i} {k}" for k in range(2 + i % 3)] + ["Summary", f"story {i}", "All rights of the author"]) for i in range(5)}
    assert texts(spark, rows) == plainly(rows) == want


def test_a_menu_list_that_is_the_same_everywhere_goes(spark):
    of = lambda i: f"<body><ul><li>Home</li><li>News</li><li>Shop</li></ul><div>{''.join(f'<p>{i} {k}</p>' for k in range(1 + i))}</div></body>"
    rows = [(i, "http://h.org/x", of(i)) for i in range(4)] + [(7, "http://one.org/", of(0))]
    want = {i: "\n".join(f"{i} {k}" for k in range(1 + i)) for i in range(4)} | {7: "Home\nNews\nShop\n0 0"}
    assert texts(spark, rows) == plainly(rows) == want


def test_the_wrapper_overrules_a_teaser(spark):
    """An article that is the same everywhere is none where more text varies; a single page has its labels alone."""
    of = lambda i: f"<body><article class='teaser'><p>Read our magazine</p></article><div class='text'><p>the long text number {i}</p><p>more {i}</p></div></body>"
    rows = [(i, "http://h.org/x", of(i)) for i in range(4)] + [(9, "http://one.org/", of(9))]
    got = texts(spark, rows)
    assert {k: v for k, v in got.items() if k < 9} == {i: f"the long text number {i}\nmore {i}" for i in range(4)}
    assert got[9] == "Read our magazine"


STORY = "<h1>The bridge is open</h1><p>After years of work the bridge was opened yesterday by the mayor.</p><p>Thousands came to see it.</p>"
TOLD = "The bridge is open\nAfter years of work the bridge was opened yesterday by the mayor.\nThousands came to see it."


def test_a_story_that_a_host_has_twice_is_kept(spark):
    """Dates, counters and side columns that differ beside it don't make a template of it."""
    meta = lambda i: f"<div class='meta'>{i} May 2024</div>"
    around = {
        "date": lambda i: f"<body>{meta(i)}<article>{STORY}</article></body>",
        "counter": lambda i: f"<body><article>{STORY}</article><p>Read {i * 37} times</p><div>Session {i}</div></body>",
        "side": lambda i: f"<body><div class='sidebar'><ul>{'<li>link</li>' * i}</ul></div><main><article>{STORY}</article></main><span>{i}</span></body>",
        "role": lambda i: f"<body>{meta(i)}<div role='main'>{STORY}</div></body>",
    }
    rows, want = [], {}
    for k, (name, of) in enumerate(around.items()):
        for i in range(1, 4):
            rows.append((100 * k + i, f"http://{name}.org/x", of(i)))
            want[100 * k + i] = TOLD
    for i in range(5):  # other stories of the host stand beside the mirrored one
        text = f"story number {i} of this host is another one and it has some length"
        rows.append((1000 + i, "http://date.org/x", f"<body>{meta(i)}<article><h1>T{i}</h1><p>{text}</p></article></body>"))
        want[1000 + i] = f"T{i}\n{text}"
    assert texts(spark, rows) == want


def test_words_of_names_in_an_article_need_the_wrapper(spark):
    of = lambda i: f"<article><p>text {i}</p><div class='menu-card'><p>soup {i}</p></div><figure class='banner-image'>bridge {i}</figure><div class='menu'><p>Home {i}</p></div><div class='newsletter-box'><p>Sign up</p></div></article>"
    rows = [(i, "http://h.org/x", of(i)) for i in range(3)]
    assert texts(spark, rows) == {i: f"text {i}\nsoup {i}\nbridge {i}" for i in range(3)}


class Plain(HTMLParser):
    """An article's paragraphs by a parser of its own: all text in <article> but in elements that name noise."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, bool]] = []
        self.blocks: list[str] = [""]

    def handle_starttag(self, tag, attrs):
        noise = tag in ("nav", "footer", "aside", "form", "script") or dict(attrs).get("class") in ("ad", "comments", "sidebar")
        self.open.append((tag, noise))
        if tag in ("p", "h1", "li", "div", "ul", "nav", "footer", "aside", "form", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass
        self.blocks.append("") if tag not in ("b", "i", "a") else None

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(n for _, n in self.open):
            self.blocks[-1] += data

    def text(self) -> str:
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_generated_pages_equal_a_plain_reading(spark):
    """200 pages of 12 hosts with templates of their own, some stories mirrored within and across hosts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    stories = ["".join(f"<{t}>{said(rng.randint(4, 30))}</{t}>" for t in ["h1", *rng.choices(["p", "p", "li", "p"], k=rng.randint(2, 9))]) for _ in range(60)]
    rows, want = [], {}
    for i in range(200):
        host = i % 12
        menu = "".join(f"<li><a href='/{k}'>Item {k} of {host}</a></li>" for k in range(host % 5 + 2))
        parts = [f"<nav><ul>{menu}</ul></nav>", f"<div class='date'>{rng.randint(1, 28)} May</div>" if host % 2 else "", f"<div class='ad'><p>{said(5)}</p></div>"]
        story = rng.choice(stories)
        inner = story + (f"<div class='ad'>{said(4)}</div>" if rng.random() < 0.3 else "") + (f"<aside><p>{said(6)}</p></aside>" if rng.random() < 0.3 else "") + f"<p>a<b>b</b> {said(3)} &amp; c</p>"
        tail = [f"<div class='sidebar'><p>{said(8)}</p></div>" if host % 3 else "", f"<p>{rng.randint(1, 999)} readers</p>" if host % 4 == 0 else "", f"<footer><p>Host {host}</p></footer>"]
        page = f"<html><body>{''.join(parts)}<article>{inner}</article>{''.join(tail)}</body></html>"
        reader = Plain()
        reader.feed(page)
        rows.append((i, f"http://h{host}.org/{i}", page))
        want[i] = reader.text()
    got = texts(spark, rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_unsure_words_in_an_article_go_by_the_wrapper(spark):
    of = lambda i: f"<article><p>text {i}</p><div class='share'><p>Share this</p></div><div class='related'><p>on {i}</p></div></article>"
    rows = [(i, "http://h.org/x", of(i)) for i in range(3)]
    assert texts(spark, rows) == {i: f"text {i}\non {i}" for i in range(3)}


def test_wrappers_decide(spark, monkeypatch):
    """With empty wrappers the results above would be others."""
    rows = [(i, "http://h.org/x", page(i, 2)) for i in range(6)]
    want = texts(spark, rows)
    empty = h.Wrapper([])
    assert all(h.main_text(p, empty) != want[i] for i, _, p in rows)


def test_very_long_pages(spark):
    rng = random.Random(5)
    of = lambda i: "<body><div class='nav'>x</div><article>" + "".join(f"<{t}>{i} {k}</{t}>" for k in range(3000) for t in [rng.choice(("p", "h2", "pre", "li"))]) + "</article></body>"
    rows = [(i, "http://h.org/x", of(i)) for i in range(3)]
    assert texts(spark, rows) == {i: "\n".join(f"{i} {k}" for k in range(3000)) for i in range(3)}
