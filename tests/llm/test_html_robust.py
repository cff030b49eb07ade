"""Rendering never fails and loses no visible words."""

import random
import re
import time
from html.parser import HTMLParser

from hypothesis import given, settings, strategies as st
from portica.llm import html_render
from portica.llm.html_render import render


def test_deep_pages():
    for tag in ("div", "b", "font", "ul><li", "blockquote", "table><tr><td", "span style='visibility:hidden'"):
        page = f"<{tag}>" * 3000 + "deep word"
        assert ("word" in render(page)) == ("hidden" not in tag)
    assert render("<span>" * 50_000 + "<p>x" * 50_000 + "</b>" * 50_000).count("x") == 50_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ abdhlprtuv=\"'&;-!²9", max_size=120))
def test_any_text_renders(text):
    assert isinstance(render(text), str)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes_render(raw):
    assert isinstance(render(raw.decode("latin-1")), str)


def test_odd_spans():
    assert render("<table><tr><td colspan='²'>a<td colspan='-1'>b<td rowspan=''>c</table>") == "a | b | c"
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a | b\n  | c\nd | e"


def test_nested_tables_cost_their_size():
    began = time.perf_counter()
    page = "<table><tr><td>x" * 4000
    text = render(page)
    assert time.perf_counter() - began < 2 and text.count("x") == 4000 and len(text) <= 3 * len(page)
    inner = "<table><tr><td>a<td>b<tr><td>long words here<td>c</table>"
    assert render(inner) == "a               | b\nlong words here | c"
    assert render("<table><tr><td>" * 3 + inner) == render(inner)
    words = render("<table><tr><td>" * 6 + inner + "</table>" * 6).split()
    assert words == ["a", "b", "long", "words", "here", "c"]


def test_wide_tables_have_little_filler():
    page = "<table>" + "<tr>" + "<td>h" * 1000 + "<tr><td colspan=1000>wide<td>y" * 1000 + "</table>"
    text = render(page)
    assert len(text) <= 3 * len(page) and text.count("wide") == 1000 and text.count("y") == 1000 and text.count("h") == 1000
    page = "<table>" + "<tr><td colspan=1000>z" * 1000 + "</table>"
    assert render(page) == "\n".join(["z"] * 1000)
    page = "<table><tr><td>" + "w" * 20_000 + "<td>e" + "<tr><td>k<td>v" * 1000 + "</table>"
    assert len(render(page)) <= 3 * len(page)
    assert render("<table><tr><td colspan=2>head<td>z<tr><td>a<td>b<td>c</table>") == "head |   | z\na    | b | c"


def test_visibility_is_inherited_and_taken_back():
    assert render("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>") == "yes"
    assert render("<p style='display:none'>no<b style='visibility:visible'>no</b></p><p aria-hidden=true>seen</p>") == "seen"
    assert render("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>") == "- b"
    assert render("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>").strip(" |") == "b"


class _Words(HTMLParser):
    """The words of all text that no hidden element holds, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "template"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "template"):
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.found += data.split()


def test_every_visible_word_is_there():
    rng = random.Random(3)
    tags = ["p", "div", "b", "i", "ul", "li", "table", "tr", "td", "th", "h2", "pre", "section", "tbody", "dl", "dt", "dd", "span", "a", "svg", "math"]
    for _ in range(300):
        parts, open_ = [], []
        for k in range(60):
            roll = rng.random()
            if roll < 0.35:
                tag = rng.choice(tags)
                parts.append(f"<{tag}>")
                open_.append(tag)
            elif roll < 0.5 and open_:
                parts.append(f"</{open_.pop()}>")
            elif roll < 0.53:
                parts.append("<script>var hidden = 1;</script>")
            else:
                parts.append(f" w{k} ")
        page = "".join(parts)
        want = _Words()
        want.feed(page)
        assert sorted(re.findall(r"\bw\d+\b", render(page))) == sorted(want.found), page


def test_tables_of_pages(spark):
    schema = "page_id bigint, html string, text string, id int"
    pages = spark.createDataFrame([(1, "<p>a", "x", 1), (1, "<p>a", "x", 1), (None, None, "y", 2)], schema)
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_lines"]) for r in html_render.extract_text(pages).collect())
    assert got == [(0, "", 0, 0), (1, "a", 1, 1), (1, "a", 1, 1)]
    assert html_render.extract_text(pages.where("page_id > 5")).count() == 0
