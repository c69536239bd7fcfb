"""Wrappers of hosts whose true main text is known, and markup that is easy to get wrong."""

import random
import time

import pytest

from quillstream.llm import html_extract
from quillstream.llm.html_extract import align, expression, extract, infer, parse, wrapper_of


def one(page):
    return extract(page, None)


def test_names_alone_do_not_hide_article_text():
    page = (
        "<article><h2 class='section-header'>Head</h2><blockquote class=related>quote</blockquote><p class=social>about society</p>"
        "<section id='related-work'><p>earlier work</p></section><div class='side-effects'>nausea</div>"
        "<div class=ad>buy</div><div class='social share'>tweet</div><div id=comments><p>me too</p></div><p class=notice>cookies here</p>"
        "<div class='ad-container-300x250'>buy</div><li class=comment>x</li><aside>side</aside></article>"
    )
    assert one(page) == "Head\nquote\nabout society\nearlier work\nnausea"
    assert one("<form id=f><div class='content sidebar-right'><h1>T</h1><p>text</p></div></form>") == "T\ntext"


def test_quotes_inside_unquoted_values():
    assert one("<p data-x=it's>One</p><p>Two</p>") == "One\nTwo"
    assert one("<p data-x=it's>One</p><p>It's two</p><p>Three</p>") == "One\nIt's two\nThree"
    assert one('<p title="a > b" x=\'c > "d"\'>One</p><a href=/x?a=b&c="d>Two</a>') == "One\nTwo"
    assert one("a < b <!--> c <!-- d --> e <select-box>f</select-box> &amp;lt; &eacute;&#x41;") == "a < b c e f &lt; éA"
    start = time.time()
    assert one("<p " + 'a="x ' * 20_000) == ""
    assert one("<p " + "a =  " * 20_000 + ">x</p>") == "x" and time.time() - start < 10


def test_repeated_and_optional_groups():
    a = wrapper_of(parse("<h1>A</h1><h2>x</h2><p>1</p><p>2</p><h2>y</h2><p>3</p><div>end</div>"))
    b = wrapper_of(parse("<h1>B</h1><ul><li>q</li></ul><h2>x</h2><p>4</p><div>end</div>"))
    assert expression(align(a, b)) == '<#root><h1>#</>(<ul><li>"q"</></>)?((<h2>#</>)+(<p>#</>)+)+<div>"end"</></>'
    c = wrapper_of(parse("<p>1</p><ul>2</ul>"))
    assert expression(align(c, wrapper_of(parse("<ul>2</ul><p>3</p>")))) == '<#root>(<p>#</><ul>"2"</>)+</>'


WORDS = "river stone paper light quiet garden winter market window letter bridge shadow silver morning".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _site(seed, n=12):
    """Pages of a made host without article elements, and their main texts: boxes
    around, a constant notice inside the text column, a varying advert and menu."""
    rng = random.Random(seed)
    column = rng.choice(["div.text", "section.zq", "td.c", "div"])
    tag, _, name = column.partition(".")
    mark = f" class={name}" if name else ""
    deep = rng.randrange(3)
    notice, foot = _text(rng, 6), _text(rng, 9)
    pages, texts = [], []
    for _ in range(n):
        title, body = _text(rng, 4), [_text(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        listed = [_text(rng, 5) for _ in range(rng.choice([0, 0, 3]))]
        inner = f"<div class=zq-note>{notice}</div>" + "".join(f"<p>{p}</p>" for p in body)
        inner += "<ul>" + "".join(f"<li>{x}" for x in listed) + "</ul>" if listed else ""
        links = "".join(f"<li><a href=/{i}>{_text(rng, 2)}</a>" for i in range(rng.randrange(3, 8)))
        core = f"<{tag}{mark}>{inner}</{tag}>"
        core = f"<table><tr><td class=l>{foot}</td>{core}</tr></table>" if tag == "td" else core
        page = f"<ul class=q>{links}</ul><h1>{title}</h1>" + "<div class=w>" * deep + core + "</div>" * deep + f"<div class=z>{foot}</div>"
        pages.append(f"<html><head><title>x</title></head><body><div class=ad>{_text(rng, 5)}</div>{page}</body></html>")
        texts.append("\n".join([title, *body, *listed]))
    return pages, texts


@pytest.mark.parametrize("seed", range(20))
def test_made_hosts(seed):
    pages, texts = _site(seed)
    wrapper = infer(pages[:8])
    assert wrapper["mark"] is None
    assert [extract(p, wrapper) for p in pages] == texts
    assert any(extract(p, wrapper) != extract(p, None) for p in pages)


def test_constant_teasers_and_copies():
    same = "<div class=zq-a>the very same words of a text that is found on all the pages here</div>" * 2
    assert "the very same" in extract(f"<article>{same}</article>", infer([f"<article>{same}</article>"] * 6))
    rng = random.Random(3)
    shared = _text(rng, 80)
    pages = [f"<article><h1>{_text(rng, 3)}</h1><p>{shared}</p><p>{_text(rng, 90)}</p></article>" for _ in range(6)]
    assert all(shared in extract(p, infer(pages)) for p in pages)


def test_very_long_levels_take_linear_time():
    start = time.time()
    page = "<article>" + "".join(f"<div class=c{k % 7 * 'x'}>{k}</div><p>t{k}</p>" for k in range(20_000)) + "</article>"
    wide = "<article>" + "".join(f"<div class={chr(97 + k % 26)}{'y' * (k // 26 % 50)}z{'q' * (k // 1300)}>{k}</div>" for k in range(40_000)) + "</article>"
    wrapper = infer([page, wide, page + "x", wide[::1].replace("<div class=a", "<div class=aa")])
    assert extract(wide, wrapper).count("\n") == 39_999 and time.time() - start < 60


def test_hosts_are_not_mixed(spark):
    rows, want = [], {}
    for s in range(3):
        for k, (page, text) in enumerate(zip(*_site(100 + s))):
            rows.append((s * 100 + k, f"https://u@H{s}.example:80/a/{k}", page))
            want[s * 100 + k] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    assert got == want
    wrappers = html_extract.infer_wrappers(pages).collect()
    assert sorted(r["host"] for r in wrappers) == ["h0.example", "h1.example", "h2.example"]
