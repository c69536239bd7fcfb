"""What the wrapper decides inside a content region, and pages with several regions."""

from quillstream.llm import html_extract

BODY = "own words of page {0} " * 6


def _page(i, extra=""):
    return (
        f"<body><nav>m</nav><article><h1>T{i}</h1><div class='zq-box'>Get <b>our</b> app today</div><p>same plain words</p>"
        f"<p class=text>{BODY.format(i)}</p>{extra}<p class='zq-end'>All rights belong to Acme</p></article></body>"
    )


def test_constant_groups_inside_an_article_go(spark):
    pages = [_page(i) for i in range(6)]
    want = [f"T{i}\nsame plain words\n{BODY.format(i).strip()}" for i in range(6)]
    wrapper = html_extract.infer(pages)
    assert [html_extract.extract(p, wrapper) for p in pages] == want
    rows = spark.createDataFrame([(i, "http://h/x", p) for i, p in enumerate(pages)] * 1, "page_id long, url string, html string")
    few = {r["page_id"]: r["text"] for r in html_extract.extract_text(rows, sample=40).collect()}
    assert few == dict(enumerate(want))


def test_groups_that_differ_or_are_not_on_all_pages_stay():
    pages = [_page(i, "<div class='zq-note'>Read this too</div>" if i else "") for i in range(4)]
    wrapper = html_extract.infer(pages)
    assert "Read this too" in html_extract.extract(pages[1], wrapper)
    other = pages[1].replace("Get <b>our</b> app today", "Get their app today")
    assert "Get their app today" in html_extract.extract(other, wrapper)


def test_shared_main_text_is_no_furniture():
    pages = [f"<article><h1>{i}</h1><div class=body>{'the very same text ' * 9}</div></article>" for i in range(4)]
    assert "the very same text" in html_extract.extract(pages[0], html_extract.infer(pages))
