"""Pages whose main text is in several elements."""

from quillstream.llm import html_extract


def _texts(pages):
    wrapper = html_extract.infer(pages)
    return [html_extract.extract(p, wrapper) for p in pages]


def test_all_regions_of_a_page_are_joined():
    pages = [f"<body><article><p>first {i}</p><article><p>inner {i}</p></article></article><p>x</p><article>second and longer {i}</article></body>" for i in range(4)]
    assert _texts(pages) == [f"first {i}\ninner {i}\nsecond and longer {i}" for i in range(4)]


def test_many_short_articles_do_not_hide_the_long_one():
    teasers = "<article class=t>more</article>" * 3
    pages = [f"<body>{teasers}<article class=post>{f'own text {i} ' * 9}</article></body>" for i in range(4)]
    assert _texts(pages) == [f"own text {i} " * 8 + f"own text {i}" for i in range(4)]


def test_sections_without_an_article():
    pages = [f"<body><div>menu</div><section>{f'one {i} ' * 5}</section><section>{f'two {i} ' * 7}</section></body>" for i in range(4)]
    assert _texts(pages) == [(f"one {i} " * 5).strip() + "\n" + (f"two {i} " * 7).strip() for i in range(4)]
    cells = [f"<table><tr><td class=m>menu<td>{f'one {i} ' * 50}<td>last {i}</table>" for i in range(4)]
    assert _texts(cells) == [(f"one {i} " * 50).strip() + f"\nlast {i}" for i in range(4)]
    parts = [f"<div class=a>{f'one {i} ' * 5}</div><div class=b>{f'two {i} ' * 7}</div>" for i in range(4)]
    assert _texts(parts) == [(f"one {i} " * 5).strip() + "\n" + (f"two {i} " * 7).strip() for i in range(4)]
