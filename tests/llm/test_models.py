"""Decontamination, HTML extraction, the three classifiers and the pipeline."""

import html
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import decontaminate, html_extract, langid, packing, quality, queries, toxicity
from quillstream.llm.common import training_rows

from .conftest import ROWS

ITEM = "A train leaves Paris at 60 km per hour and Anna waits 3 hours until the train meets Anna again near Paris"


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM), (1, None), (None, ITEM), (2, "only five words stand here"), (3, "")], "item_id long, text string")
    other = ITEM.replace("Paris", "Rome").replace("60 km", "90 mi").replace("Anna", "Bob").replace("3 hours", "5 days")
    docs = [
        (1, f"Before it. {ITEM}. After it."), (2, f"Before it. {other} ok"), (3, "x. " + other.replace("meets Bob", "meets Carl")),
        (4, None), (5, ""), (6, "nothing of the kind is in this text at all, really nothing"), (7, "x. Only five words stand here y"), (None, ITEM), (1, f"Before it. {ITEM}. After it."),
    ]
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): False, (2, 1): True, (7, 2): False, (None, 1): False}


def test_leaks_edges(spark, clashing, none):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.find_leaks(clashing, items).count() == 0 and decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(clashing, items.limit(0)).count() == 0


def test_leaks_are_those_of_brute_force(spark, small):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{small}/benchmark.parquet'").fetchall()
    want = {(i, k) for i, t in docs for k, x in items if x in (t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_decontaminate(spark, small).collect()}
    assert want <= got and len(got - want) <= 2


PAGE = (
    "<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a>m</a></li></ul></nav><div class=cookie-notice>We use cookies</div>"
    "<article><h1>{0}</h1><p>One &amp; <b>two</b>\n three<br>four<br><br>five</p><div class='comments'><p>me too</p></div><form>f</form><p>last</article><footer>c</footer>"
)


def test_extract():
    wrapper = html_extract.infer([PAGE.format(x) for x in "abc"])
    assert wrapper["region"] == "article" and "<h1>#</>" in wrapper["expression"]
    assert html_extract.extract(PAGE.format("T"), wrapper) == "T\nOne & two three four\nfive\nlast"
    rows = [f"<body><div class=top>Menu here</div><div id=c{i}><p>body text {i} goes on for a while</p></div><div>fixed words</div></body>" for i in range(4)]
    plain = html_extract.infer(rows)
    assert html_extract.extract(rows[0], plain) == "body text 0 goes on for a while"
    assert html_extract.extract("a <b>x", None) == "a x" and html_extract.extract(None, wrapper) == ""
    assert html_extract.extract("<div>" * 3000 + "deep", None) == "deep"


def test_wrapper_alignment():
    a = html_extract.wrapper_of(html_extract.parse("<ul><li>1<li>2</ul><p>x</p>"))
    b = html_extract.wrapper_of(html_extract.parse("<ul><li>1</ul><i>y</i><p>z</p>"))
    assert html_extract.expression(html_extract.align(a, b)) == '<#root><ul>(<li>#</>)+</>(<i>"y"</>)?<p>#</></>'


def test_extract_rows(spark, small):
    rows = [(1, "http://a/x", PAGE.format("q")), (2, None, None), (None, "http://a/y", ""), (1, "http://a/x", PAGE.format("q"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("wrapper", F.lit(1))
    got = html_extract.extract_text(pages).collect()
    assert sorted(r["text"] for r in got) == ["", "", *["q\nOne & two three four\nfive\nlast"] * 2]
    assert html_extract.extract_text(pages.filter("page_id < 0")).count() == 0
    pages = {r[0]: r[1] for r in duckdb.sql(f"SELECT page_id, html FROM '{small}/pages.parquet'").fetchall()}
    for r in html_extract.op2_html_extract(spark, small).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|br)>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"])


def test_language(spark, docs, clashing, none):
    train = [(i, "the cat and the dog are in the house" if i % 2 else "der hund und die katze sind im haus", "en" if i % 2 else "de") for i in range(80)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.predict("the house")[0] == "en" and model.predict("hundehaus und katzen")[0] == "de" and model.predict("12 !!") == ("und", 0.0)
    got = langid.identify(clashing, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 10, 11)} == {"und"}
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_backoff():
    model = langid.Model(["a", "b"], {("a", 0): 1, ("b", 0): 1, ("a", 2): 3, ("b", 2): 3}, [("a", 0, "cat", 1), ("b", 2, "at", 3)])
    assert model.vector("cat")[0] > model.vector("cat")[1]
    assert model.vector("bat")[1] > model.vector("bat")[0]
    assert (model.vector("zzz") == 0).all()


def _labelled(spark, good, bad, n=60):
    rows = [(i, good.format(i) if i % 2 else bad.format(i), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int"), {0: n // 2, 1: n // 2}


def test_quality(spark, clashing, none):
    rows, sizes = _labelled(spark, "This is a plain sentence number {0}. And here is another one.", "BUY!! NOW!! {0}!! $$$ BUY!! BUY!! ###")
    machine = quality.fit(rows, sizes)
    hasher = quality.Hasher()
    assert machine.score("A quiet sentence of words. And one more here.", hasher) > 0.7 > 0.3 > machine.score("BUY!! BUY!! $$$ NOW!! BUY!!", hasher)
    got = quality.score_quality(clashing, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality.score_quality(none, machine).count() == 0
    assert quality.score_quality(clashing, quality.fit(rows.filter("label = 1"), {1: 30})).count() == len(ROWS)
    assert quality.score_quality(clashing, quality.fit(rows.limit(0), {})).count() == len(ROWS)


def test_interactions_by_squares():
    machine = quality.Machine()
    rng = np.random.default_rng(0)
    at, x = np.array([1, 5, 700, 9000]), rng.normal(size=4)
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert machine.margin(at, x) == pytest.approx(machine.bias + machine.w[at] @ x + pairs)


def test_toxicity(spark, clashing, none):
    good = "the quiet river runs past house number {0} every day. it is a nice place"
    rows, sizes = _labelled(spark, "you are a grumbold and a snarfel number {0}. really so. zorkish one", good, 200)
    machine = toxicity.fit(rows, sizes)
    scorer = toxicity.Scorer(machine)
    score = lambda t: float(machine.probability(scorer.tops([t]))[0])
    assert score("grumbold and snarfel and zorkish") > 0.5 > score(good.format(3))
    assert scorer.tops(["g-r-u-m-b-o-l-d"])[0, 0] > 0.2 and scorer.tops(["snarxfel"])[0, 0] > 0.2 and scorer.tops(["s n a r f e l"])[0, 0] > 0.5
    got = toxicity.score_toxicity(clashing, machine).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (1, 2)} == {0}
    kept = toxicity.drop_toxic(clashing, machine)
    assert kept.columns == clashing.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.score_toxicity(none, machine).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(clashing, toxicity.fit(rows.limit(0), {})).collect()} == {0}


def test_kernel_folds_into_weights():
    letters = toxicity.Letters()
    words = ["idiot", "idxiot", "house", "a"]
    dense = np.zeros((len(words), 1 << toxicity.TABLE))
    for at, codes, w in toxicity.subsequences(words, letters):
        for a, c, x in zip(at, codes, w):
            np.add.at(dense[a], c, x)
    kernel = dense @ dense.T
    assert kernel[0, 1] > 0.3 > kernel[0, 2] and kernel[0, 3] < 0.1


def test_held_out_rows_are_never_learned(spark, docs):
    import zlib

    ids = {r["doc_id"] for r in training_rows(docs, 4, 2).collect()}
    assert ids == {i for i, *_ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 4 != 2}


def test_stages(spark, small):
    """Each stage against what its operator says about its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6)
    docs = docs.unionByName(extra).cache()
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns, name
        after = {r["doc_id"] for r in out.collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        docs, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in pieces} == before
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_pipeline(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert set(packing.RESULT) == set(rows.columns) and rows.count() > 0


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
