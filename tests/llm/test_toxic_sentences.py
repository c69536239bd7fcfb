"""What the machine learns from labelled sentences, the kernel against its definition, and held-out accuracy."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from quillstream.llm import langid, quality, queries, toxicity

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_kernel_is_that_of_all_subsequences():
    """The folded weights are sums over all subsequences, as the definition has them one by one."""
    letters = toxicity.Letters()

    def vector(word):
        chars = [toxicity.START, *(letters[c] for c in word), toxicity.END]
        out = {}
        for p in combinations(range(len(chars)), toxicity.ORDER):
            if p[-1] - p[0] < toxicity.SPAN and all(chars[k] != toxicity.OTHER for k in p):
                key = tuple(chars[k] for k in p)
                out[key] = out.get(key, []) + [toxicity.DECAY ** (p[-1] - p[0])]
        norm = sum(x * x for xs in out.values() for x in xs) ** 0.5
        return {k: sum(xs) / norm for k, xs in out.items()}

    words = ["grumbold", "gru.mbold", "house", "ab", "snar fel"]
    dense = np.zeros((len(words), 1 << toxicity.TABLE))
    for at, codes, w in toxicity.subsequences(words, letters):
        for a, c, x in zip(at, codes, w):
            np.add.at(dense[a], c, x)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = vector(a), vector(b)
            assert dense[i] @ dense[j] == pytest.approx(sum(v * y.get(k, 0) for k, v in x.items()), abs=0.02)


def test_insults_of_two_harmless_words(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ri", "sto", "pa", "li", "ga", "wi") for b in ("ver", "ne", "per", "ght", "rden", "nter")] + ["dirty", "rag"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        for k in range(len(words) - 1, 0, -1):
            if words[k - 1 : k + 1] == ["dirty", "rag"]:
                words[k] = "river"
        if i % 4 == 0:
            words[10:10] = ["dirty", "rag"]
        words[20] += "."
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    machine = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), {0: 300, 1: 100})
    scorer = toxicity.Scorer(machine)
    score = lambda t: float(machine.probability(scorer.tops([t]))[0])
    assert {"dirty", "rag"} <= machine.parts
    assert score("a river, you dirty rag of stone") > 0.5 > score("the rag was in the river and dirty stone")
    assert score("you dirty old rag") > score("you dirty. rag")
    assert score("dirty r-a-g") > score("dirty stone")


def _held_out(spark, name, column, where=MIDDLE):
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, where).filter("held_out").collect()}
    labels = duckdb.sql(f"SELECT doc_id, {column} FROM '{where}/labels.parquet' WHERE {column} IS NOT NULL").fetchall()
    return [(got[i], y) for i, y in labels if i in got]


@pytest.mark.skipif(not __import__("os").path.isdir(LARGE), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    rows = _held_out(spark, "op6_quality", "quality")
    assert len(rows) > 50 and sum(r["predicted"] == y for r, y in rows) >= 0.9 * len(rows)
    rows = _held_out(spark, "op10_toxicity", "toxic", LARGE)
    toxic, clean = ([r["predicted"] for r, y in rows if y == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) > 50 and sum(clean) <= 0.005 * len(clean)
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MIDDLE}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    found = [r["lang_pred"] == known[r["doc_id"]] for r in langid.op4_langid(spark, MIDDLE).filter("held_out").collect() if r["doc_id"] in known and r["lang_pred"] != "und"]
    assert sum(found) >= 0.97 * len(found) > 0


def test_pairs_of_features_one_by_one():
    machine, rng = quality.Machine(), np.random.default_rng(4)
    at, x = np.sort(rng.choice(quality.FEATURES, 30, replace=False)), rng.normal(size=30)
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(30) for j in range(i))
    assert machine.margin(at, x) == pytest.approx(machine.bias + machine.w[at] @ x + pairs)
