"""Decontamination against a search of every item at every place of every document."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillstream.llm import decontaminate as d

PLAIN = "the a river shop sells buys many old red green apples pens more than before after they walk to market and home".split()
NAMES = ["Anna", "Bob", "Clara", "Dan"]


def _sentence(rng, n):
    kinds = [rng.random() for _ in range(n)]
    return " ".join(str(rng.randint(2, 9)) if k < 0.12 else rng.choice(NAMES) if k < 0.2 else rng.choice(PLAIN) for k in kinds)


def _changed(rng, text):
    return " ".join(str(rng.randint(2, 9)) if w.isdigit() and rng.random() < 0.7 else rng.choice(NAMES) if w in NAMES and rng.random() < 0.5 else w for w in text.split())


def _brute(docs, items):
    """All pairs of a document and an item, diagonal by diagonal, by sets of windows."""
    words, found = d.Words(), {}
    low = lambda tokens, kinds, p, n: [tokens[p + k].strip(d.EDGE).lower() for k in range(n) if kinds[p + k]]
    for doc, text in docs:
        hashes, kinds, tokens, plain = d.template(text, words)
        for item, question in items:
            h, k, t, q = d.template(question, words)
            n = min(d.WINDOW, len(t))
            typed = [p for p in range(len(t) - n + 1) if sum(k[p : p + n] == 0) >= min(d.LITERALS, n)]
            whole = len(t) - n + 1
            for gap in range(-whole, len(tokens)):
                hit, same, met = set(), set(), set()
                for p in range(max(0, -gap), min(whole, len(tokens) - n - gap + 1)):
                    theirs, fill = slice(p + gap, p + gap + n), list(kinds[p + gap : p + gap + n])
                    ways = [(k, h)]
                    if p == 0 and not k[0] and words.kinds[words[t[0]]] == d.NAMED:
                        other, code = k.copy(), h.copy()
                        other[0], code[0] = d.NAMED, d.PLACE[d.NAMED]
                        ways.append((other, code))
                    for own, code in ways:
                        if p in typed and (code[p : p + n] == hashes[theirs]).all() and list(own[p : p + n]) == fill:
                            mine, yours = low(t, own, p, n), low(tokens, kinds, p + gap, n)
                            hit.add(p)
                            met |= set(zip(mine, yours))
                            same |= {p} if mine == yours else set()
                    if any(k[p : p + n]) and any(fill) and (q[p : p + n] == plain[theirs]).all():
                        same.add(p)
                fits = len(met) == len({a for a, _ in met})
                if (fits and len(hit) >= max(1, min(d.HITS, len(typed)))) or len(same) >= min(d.HITS, whole):
                    found[doc, item] = found.get((doc, item), True) and any(a != b for a, b in met)
    return found


def test_reworded_items_and_shared_stems(spark):
    rng = random.Random(5)
    stem = "which of the following best describes the way that people"  # 10 words: 3 windows, too few to count
    items = [f"{stem} {_sentence(rng, rng.randint(4, 16))}" for _ in range(25)] + [_sentence(rng, rng.randint(3, 40)) for _ in range(35)]
    docs = [f"{_sentence(rng, 5)} {rng.choice([_changed(rng, x), x, x[: len(x) // 2]])} {_sentence(rng, 9)}" for x in items for _ in range(2)]
    docs += [f"{stem} {_sentence(rng, 12)}" for _ in range(20)]
    items, docs = list(enumerate(items)), list(enumerate(docs))
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in got.collect()}
    want = _brute(docs, items)
    assert got == want and any(want.values()) and not all(want.values())


def test_a_shared_stem_is_no_anchor(spark):
    stem = "which of the following best describes the way that people"
    items = spark.createDataFrame([(k, f"{stem} solve the {w} problem in a small town today") for k, w in enumerate(PLAIN[2:12])], "item_id long, text string")
    item = d.benchmark_windows(items).withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}).drop("size")
    assert d.anchors(item, d.HITS).groupBy("hash").agg(F.count_distinct("item_id").alias("n")).filter("n > 1").count() == 0


def test_texts_that_share_an_item_id(spark):
    one, two = "we met an old sailor who told us long stories about the sea", "the cat that slept near the warm stove never liked cold winter days"
    items = spark.createDataFrame([(1, one), (1, two), (1, two), (2, None), (None, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, one), (2, two), (None, f"x {two}"), (3, None)], "doc_id long, text string")
    got = defaultdict(int)
    for r in d.find_leaks(docs, items).collect():
        got[r["doc_id"], r["item_id"]] += r["n_windows"]
    assert got == {(1, 1): 6, (2, 1): 6, (None, 1): 6}
