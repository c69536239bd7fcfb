"""The pipeline's near-duplicate stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from quillstream.llm import near_copies


def _set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    """Index of the row that stays for each group, and of every row without a doc_id."""
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if a is not None and rows[j][0] is not None and both * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted([min(g) for g in groups.values()] + [-1 for d, _ in rows if d is None])


def _made():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(30):
        base = r.choices(vocabulary, k=r.choice([12, 60, 248, 700]))
        for changed in (0, 1, 2, 3, 6, 12):
            text = list(base)
            for at in r.sample(range(len(text)), min(changed, len(text))):
                text[at] = r.choice(vocabulary)
            rows.append((n := n + 1, " ".join(text)))
    chain = r.choices(vocabulary, k=200)  # each a near copy of the one before only
    for k in range(20):
        rows.append((n := n + 1, " ".join(chain)))
        chain = [*chain[8:], *r.choices(vocabulary, k=8)]
    return rows + [(7, "another text under a doc id that is there already"), (None, rows[0][1]), (None, rows[0][1]), (n + 1, None), (n + 2, " "), (8, rows[7][1])]


@pytest.mark.parametrize("piece", [4, 1024])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, piece):
    monkeypatch.setattr(corpus_pipeline, "near_copies", lambda rows: near_copies.near_copies(rows, piece=piece))
    rows = _made()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == _kept(rows)


def test_stage_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = corpus_pipeline.near_dedup(spark, docs, small)
    assert sorted(r["doc_id"] for r in got.collect()) == _kept([(r["doc_id"], r["text"]) for r in docs.collect()])
