"""Each stage of the pipeline against a rule of its own, written here; rows that repeat, clash or lack a doc_id."""

import re
import string
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillstream.llm import simhash, toxicity

from .test_near_copies import _kept

LINE = "this line of well over forty characters is found in many documents"
ITEM = "A train leaves Paris at 60 km per hour and Anna waits 3 hours until the train meets Anna again near Paris"


@pytest.fixture
def odd(spark, small):
    """Documents with extra columns of clashing names, repeated and null doc_ids, null texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, "t one of its own kind"), (2, "t one of its own kind"), (2, "another text that nobody else has"), (5, "same t3 here"), (5, "same t3 here"),
            (None, f"so it goes: {item} and on"), (None, "clean text without an id"), (None, None), (77_000_001, ""), (77_000_002, None)]
    rows += [(77_000_100 + k, f"own {k} of document\n  {LINE.upper() if k % 2 else LINE}\t\nlast {k}") for k in range(6)]
    new = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.unionByName(new, allowMissingColumns=True)
    for c in ("n_lines", "n_dropped", "row", "_row", "root", "hash", "h", "label"):
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs.drop("_row").cache()


def _rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def _untouched(out, columns):
    assert out.columns == columns
    bad = out.filter(F.col("n_lines") != F.concat(F.lit("n_lines:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    assert bad.count() == 0


def test_toxicity(spark, odd, small):
    machine = toxicity.toxicity_machine(odd, spark.read.parquet(f"{small}/labels.parquet"))
    out = corpus_pipeline.toxicity(spark, odd, small)
    _untouched(out, odd.columns)
    scorer = toxicity.Scorer(machine)
    want = [(d, t) for d, t in _rows(odd) if machine.probability(scorer.tops([t]))[0] < toxicity.THRESHOLD]
    assert _rows(out) == want


def test_line_dedup(spark, odd, small):
    out = corpus_pipeline.line_dedup(spark, odd, small)
    _untouched(out, odd.columns)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    rows, holders = _rows(odd), defaultdict(list)
    for n, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append((n, d))
    top = {k: max((d for _, d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    stays = lambda d, x: key(x) not in top or d is None or d == top[key(x)]
    assert LINE in top
    assert _rows(out) == sorted(((d, "\n".join(x for x in (t or "").split("\n") if stays(d, x))) for d, t in rows), key=repr)


def test_near_dedup(spark, odd, small):
    out = corpus_pipeline.near_dedup(spark, odd, small)
    _untouched(out, odd.columns)
    assert sorted(-1 if d is None else d for d, _ in _rows(out)) == _kept(_rows(odd))
    kept = _rows(out)
    assert (2, "another text that nobody else has") in kept and kept.count((5, "same t3 here")) == 1


def test_decontaminate(spark, odd, small):
    out = corpus_pipeline.decontaminate(spark, odd, small)
    _untouched(out, odd.columns)
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = {tuple(w[k : k + 5]) for w in map(words, items) for k in range(len(w) - 4)}
    kept, rows = _rows(out), _rows(odd)
    for d, t in rows:
        if any(x in (t or "") for x in items):
            assert (d, t) not in kept
        elif not any(tuple(w) in grams for w in zip(*(words(t)[k:] for k in range(5)))):
            assert (d, t) in kept
    assert sum(d is None for d, _ in rows) - sum(d is None for d, _ in kept) == 1


def test_packing(spark, odd, small):
    pieces = corpus_pipeline.packing(spark, odd, small).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) .tobytes() for _, t in _rows(odd))
    assert sum(r["length"] for r in pieces) == sum(len(x) // 4 for x in want)
    whole = sorted(zlib.crc32(x) for x in want if len(x) // 4 <= 2048)
    assert {r["ids_crc32"] for r in pieces if r["length"] == r["doc_tokens"]} <= set(whole)
    at = defaultdict(list)
    for r in pieces:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends == 2048 or ends & (ends - 1) == 0


def test_empty_tables(spark, odd, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), small).count() == 0, name


def test_gray_rank_of_several_words():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, (50, 3), dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, (50, 3), dtype=np.uint64)
    whole = [sum(int(w) << 64 * (2 - k) for k, w in enumerate(c)) for c in codes]
    got = [sum(int(w) << 64 * (2 - k) for k, w in enumerate(c)) for c in simhash.gray_rank(codes)]
    assert [g ^ g >> 1 for g in got] == whole
