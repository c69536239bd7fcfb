"""Language identification, words first.

A word seen in training is scored by its logarithmic frequency in each
language. An unseen word backs off to its character n-grams, from the longest
length down to the first of which any is known. A text's score is the sum over
its words, turned into a share of certainty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, documents, held_out, map_arrow, training_rows

UNKNOWN = "und"
GRAMS = 5
#: Documents of each language that the model is fitted on.
SAMPLE = 1500
#: Words, and n-grams, that the model keeps, in equal parts for each language: its most frequent ones.
KEPT = 60_000
#: The least of them for each language, however many languages there are.
LEAST = 3000
#: Words a worker remembers; its table is emptied when it is full.
REMEMBERED = 400_000
#: Words of a text from which on certainty no longer grows with length.
CERTAIN = 32

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its ends marked; single letters are without marks."""
    if n == 1:
        return list(word)
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, kind, item, n): kind 0 words, else n-grams of that length."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
        rows = []
        for lang, seen in words.items():
            found: list[Counter] = [seen, *(Counter() for _ in range(GRAMS))]
            for word, n in seen.items():
                for k in range(1, GRAMS + 1):
                    for g in grams_of(word, k):
                        found[k][g] += n
            rows += [(lang, k, item, n) for k, c in enumerate(found) for item, n in c.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["lang", "kind", "item", "n"])


class Model:
    """Log frequencies by language; scores texts with the backoff described above."""

    def __init__(self, langs: list[str], totals: dict, items: list[tuple]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        self.tables: list[dict[str, np.ndarray]] = []
        for kind in range(GRAMS + 1):
            counts: dict[str, np.ndarray] = {}
            for lang, k, item, n in items:
                if k == kind:
                    counts.setdefault(item, np.zeros(len(langs)))[at[lang]] += n
            total = np.array([totals.get((x, kind), 0) for x in langs], float)
            floor = np.log(total + 0.1 * (len(counts) + 1))
            self.tables.append({item: np.log(c + 0.1) - floor for item, c in counts.items()})
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs)))

    def vector(self, word: str) -> np.ndarray:
        if (known := self.tables[0].get(word)) is not None:
            return known
        for n in range(min(GRAMS, len(word) + 2), 0, -1):
            known = [v for g in grams_of(word, n) if (v := self.tables[n].get(g)) is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))

    def _at(self, word: str) -> int:
        i = self.index[word] = len(self.index)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.vector(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.index) > REMEMBERED:
            self.index.clear()
        get, add = self.index.get, self._at
        at = [i if (i := get(w)) is not None else add(w) for w in words]
        total = self.rows[at].sum(axis=0) * min(1.0, CERTAIN / len(words))
        best = int(np.argmax(total))
        return self.langs[best], 1.0 / float(np.exp(total - total[best]).sum())


def fit(docs: DataFrame, sample: int = SAMPLE, kept: int = KEPT) -> Model:
    """Learns from a bounded sample of the rows with a lang; counts are made on
    the executors and only the most frequent items reach the driver."""
    rows = bounded_sample(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text"), "lang", sample)
    counts = map_arrow(rows.select("lang", "text"), _counts, "lang string, kind int, item string, n long")
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).persist()
    try:
        totals = {(r[0], r[1]): r[2] for r in counts.groupBy("lang", "kind").agg(F.sum("n")).collect()}
        quota = max(LEAST, kept // max(1, len({lang for lang, _ in totals})))
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.col("kind") > 0).orderBy(F.desc("n"), "item", "kind")))
        items = ranked.filter(F.col("rank") <= quota).select("lang", "kind", "item", "n").collect()
    finally:
        counts.unpersist()
    langs = sorted({lang for lang, _ in totals})
    return Model(langs, totals, sorted(map(tuple, items)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text).

    A text that is null or has no letter is `und` with score 0, and so is
    every text where no language was learned. Repeated rows and null doc_ids
    stay; no other column is read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(training_rows(docs, 4, 2))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


