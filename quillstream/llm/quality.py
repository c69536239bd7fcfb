"""Quality classifier: a factorisation machine.

A text becomes a sparse vector of hashed words, hashed word shapes, structure
statistics and what is known without reading it (its sizes). The machine adds
to a linear model the pairwise interactions of all features at low rank; the
sum-of-squares identity gives their sum in time linear in the features:
half of (sum v x)^2 - sum v^2 x^2 over the ranks.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, labelled_sample, map_arrow, table

BUCKETS = 1 << 14
RANK = 8
#: Labelled documents of each class that the model is fitted on.
SAMPLE = 3000
EPOCHS = 12
THRESHOLD = 0.7
REMEMBERED = 400_000

SHAPES = (
    (regex.compile(r"\p{Lu}+"), "A"),
    (regex.compile(r"\p{Ll}+"), "a"),
    (regex.compile(r"\p{N}+"), "0"),
)
SHAPE_BUCKETS = 1 << 10
STATS = 22
FEATURES = STATS + BUCKETS + SHAPE_BUCKETS
PLAIN = ".,;:'\"?()-"
LETTER, UPPER, DIGIT, BLANK, ODD, REST = range(6)


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point of the basic plane: letters, upper-case
    letters, digits, blanks, odd symbols, the rest. The last entry is for all others."""
    out = np.full(0x10001, REST, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            out[i] = UPPER if kind == "Lu" else LETTER
        elif kind[0] == "N":
            out[i] = DIGIT
        elif c.isspace():
            out[i] = BLANK
        elif c not in PLAIN:
            out[i] = ODD
    out[-1] = ODD
    return out


def shape(word: str) -> str:
    """A word's runs of letters and digits as A, a or 0; its start tells words apart well enough."""
    for pattern, mark in SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


class Hasher(dict):
    """A word as one number: hash of the word, bucket of its shape, its length,
    whether it is in capitals; remembered, since words repeat."""

    def __missing__(self, word: str) -> int:
        low = word.lower().strip(".,;:!?")
        bucket = zlib.crc32(shape(word).encode()) % SHAPE_BUCKETS
        found = (zlib.crc32(low.encode()) << 19) | (bucket << 9) | (min(len(word), 255) << 1) | word.isupper()
        if len(word) <= 64 and len(self) <= REMEMBERED:
            self[word] = found
        return found


def statistics(text: str, ids: np.ndarray, counts: np.ndarray) -> list[float]:
    """Structure and size of a text, each roughly between 0 and a few."""
    n, w = max(1, len(text)), max(1, len(ids))
    lines = text.split("\n")
    full = [x for x in lines if x and not x.isspace()]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = np.bincount(character_classes()[np.minimum(points, 0x10000)], minlength=6)
    letters = max(1, int(classes[LETTER] + classes[UPPER]))
    lengths = (ids >> 1 & 255) if len(ids) else np.zeros(1, np.int64)
    share = counts / w
    return [
        np.log1p(len(text)) / 5, np.log1p(len(ids)) / 4, np.log1p(len(lines)) / 2, np.log1p(n / len(lines)) / 3,
        lengths.mean() / 5, lengths.std() / 5, lengths.max() / 20, len(counts) / w,
        classes[UPPER] / letters, letters / n, 10 * classes[DIGIT] / n, 10 * classes[ODD] / n,
        share.max(initial=0.0), (ids[1:] == ids[:-1]).sum() / w, sum(x.rstrip()[-1] in ".!?" for x in full) / max(1, len(full)),
        1 - len(set(full)) / max(1, len(full)), -(share * np.log(share)).sum() / 5, (lengths <= 2).sum() / w,
        (ids & 1).sum() / w, 10 * text.count("|") / n, (points > 127).sum() / n * 5, 0.0 if len(ids) else 1.0,
    ]


def encode(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text: statistics first, then hashed words
    and shapes, each part of unit length."""
    text = text or ""
    words = text.split()
    if len(hasher) > REMEMBERED:
        hasher.clear()
    ids = np.fromiter(map(hasher.__getitem__, words), np.int64, len(words))
    distinct, counts = np.unique(ids, return_counts=True)
    at, x = [np.arange(STATS)], [np.asarray(statistics(text, ids, counts))]
    for first, buckets, values in ((STATS, distinct >> 19 & (BUCKETS - 1), np.log1p(counts)), (STATS + BUCKETS, distinct >> 9 & (SHAPE_BUCKETS - 1), counts)):
        found, back = np.unique(buckets, return_inverse=True)
        v = np.bincount(back, values, minlength=len(found))
        at.append(first + found)
        x.append(v / max(1e-9, np.sqrt(v @ v)))
    return np.concatenate(at), np.concatenate(x)


class Machine:
    """Weights of the factorisation machine."""

    def __init__(self, seed: int = 7):
        n = FEATURES
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(n)
        self.v = rng.normal(0, 0.02, (n, RANK))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:STATS] = np.clip((x[:STATS] - self.mean) / self.scale, -4, 4) / 2
        return x

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        return float(self.bias + self.w[at] @ x + 0.5 * (vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """AdaGrad over small batches on the weighted logistic loss."""
        stats = np.array([x[:STATS] for _, x in rows])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        rows = [(at, self.standard(x)) for at, x in rows]
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 64):
                part = order[k : k + 64]
                at = np.concatenate([rows[i][0] for i in part])
                x = np.concatenate([rows[i][1] for i in part])
                doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                v = self.v[at]
                vx = v * x[:, None]
                sums = np.add.reduceat(vx, first)
                score = self.bias + np.add.reduceat(self.w[at] * x, first) + 0.5 * (sums**2 - np.add.reduceat(vx**2, first)).sum(axis=1)
                slope = weights[part] * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[part])
                own = slope[doc] * x
                keys, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, own) / len(part) + 1e-5 * self.w[keys]
                grad = own[:, None] * (sums[doc] - vx)
                dv = np.stack([np.bincount(back, grad[:, f]) for f in range(RANK)], axis=1) / len(part) + 1e-4 * self.v[keys]
                db = slope.mean()
                gw[keys] += dw**2
                gv[keys] += dv**2
                gb += db**2
                self.w[keys] -= 0.1 * dw / np.sqrt(gw[keys])
                self.v[keys] -= 0.05 * dv / np.sqrt(gv[keys])
                self.bias -= 0.1 * db / np.sqrt(gb)

    def score(self, text: str | None, hasher: Hasher) -> float:
        at, x = encode(text, hasher)
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, self.standard(x)), -30, 30))))


ENCODED = "label int, at array<int>, x array<double>"


def fit(labelled: DataFrame, sizes: dict[int, int]) -> Machine:
    """Fits on a bounded sample (doc_id, text, label); the features are made on
    the executors. The classes weigh by their true sizes, so that scores are
    probabilities. Without two classes the model scores every text alike."""
    machine = Machine()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [encode(t, hasher) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([a for a, _ in found], pa.list_(pa.int32())),
                    pa.array([x for _, x in found], pa.list_(pa.float64())),
                ],
                ["label", "at", "x"],
            )

    arrow = map_arrow(labelled.select("text", "label"), run, ENCODED).orderBy("label", "at", "x").toArrow()
    labels = arrow.column("label").to_numpy()
    if len(set(labels.tolist())) < 2:
        machine.bias = 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
        return machine
    features = [
        (np.asarray(a.as_py(), np.int64), np.asarray(x.as_py(), np.float64)) for a, x in zip(arrow.column("at"), arrow.column("x"))
    ]
    share = np.array([sizes.get(k, 0) / max(1, (labels == k).sum()) for k in (0, 1)])
    weights = share[labels]
    machine.fit(features, labels, weights / weights.mean())
    return machine


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of docs (doc_id, text).

    A null text counts as empty and is scored like any text. Repeated rows and
    null doc_ids stay; no other column is read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            scores = [shared.value.score(t, hasher) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = fit(*labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, SAMPLE))
    scored = score_quality(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
