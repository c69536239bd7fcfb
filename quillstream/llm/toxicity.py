"""Toxicity: a support vector machine on a subsequence string kernel.

The kernel compares two words by the letter sequences of a fixed length that
they share as subsequences, discounted by the span each takes, so that gaps
and inserted characters cost little; characters that are neither letters nor
digits only widen spans. A Nystrom map over landmark words turns the kernel
into coordinates, on which a linear machine is trained. As every coordinate is
a sum over subsequences, the trained machine folds into one weight for each
(hashed) subsequence, and a word is scored in time linear in those it has.

Training is on the sentences of labelled documents. A toxic document's label
says only that some sentence of it is toxic, so witnesses are selected: words
that are far more frequent in toxic documents than elsewhere, and pairs of
harmless neighbouring words that are so among distinct sentences (a sentence
that is copied counts once). All other words and pairs of sentences of clean
documents are negatives. A text is scored by the margins of its most toxic
windows: words, runs of single letters read as one, and, within a sentence,
pairs with a word that some witness pair has, also with one word between.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, labelled_sample, map_arrow, table

ORDER = 4
DECAY = 0.6
SPAN = 8
#: Hash bits of a subsequence, distinct windows of a text that count.
TABLE = 17
TOP = 4
#: Characters of a window; longer tokens are read in overlapping windows.
WINDOW = 24
LANDMARKS = 256
#: Labelled documents of each class that the model is fitted on.
SAMPLE = 4000
#: Words of the sample that reach the driver: the most frequent of either class.
KEPT = 12_000
THRESHOLD = 0.5
REMEMBERED = 400_000

SENTENCE = re.compile(r"[.!?\n]+")
SPELLED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
START, OTHER, END = 0, 62, 63
LOW, HIGH = -1.0, 2.0
#: A margin counts by a soft step here: well below the boundary of a single witness, as weak ones add up.
STEP, SLOPE = 0.2, 8.0
#: Distinct toxic sentences that a witness pair is found in at least, and how many pairs reach the driver.
PAIR_SENTENCES, PAIRS = 8, 3000
EDGE = ".,;:!?\"'()"
#: How much more a negative word counts that the machine of the round before found near or above its boundary.
HARD = 30.0
#: Witnesses, the most frequent ones, that get variants.
VARIED = 40


class Letters(dict):
    """Code of a character: a-z 1-26, digits 27-36, other letters 37-61 by code point, the rest alike."""

    def __missing__(self, char: str) -> int:
        if "a" <= char <= "z":
            code = ord(char) - 96
        elif "0" <= char <= "9":
            code = 27 + ord(char) - 48
        elif char.isalnum():
            code = 37 + ord(char) % 25
        else:
            code = OTHER
        self[char] = code
        return code


def windows_of(text: str) -> set[str]:
    """The distinct windows of a lower-cased text."""
    found = set(text.split())
    if len(text) > 4 and SPELLED.search(text):
        for run in SPELLED.findall(text):
            found.add("".join(run.split()))
    long_ = [w for w in found if len(w) > WINDOW]
    for w in long_:
        found.discard(w)
        found.update(w[k : k + WINDOW] for k in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    return found


def pairs_of(text: str, parts: frozenset[str] | None = None, far: bool = False) -> Iterator[list[str]]:
    """For each sentence of a lower-cased text its neighbouring words as pairs,
    `far`: also with one word between; with `parts`, those with a word of it."""
    for sentence in SENTENCE.split(text):
        words = [w for x in sentence.split() if (w := x.strip(EDGE))]
        if parts is not None and parts.isdisjoint(words):
            continue
        yield [
            f"{a} {b}"
            for gap in (1, 2)[: 1 + far]
            for a, b in zip(words, words[gap:])
            if len(a) + len(b) < WINDOW and (parts is None or a in parts or b in parts)
        ]


_LAYOUT: dict[int, tuple] = {}


def _layout(n: int) -> tuple:
    """Positions and weight of each subsequence of n characters within the span."""
    if n not in _LAYOUT:
        p = [(i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + SPAN)), ORDER - 1)]
        p = np.array(p, np.int64).reshape(-1, ORDER)
        _LAYOUT[n] = (p.T.copy(), (DECAY ** (p[:, -1] - p[:, 0])).astype(np.float32))
    return _LAYOUT[n]


def subsequences(words: list[str], letters: Letters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of equal length together: their places in the list, the hashed
    codes of their subsequences, and the weights, of unit length for each word."""
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    code = letters.__getitem__
    for n, places in by.items():
        for k in range(0, len(places), 1024):
            part = places[k : k + 1024]
            chars = np.array([[START, *map(code, words[i]), END] for i in part], np.uint32)
            positions, decay = _layout(n + 2)
            codes = np.zeros((len(part), len(decay)), np.uint32)
            for p in positions:
                codes = (codes << np.uint32(6)) | chars[:, p]
            codes = (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE)
            weight = np.broadcast_to(decay, codes.shape)
            if (chars == OTHER).any():
                weight = weight * (chars != OTHER)[:, positions].all(axis=1)
            norm = np.sqrt((weight**2).sum(axis=1, keepdims=True))
            yield np.array(part), codes, weight / np.maximum(norm, np.float32(1e-9))


def variants(word: str) -> list[str]:
    """Spellings of a witness with gaps and with an inserted character, as further positives."""
    half = len(word) // 2
    return ["-".join(word), ".".join(word), *(word[:k] + x + word[k:] for k, x in ((half, "1"), (half, "x"), (half + 1, "*"), (half - 1, "q")))]


class Machine:
    """One weight for each hashed subsequence, a bias, the words of witness
    pairs, and the coefficients of the probability on a text's highest margins."""

    def __init__(self):
        self.parts: frozenset[str] = frozenset()
        self.weights = np.zeros(1 << TABLE, np.float32)
        self.bias = -1.0
        self.curve = np.array([*[0.0] * TOP, -8.0])

    def margins(self, words: list[str], letters: Letters) -> np.ndarray:
        out = np.full(len(words), self.bias, np.float32)
        for at, codes, weight in subsequences(words, letters):
            out[at] += np.einsum("ij,ij->i", self.weights[codes], weight)
        return out

    def probability(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(steps(tops) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def steps(tops: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-SLOPE * (np.asarray(tops) - STEP)))


class Scorer:
    """Highest window margins of texts, with a bounded memory of words."""

    def __init__(self, machine: Machine):
        self.machine, self.letters, self.known = machine, Letters(), {}

    def tops(self, texts: list[str | None]) -> np.ndarray:
        """The TOP highest margins of each text's distinct windows, clipped; the lowest where there are fewer."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        sets = [self.windows(t.lower()) if t else set() for t in texts]
        new = list(set().union(*sets) - self.known.keys())
        for k in range(0, len(new), 65536):
            part = new[k : k + 65536]
            self.known.update(zip(part, self.machine.margins(part, self.letters).tolist()))
        get = self.known.__getitem__
        out = np.full((len(texts), TOP), LOW)
        for row, s in zip(out, sets):
            best = nlargest(TOP, map(get, s))
            row[: len(best)] = best
        return np.clip(out, LOW, HIGH)

    def windows(self, text: str) -> set[str]:
        found = windows_of(text)
        if self.machine.parts:
            found.update(*pairs_of(text, self.machine.parts, True))
        return found


def _sentence_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, bad, good): a document's words by the sentences that hold
    them, each word once a document, from toxic documents and from others."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words: set[str] = set()
            for sentence in SENTENCE.split((text or "").lower()):
                words |= {w.strip(".,;:!?") for w in windows_of(sentence)}
            counts[label].update(words)
        good, bad = counts
        words = [w for w in good.keys() | bad.keys() if w]
        if words:
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array([bad[w] for w in words], pa.int64()), pa.array([good[w] for w in words], pa.int64())],
                ["word", "bad", "good"],
            )


def _sentence_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, sentence, pair): each sentence's distinct pairs, and an empty one for the sentence itself."""
    for batch in batches:
        rows = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for pairs in pairs_of((text or "").lower()):
                if pairs:
                    sentence = hash_of("|".join(pairs))
                    rows += [(label, sentence, p) for p in {"", *pairs}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string()))], ["label", "sentence", "pair"])


def hash_of(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode())).view(np.int64))


def _witness_pairs(labelled: DataFrame, machine: "Machine", n_bad: float, n_good: float) -> dict[str, tuple[float, float]]:
    """Pairs of harmless words that toxic sentences have far more often, and the
    clean pairs most like them, with their counts in units of documents."""
    rows = map_arrow(labelled.select("label", "text"), _sentence_pairs, "label int, sentence long, pair string").distinct()
    counts = rows.groupBy("pair").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).persist()
    try:
        whole = counts.filter("pair = ''").first()
        if whole is None or not whole["bad"] or not whole["good"]:
            return {}
        unit = (n_bad / whole["bad"], n_good / whole["good"])
        rare = (F.col("bad") >= PAIR_SENTENCES) & (F.col("bad") * float(unit[0] / n_bad) > 6 * (F.col("good") + 0.5) * float(unit[1] / n_good))
        found = counts.filter((F.col("pair") != "") & rare).orderBy(F.desc("bad"), "pair").limit(PAIRS).collect()
        words = sorted({w for r in found for w in r["pair"].split(" ")})
        plain = {w for w, m in zip(words, machine.margins(words, Letters())) if m < 0}
        found = [r for r in found if plain.issuperset(r["pair"].split(" "))]
        bad, good = np.array([(r["bad"], r["good"]) for r in found], float).reshape(-1, 2).T
        keep = _surprise(bad, good, whole["bad"], whole["good"]) > 20
        held = {r["pair"]: (r["bad"], r["good"]) for r, k in zip(found, keep) if k}
        if not held:
            return {}
        parts = sorted({w for p in held for w in p.split(" ")})[:PAIRS]
        has = F.arrays_overlap(F.split("pair", " "), F.array(*map(F.lit, parts)))
        others = counts.filter(has & (F.col("good") > 0)).orderBy(F.desc("good"), "pair").limit(PAIRS).collect()
        held = {r["pair"]: (r["bad"], r["good"]) for r in others} | held
        return {p: (b * unit[0], g * unit[1]) for p, (b, g) in held.items()}
    finally:
        counts.unpersist()


def _surprise(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Likelihood-ratio statistic of a word's toxic share against the classes' sizes; 0 if not above."""
    total = bad + good
    expect = total * n_bad / max(1.0, n_bad + n_good)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(bad > 0, bad * np.log(bad / expect), 0) + np.where(good > 0, good * np.log(good / (total - expect)), 0))
    return np.where(bad > expect, g, 0.0)


def _train(f: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin; the last weight is the bias."""
    x = np.hstack([f, np.ones((len(f), 1), f.dtype)])
    v = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v / 2 + (c * np.maximum(1 - y * (x @ v), 0) ** 2).sum())

    now = loss(v)
    for _ in range(rounds):
        gap = 1 - y * (x @ v)
        inside = gap > 0
        xa = x[inside]
        grad = ridge @ v - 2 * xa.T @ (c * y * gap)[inside]
        step = np.linalg.solve(ridge + 2 * (xa * c[inside][:, None]).T @ xa, grad)
        size = 1.0  # halved until the loss falls: full steps can cycle on separable words
        while (new := loss(v - size * step)) > now - 1e-4 * size * (grad @ step) and size > 1e-4:
            size /= 2
        if now - new < 1e-6 * now:
            break
        v, now = v - size * step, new
    return v


def _logistic(tops: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic coefficients of the documents' highest margins, the offset last."""
    x = np.hstack([tops, np.ones((len(tops), 1))])
    ridge = 0.5

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + ridge / 2 * a @ a)

    a = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (weight * (p - label)) + ridge * a
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(a)), grad)
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a) - 1e-4 * size * (grad @ step):
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return a


def fit(labelled: DataFrame, sizes: dict[int, int], landmarks: int = LANDMARKS, kept: int = KEPT) -> Machine:
    """Fits on a bounded sample (doc_id, text, label). Words are counted on the
    executors; the driver sees the most frequent ones and one margin for each
    sampled document. Without both classes every text is scored as clean."""
    machine = Machine()
    counted = dict(labelled.groupBy("label").count().collect())
    n_good, n_bad = float(counted.get(0, 0)), float(counted.get(1, 0))
    if not n_good or not n_bad:
        return machine
    counts = map_arrow(labelled.select("label", "text"), _sentence_counts, "word string, bad long, good long")
    counts = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    try:
        rows = {
            r[0]: (r[1], r[2])
            for first in ("bad", "good")
            for r in counts.orderBy(F.desc(first), F.desc("bad"), "word").limit(kept).collect()
        }
        machine = _fit_words(machine, rows, n_bad, n_good, landmarks)
        for _ in range(3):
            rows |= _hard_words(counts, machine, kept // 2)
            machine = _fit_words(machine, rows, n_bad, n_good, landmarks)
        if pairs := _witness_pairs(labelled, machine, n_bad, n_good):
            for _ in range(2):
                machine = _fit_words(machine, rows | pairs, n_bad, n_good, landmarks)
            toxic = [p for p, m in zip(sorted(pairs), machine.margins(sorted(pairs), Letters())) if m > 0 and pairs[p][0] > pairs[p][1]]
            machine.parts = frozenset(w for p in toxic for w in p.split(" "))
    finally:
        counts.unpersist()
    found = _document_tops(labelled, machine)
    label = np.array([r[0] for r in found], float)
    share = np.array([sizes.get(k, 0) / max(1, (label == k).sum()) for k in (0, 1)])
    weight = share[label.astype(int)]
    machine.curve = _logistic(steps(np.array([r[1] for r in found])), label, weight / weight.mean())
    return machine


def _document_tops(labelled: DataFrame, machine: Machine) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for batch in batches:
            tops = scorer.tops(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(tops), pa.list_(pa.float64()))], ["label", "tops"])

    rows = map_arrow(labelled.select("label", "text"), run, "label int, tops array<double>").collect()
    return sorted(rows, key=lambda r: (r[0], r[1]))


def _hard_words(counts: DataFrame, machine: Machine, most: int) -> dict[str, tuple[int, int]]:
    """The words of the sample that the machine finds most toxic, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            margin = machine.margins(batch.column(0).to_pylist(), letters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(margin.astype(float))], ["word", "bad", "good", "margin"])

    scored = map_arrow(counts.select("word", "bad", "good"), run, "word string, bad long, good long, margin double")
    rows = scored.filter("margin > -0.5").orderBy(F.desc("margin"), "word").limit(most).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def _fit_words(machine: Machine, rows: dict[str, tuple[int, int]], n_bad: float, n_good: float, landmarks: int) -> Machine:
    words = sorted(rows)
    bad, good = np.array([rows[w] for w in words], float).T
    letters = Letters()
    # a small share of wrong labels puts insults into documents marked clean
    ratio = (bad + 0.5) / n_bad / ((good + 0.5) / n_good)
    witness = (_surprise(bad, good, n_bad, n_good) > 20) & (ratio > 6)
    if not witness.any():
        return machine
    if machine.weights.any():
        # words like a witness that no clean document has are witnesses too
        witness |= (machine.margins(words, letters) > 0.3) & (bad > 0) & (ratio > 2) & (good == 0)
    own = [k for k in np.flatnonzero(witness) if len(words[k]) > 3]
    own = sorted(own, key=lambda k: (-bad[k], words[k]))[:VARIED]
    for k in own:
        spelt = variants(words[k])
        words += spelt
        bad, good = np.r_[bad, np.full(len(spelt), bad[k] / 10)], np.r_[good, np.zeros(len(spelt))]
    witness = np.r_[witness, np.ones(len(words) - len(witness), bool)]
    negative = ~witness & (good > 0)
    pos, neg = np.flatnonzero(witness), np.flatnonzero(negative)
    if not len(neg):
        return machine
    # a witness weighs as many documents as it is found in; no number of rare ones outweighs a common one
    weight = np.where(witness, bad, np.minimum(good, 20.0)) + 1.0
    strong = pos[np.argsort(-bad[pos], kind="stable")][: landmarks // 2]
    close = machine.margins([words[i] for i in neg], letters) if machine.weights.any() else good[neg] * 1.0
    marks = np.r_[strong, neg[np.argsort(-close, kind="stable")][: landmarks - len(strong)]]
    found = list(subsequences([words[i] for i in marks], letters))
    used = np.unique(np.concatenate([codes.ravel() for _, codes, _ in found]))  # all others have kernel zero with every landmark
    place = np.full(1 << TABLE, len(used), np.int64)
    place[used] = np.arange(len(used))
    dense = np.zeros((len(used) + 1, len(marks)), np.float32)
    for at, codes, w in found:
        for a, c, x in zip(at, place[codes], w):
            np.add.at(dense[:, a], c, x)

    def kernel_with(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(marks)), np.float32)
        for at, codes, w in subsequences([words[i] for i in rows], letters):
            for a, c, x in zip(at, place[codes], w):
                hit = c < len(used)
                out[a] = x[hit] @ dense[c[hit]]
        return out

    kernel, among = kernel_with(np.r_[pos, neg]), kernel_with(marks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good_ = values > 1e-4
    whiten = (vectors[:, good_] / np.sqrt(values[good_])).astype(np.float32)
    y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
    if machine.weights.any():
        weight[neg] *= np.where(close > -0.5, HARD, 1.0)
    c = np.r_[weight[pos] / weight[pos].sum() * 4000, weight[neg] / weight[neg].sum() * 40000]
    v = _train(kernel @ whiten, y, c)
    out = Machine()
    out.weights[used] = dense[:-1] @ (whiten @ v[:-1])
    out.bias = float(v[-1])
    return out


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of docs (doc_id, text).

    A null or empty text has the lowest margins and is scored by them. Repeated
    rows and null doc_ids stay; no other column is read; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = shared.value.probability(scorer.tops(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their
    columns, in one pass and without a shuffle. Nulls and empty texts are
    scored as in score_toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = shared.value.probability(scorer.tops(batch.column(at).to_pylist()))
            yield batch.filter(pa.array(scores < threshold))

    return map_arrow(docs, run, docs.schema)


def toxicity_machine(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine of the fixed training fold."""
    return fit(*labelled_sample(docs, labels, "toxic", 5, 0, sample))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, toxicity_machine(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
