"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are made in one pass over the texts. Distinct fingerprints are
dealt to buckets by masked bits: with 4 + k blocks of bits, two fingerprints
that differ in at most 4 bits agree in some k blocks, so every link shares a
bucket. k grows with the number of fingerprints and keeps buckets small.
Inside a bucket the fingerprints are sorted by Gray rank, which puts similar
codes side by side, and a tree is built over them: each node keeps the bits
that all its codes share. Pairs of nodes whose shared bits already differ in
more than 4 places are pruned with everything below them; pairs that are
known to be connected are skipped. A bucket gives a star for each of its
components, never all pairs; the stars are joined by alternating large-star
and small-star steps.

A fingerprint may have several words of 64 bits. Beyond the few bits that masked
blocks can cover, buckets take sampled bits instead: as many masks as miss a
link with at most a given chance (near_copies.py, which then checks each link).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialise, settle

BITS = 64
DISTANCE = 4
WORDS = 4
SEED = 42
#: Codes of a leaf of the tree, children of a node.
LEAF, FAN = 16, 4
#: Mean codes of a bucket up to which no further block is added.
BUCKET = 64
#: Codes from which on a bucket is dealt out as pairs of pieces.
PIECE = 4096
#: Pairs of leaves compared at once.
SLICE = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    tokens = (text or "").encode().lower().split()  # splits at [\x20\x09-\x0D]
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 4096):
        part = hashes[k : k + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and code (the fingerprint as a signed long) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, code long")


def block_masks(blocks: int, keep: int) -> list[int]:
    """Masks that keep `keep` of `blocks` nearly equal blocks of the 64 bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(group) for group in combinations(single, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sampled_masks(words: int, keep: int, count: int, seed: int = SEED) -> list[tuple[int, ...]]:
    """Masks that keep `keep` bits each of `words` words; the bits are dealt out of shuffled decks, so that masks share few."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < count:
        deck = rng.permutation(words * BITS)
        for k in range(0, len(deck) - keep + 1, keep):
            mask = [0] * words
            for bit in deck[k : k + keep].tolist():
                mask[bit // BITS] |= 1 << bit % BITS
            out.append(tuple(mask))
    return out[:count]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence; codes are one word each, or rows of words."""
    if codes.ndim == 1:
        return gray_rank(codes[:, None])[:, 0]
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    # the last bit of a word's rank is its parity, which turns the words after it round
    odd = np.cumsum(rank & np.uint64(1), axis=1, dtype=np.uint64) - (rank & np.uint64(1))
    return rank ^ (np.uint64(0) - (odd & np.uint64(1)))


def _apart(bits: np.ndarray) -> np.ndarray:
    """Set bits of each code; the last axis holds a code's words."""
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int32)


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[k] and b[k]; roots are the smallest members."""
    while True:
        a, b = _find(parent, a), _find(parent, b)
        open_ = a != b
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class GrayIndex:
    """Trees over the codes of many buckets at once, each bucket's codes in Gray order.

    bucket must be sorted, and codes (n, words) sorted by Gray rank within a bucket.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.codes = codes
        n = len(codes)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, n])
        self.levels = []  # of (ones in all, ones in any, first child, end of children), leaves first
        starts, ands, ors, width = first, codes, codes, LEAF
        while n:
            nodes = -(-counts // width)
            base = np.cumsum(nodes) - nodes
            child = np.repeat(starts, nodes) + (np.arange(nodes.sum()) - np.repeat(base, nodes)) * width
            end = np.minimum(child + width, np.repeat(starts + counts, nodes))
            ands, ors = np.bitwise_and.reduceat(ands, child, axis=0), np.bitwise_or.reduceat(ors, child, axis=0)
            self.levels.append((ands, ors, child, end))
            starts, counts, width = base, nodes, FAN
            if (nodes == 1).all():
                break

    def components(self, distance: int = DISTANCE) -> np.ndarray:
        """For each code the smallest index it is linked with inside its bucket, over any number of links."""
        parent = np.arange(len(self.codes))
        if not len(self.codes):
            return parent
        top = len(self.levels[-1][0])
        stack = [(len(self.levels) - 1, np.arange(top), np.arange(top))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > SLICE:
                stack += [(level, a[k : k + SLICE], b[k : k + SLICE]) for k in range(0, len(a), SLICE)]
                continue
            ands, ors, child, end = self.levels[level]
            keep = _apart((ands[a] & ~ors[b]) | (ands[b] & ~ors[a])) <= distance
            a, b = a[keep], b[keep]
            if not level:
                self._leaves(parent, child, end, a, b, distance)
                continue
            na, nb = end[a] - child[a], end[b] - child[b]
            i = np.arange(FAN * FAN) // FAN
            j = np.arange(FAN * FAN) % FAN
            x, y = child[a][:, None] + i, child[b][:, None] + j
            good = (i < na[:, None]) & (j < nb[:, None]) & (x <= y)
            stack.append((level - 1, x[good], y[good]))
        return _find(parent, np.arange(len(parent)))

    def _leaves(self, parent, child, end, a, b, distance) -> None:
        """Compares the codes of each pair of leaves; pairs already connected are left out."""
        if not len(a):
            return
        root = _find(parent, np.arange(len(parent))) if len(parent) < 4 * len(a) * LEAF else None
        if root is not None:
            low, high = np.minimum.reduceat(root, child), np.maximum.reduceat(root, child)
            done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~done], b[~done]
        at = np.arange(LEAF)
        for k in range(0, len(a), 1024):
            x, y = child[a[k : k + 1024]][:, None] + at, child[b[k : k + 1024]][:, None] + at
            inx, iny = x < end[a[k : k + 1024]][:, None], y < end[b[k : k + 1024]][:, None]
            x, y = np.where(inx, x, 0), np.where(iny, y, 0)
            near = _apart(self.codes[x][:, :, None] ^ self.codes[y][:, None, :]) <= distance
            near &= inx[:, :, None] & iny[:, None, :]
            p, i, j = np.nonzero(near)
            left, right = x[p, i], y[p, j]
            keep = left < right
            if keep.any():
                _union(parent, left[keep], right[keep])


def _stars(columns: int, distance: int):
    """mapInArrow over rows (key..., node, code...) in key order: an edge from each
    code's node to the node of its component's first code."""

    def flush(columns_: list[np.ndarray]) -> pa.RecordBatch:
        keys, nodes = columns_[:columns], columns_[columns]
        codes = np.stack([c.view(np.uint64) for c in columns_[columns + 1 :]], axis=1)
        order = np.lexsort([*gray_rank(codes).T[::-1], *keys[::-1]])
        keys, nodes, codes = [k[order] for k in keys], nodes[order], codes[order]
        change = np.zeros(len(codes), bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        root = GrayIndex(np.cumsum(change), codes).components(distance)
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
            n = len(held[0])
            if n < 50_000:
                continue
            same = np.ones(n, bool)
            for k in held[:columns]:
                same &= k == k[-1]
            last = n - int(same.sum())  # the last bucket may go on in the next batch
            if last:
                yield flush([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None and len(held[0]):
            yield flush(held)

    return run


def exact_masks(count: int, distance: int, bucket: int = BUCKET) -> list[tuple[int, ...]]:
    """Masks of blocks such that two codes of one word within distance agree in one; more are masked as the count grows."""
    keep = 1
    while keep < 5 and count > bucket << (BITS * keep // (distance + keep)):
        keep += 1
    return [(m,) for m in block_masks(distance + keep, keep)]


def links(
    distinct: DataFrame, count: int, distance: int = DISTANCE, bucket: int = BUCKET, piece: int = PIECE, masks: list[tuple[int, ...]] | None = None
) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly the codes within distance,
    of those that agree in the bits of a mask where `masks` are given.

    distinct has node and a column for each word of the code, each code once;
    count is its number of rows.
    """
    masks = masks or exact_masks(count, distance, bucket)
    words = [c for c in distinct.columns if c != "node"]
    masked = lambda m: [F.col(c).bitwiseAND(F.lit(_signed(x))) for c, x in zip(words, m)]
    value = lambda m: masked(m)[0] if len(words) == 1 else F.xxhash64(*masked(m))
    keyed = distinct.select(F.posexplode(F.array(*map(value, masks))).alias("part", "value"), "node", *words)
    hot = keyed.groupBy("part", "value").count().filter(F.col("count") > piece)
    hot = materialise(hot.select("part", "value", F.ceil(F.col("count") / piece).cast("int").alias("pieces")), "hot-buckets")
    keyed = keyed.join(hot, ["part", "value"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64(*words), F.col("pieces")).cast("int")
    # a piece meets every other one and itself in a pair of its own
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = keyed.select(
        "part", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", *words
    )
    keys = ["part", "value", "low", "high"]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, *keys).sortWithinPartitions(*keys)
    return map_arrow(sorted_, _stars(len(keys), distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge.

    Alternating large-star and small-star steps; each round is written to the
    shared folder, where its own steps are deleted again, and ends the loop when
    it changes nothing.
    """
    spark = edges.sparkSession
    oriented = lambda e, a, b: e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()

    def step(now: DataFrame) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(oriented(large, "a", "b"), "large-star")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return oriented(small.unionByName(least.select("a", F.col("m").alias("b"))), "a", "b")

    now = materialise(oriented(edges, "a", "b"), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = settle(spark, lambda now=now: step(now), "small-star")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, bucket: int = BUCKET, piece: int = PIECE) -> DataFrame:
    """doc_id, code and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most
    `distance` differing bits. Null and empty texts have fingerprint zero and
    link like any other. Rows that repeat a doc_id are documents of their own
    with the same name. Rows without a doc_id link nothing and get a null
    component. Other columns are not read; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(
        marked.filter("doc_id IS NOT NULL").groupBy("code").agg(F.min("doc_id").alias("node")), "codes"
    ).select("node", "code")
    count = distinct.count()
    if not count:
        return marked.withColumn("component_id", F.lit(None).cast("long"))
    found = components(links(distinct, count, distance, bucket, piece))
    label = distinct.join(found, "node", "left").select(F.col("code").alias("_code"), F.coalesce("root", "node").alias("_root"))
    label = materialise(label, "labels")
    out = marked.join(label, F.col("code") == F.col("_code"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("_root"))
    return out.select("doc_id", "code", component.alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
