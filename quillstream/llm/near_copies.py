"""Near copies by the Jaccard similarity of word shingles, found over SimHash.

Texts with equal shingle sets are one node, with a SimHash of 256 bits over the
set. The Gray-order index (simhash.py) deals the nodes to buckets by sampled
bits and finds those whose fingerprints differ in few enough bits; what it
connects, over any number of links, is one candidate group. The index only says
which nodes could be alike: inside a group every link is decided by the shingle
sets themselves. A group is searched breadth first, so that nodes already
connected are not compared again, and a large group is dealt out as pairs of
pieces. Masks are as many as let a pair pass that agrees in 81 of 100 bits (sets
of a handful of shingles with a similarity of 0.8) with a chance of one in a
thousand; such a pair of longer texts agrees in 85 and is missed far less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise
from .simhash import BITS, SEED, components, links, sampled_masks

WORDS = 5
SIMILARITY = 0.8
#: Words of 64 bits of the fingerprint, and differing bits up to which a pair is a candidate: 30 in 100.
CODES = 4
APART = 76
#: Share of bits that alike pairs agree in at least, chance that all masks miss such a pair, mean nodes of a bucket.
AGREE, MISSED, BUCKET = 0.81, 1e-3, 512
#: Nodes and characters of a candidate group from which on it is dealt out as pairs of pieces.
PIECE, PIECE_CHARS = 1024, 16 << 20
#: Odd factors that make the hashes of further words of the fingerprint.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, CODES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    tokens = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not tokens:
        return np.zeros(0, np.uint64)
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(tokens[k : k + words]), SEED) for k in range(n)), np.uint64, n))


def wide_code(found: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(CODES * BITS, np.int64)
    for k in range(0, len(found), 1024):
        part = found[k : k + 1024, None] * FACTORS
        part ^= part >> np.uint64(32)
        part *= np.uint64(0x9E3779B97F4A7C15)
        part ^= part >> np.uint64(29)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found)).view(">u8").astype(np.uint64)


def masks_for(count: int, bucket: int = BUCKET) -> list[tuple[int, ...]]:
    """Masks for so many nodes: the more nodes, the more bits a mask keeps, and the more masks."""
    keep = max(4, int(np.ceil(np.log2(max(1, count) / bucket))))
    return sampled_masks(CODES, keep, int(np.ceil(np.log(MISSED) / np.log(1 - AGREE**keep))))


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the first one that it is connected with over links of at least `similarity`."""
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    own = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist())]
    empty = np.flatnonzero(sizes == 0)
    root[empty] = empty[:1]
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    rest = np.flatnonzero(sizes)
    held = flat
    while len(rest):
        first, rest, held = rest[0], rest[1:], held[sizes[rest[0]] :]
        queue = [first]
        while queue and len(rest):
            at = queue.pop()
            mark[own[at]] = True
            n = sizes[rest]
            common = np.add.reduceat(mark[held], np.cumsum(n) - n, dtype=np.int64)
            mark[own[at]] = False
            near = common >= similarity * (n + sizes[at] - common) - 1e-9
            if near.any():
                root[rest[near]] = first
                queue += rest[near].tolist()
                held = held[np.repeat(~near, n)]
                rest = rest[~near]
    return root


CODE = [f"code{k}" for k in range(CODES)]


def _marks(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, codes, sizes = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                digest = xxhash.xxh128_intdigest(found.tobytes(), SEED)
                low.append(digest & (1 << 64) - 1)
                high.append(digest >> 64)
                codes.append(wide_code(found))
                sizes.append(len(text or ""))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            codes = np.array(codes, np.uint64).reshape(-1, CODES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), signed(low), signed(high), pa.array(sizes, pa.int64()), *map(signed, codes.T)],
                ["row", "low", "high", "size", *CODE],
            )

    return run


def _verify(words: int, similarity: float):
    """mapInArrow over rows (root, a, b, node, text) in key order: an edge from
    each node to the first one that it is connected with."""

    def flush(nodes: list[int], texts: list[str | None]) -> pa.RecordBatch:
        node = np.array(nodes, np.int64)
        order = np.argsort(node, kind="stable")
        root = linked([shingles(texts[k], words) for k in order.tolist()], similarity)
        node = node[order]
        far = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts = None, [], []
        for batch in batches:
            for *new, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if new != key and nodes:
                    yield flush(nodes, texts)
                    nodes, texts = [], []
                key = new
                nodes.append(node)
                texts.append(text)
        if nodes:
            yield flush(nodes, texts)

    return run


def near_copies(rows: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, piece: int = PIECE) -> DataFrame:
    """row and root of every row of rows (row, text): root is the smallest row
    that can be reached over links of at least `similarity`.

    row must be unique; rows must give the same rows each time it is read.
    Null and blank texts are copies of one another.
    """
    shape = ", ".join(["row long, low long, high long, size long", *(f"{c} long" for c in CODE)])
    marked = materialise(map_arrow(rows.select("row", "text"), _marks(words), shape), "shingles")
    nodes = marked.groupBy("low", "high").agg(F.min("row").alias("node"), F.max("size").alias("size"), *(F.first(c).alias(c) for c in CODE))
    nodes = materialise(nodes, "shingle-sets")
    coded = materialise(nodes.groupBy(*CODE).agg(F.min("node").alias("node")), "codes")
    count = coded.count()
    found = links(coded.select("node", *CODE), count, APART, masks=masks_for(count))
    # different sets of one fingerprint, as tiny ones can have, are candidates, too
    same = nodes.join(coded.withColumnRenamed("node", "first"), CODE).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = components(found.unionByName(same))
    group = materialise(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    group = group.join(nodes.select("node", "size"), "node")
    count = group.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))
    hot = count.select("root", F.ceil(F.greatest(F.col("n") / piece, F.col("chars") / PIECE_CHARS)).cast("int").alias("pieces"))
    hot = materialise(hot.filter("pieces > 1"), "large-groups")
    group = group.join(hot, "root", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    group = group.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    # a piece meets every other one and itself in a pair of its own
    group = group.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    group = materialise(group.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node"), "pieces")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = group.join(rows.select(F.col("row").alias("node"), "text"), "node").select("root", "a", "b", "node", "text")
    dealt = dealt.repartition(n, "root", "a", "b").sortWithinPartitions("root", "a", "b")
    edges = materialise(map_arrow(dealt, _verify(words, similarity), "a long, b long"), "near-links")
    final = components(edges).withColumnRenamed("node", "_node")
    label = nodes.select("low", "high", "node").join(final, F.col("node") == F.col("_node"), "left")
    label = materialise(label.select("low", "high", F.coalesce("root", "node").alias("root")), "near-labels")
    return marked.select("row", "low", "high").join(label, ["low", "high"]).select("row", "root")
