"""Benchmark decontamination by template windows.

Texts are canonicalised word by word: numbers, units after a number and
capitalised names inside a sentence become typed placeholders, other words
keep their lower-cased letters. Windows of consecutive template words are
hashed; documents' windows pass a bit map of the benchmark's windows (of a
fixed size, whatever the benchmark's) and are then hash-joined with them.
A hit counts for a document and an item where enough windows lie on one
diagonal, that is in the item's order and spacing, and the placeholders'
fillings are consistent there: the same filling of the item always meets the
same filling of the document. A question with other numbers or names is thus
caught as well as a plain copy. Windows that hold placeholders are also hashed
by their plain words, so that a verbatim copy is found whatever its words are:
where the windows without any change alone are enough, nothing else counts.
An item meets a document only through its anchors, the positions whose windows
the fewest items share, so many that no diagonal with enough windows is without
one: a stem of many questions, too short to count by itself, costs nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialise, table

WINDOW = 8
#: Literal words that a window must have besides its placeholders.
LITERALS = 4
#: Windows on a diagonal from which on an item counts as contained: 13 words in a row.
HITS = 6
#: Bits of the benchmark's map, as a power of two.
MAP_BITS = 22
REMEMBERED = 500_000

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/%-]*(?:st|nd|rd|th|e[+-]?\d+)?%?")
ATTACHED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d_]{1,3}|%)")
NAME = re.compile(r"[^\W\d_][\w'-]*")
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…*|&%$#"
# Units that count as a placeholder after a number.
UNITS = frozenset(
    "% mm cm m km in inch inches ft foot feet yd yards mi mile miles g kg mg lb lbs oz t ton tons l ml liter liters litre litres s sec second"
    " seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents"
    " percent degree degrees c f k w kw v a hz mb gb tb kb mph kmh".split()
)
NUM, UNIT, NAMED = 1, 2, 3
B = np.uint64(0x9E3779B97F4A7C15)
LEFT = np.uint64(0xD6E8FEB86659FD93)


def _mark(value: int) -> int:
    return (value * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (1 << 64) - 1


PLACE = [np.uint64(_mark(k)) for k in range(4)]


class Words(dict):
    """Number of a word in growing tables: hash of its letters, kinds it may be, whether it ends a sentence."""

    def __init__(self):
        super().__init__()
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.hashes, self.kinds, self.ends, self.filled = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8), np.zeros(1024, bool), 0

    def __missing__(self, word: str) -> int:
        i = self.filled
        if i == len(self.hashes):
            self.hashes, self.kinds, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.kinds, self.ends))
        core = word.strip(EDGE)
        low = core.lower()
        self.hashes[i] = xxhash.xxh64_intdigest(low.encode())
        kind = 0
        if core and NUMBER.fullmatch(core):
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif core[:1].isupper() and NAME.fullmatch(core) and not (len(core) > 1 and core.isupper()):
            kind = NAMED
        self.kinds[i] = kind
        self.ends[i] = word.rstrip("\"')]»”’*|&%$#")[-1:] in tuple(".!?:…") or not core
        self.filled += 1
        self[word] = i
        return i


def _split(text: str) -> list[str]:
    return ATTACHED.sub(r"\1 \2", text).split() if any(map(str.isdigit, text)) else text.split()


def template(text: str, words: Words) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Hash and placeholder kind of each word of the canonical text, the words, and their hashes without placeholders."""
    if words.filled > REMEMBERED:
        words.clear_all()
    tokens = _split(text)
    at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    kinds, ends = words.kinds[at].copy(), words.ends[at]
    start = np.ones(len(at), bool)
    start[1:] = ends[:-1]
    after_number = np.zeros(len(at), bool)
    after_number[1:] = kinds[:-1] == NUM
    kinds[(kinds == NAMED) & start] = 0
    kinds[(kinds == UNIT) & ~after_number] = 0
    plain = words.hashes[at]
    hashes = plain.copy()
    for k in (NUM, UNIT, NAMED):
        hashes[kinds == k] = PLACE[k]
    return hashes, kinds, tokens, plain


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = (left * LEFT + right) * B
    out ^= out >> np.uint64(29)
    return out


def windows(hashes: np.ndarray, kinds: np.ndarray, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of `size` template words with enough literals."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out, done, block, width = None, 0, hashes, 1
    while True:  # blocks of 1, 2, 4, ... words make up a window
        if size & width:
            out = block[:n] if out is None else _joined(out, block[done : done + n])
            done += width
        if done == size:
            break
        block, width = _joined(block[:-width], block[width:]), 2 * width
    out = _joined(np.full(n, np.uint64(size)), out)
    plain = np.cumsum(np.r_[0, kinds == 0])
    good = np.flatnonzero(plain[size:] - plain[:-size] >= literals)
    return good, out[good]


def plain_windows(plain: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window with a placeholder, by its plain words; the others are in windows() already."""
    if not kinds.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, found = windows(plain, np.zeros_like(kinds), size, 0)
    slots = np.cumsum(np.r_[0, kinds != 0])
    keep = slots[at + size] > slots[at]
    return at[keep], found[keep]


def _slots(tokens: list[str], kinds: np.ndarray, start: int, size: int) -> list[str]:
    return [tokens[start + k].strip(EDGE).lower() for k in range(size) if kinds[start + k]]


#: Positions of a document that are joined with a candidate diagonal at once.
BLOCK = 64

BENCH = "item_id long, version long, pos int, size int, total int, whole int, plain boolean, hash long, slots array<string>"
DOCS = "doc_id long, row long, pos int, hash long, slots array<string>"


def benchmark_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Windows of each item; an item shorter than a window is one window of its own length. total counts
    those with enough literals, whole all. A first word that a document could take for a name is hashed both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, kinds, tokens, plain = template(text or "", words)
                size = min(window, len(tokens))
                if not size:
                    continue
                at, found = windows(hashes, kinds, size, min(literals, size))
                total, whole = len(at), len(tokens) - size + 1
                version = xxhash.xxh64_intdigest(text.encode()) >> 1  # texts that share an item_id stay apart
                add = lambda p, h, plain, slots: rows.append((item, version, int(p), size, total, whole, plain, int(np.uint64(h).view(np.int64)), slots))  # noqa: B023, E731
                for p, h in zip(at, found):
                    add(p, h, False, _slots(tokens, kinds, p, size))
                if total and at[0] == 0 and not kinds[0] and words.kinds[words[tokens[0]]] == NAMED:
                    named = kinds[:size].copy()
                    named[0] = NAMED
                    first = windows(np.r_[PLACE[NAMED], hashes[1:size]], named, size, 0)[1]
                    add(0, first[0], False, _slots(tokens, named, 0, size))
                for p, h in zip(*plain_windows(plain, kinds, size)):
                    add(p, h, True, [])
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.string()))
                names = ["item_id", "version", "pos", "size", "total", "whole", "plain", "hash", "slots"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return map_arrow(items.select("item_id", "text"), run, BENCH)


def _bit_map(bench: DataFrame, bits: int) -> np.ndarray:
    """The benchmark's hashes as a map of 2**bits bits; at most 2**bits / 64 rows reach the driver."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    rows = bench.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS int))")).alias("bits")
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    for word, value in rows.collect():
        out[word] = np.uint64(value & (1 << 64) - 1)
    return out


def needed(hits: int) -> Column:
    """Positions that any diagonal must match at least to count for an item."""
    return F.least(F.lit(hits), F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("whole")))


def anchors(item: DataFrame, hits: int) -> DataFrame:
    """Windows (item_id, version, whole, item_pos, hash) at each item's anchors.

    A diagonal that counts matches `needed` positions, so it misses at most the
    needed - 1 whose windows are shared by the most items."""
    shared = item.groupBy("hash").agg(F.count_distinct("item_id", "version").alias("items"))
    place = item.join(shared, "hash").groupBy("item_id", "version", "total", "whole", "item_pos").agg(
        F.max("items").alias("items"), F.collect_set("hash").alias("hash")
    )
    rank = F.row_number().over(Window.partitionBy("item_id", "version").orderBy("items", "item_pos"))
    place = place.withColumn("rank", rank).filter(F.col("rank") <= F.col("whole") - needed(hits) + 1)
    return place.select("item_id", "version", "whole", "item_pos", F.explode("hash").alias("hash"))


def _pairs(near: DataFrame, item: DataFrame, hits: int) -> DataFrame:
    """All matching windows on the diagonals on which an anchor of the item matches."""
    met = near.join(anchors(item, hits), "hash").select(
        "doc_id", "row", "item_id", "version", "whole", (F.col("pos") - F.col("item_pos")).alias("diagonal")
    ).distinct()
    block = lambda at: F.floor(at / BLOCK)
    span = F.sequence(block(F.col("diagonal")), block(F.col("diagonal") + F.col("whole") - 1))
    met = met.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "item_id", "version", "diagonal", F.explode(span).alias("_block"))
    held = near.withColumn("block", block(F.col("pos")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")) & (F.col("block") == F.col("_block"))
    lined = held.join(met, same).withColumn("item_pos", F.col("pos") - F.col("diagonal"))
    return lined.join(item, ["item_id", "version", "item_pos", "hash"])


def find_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, literals: int = LITERALS, hits: int = HITS, bits: int = MAP_BITS
) -> DataFrame:
    """One row (doc_id, item_id, n_windows, n_item_windows, reworded) for each
    document that holds an item; documents without any have no row.

    docs has doc_id and text, items item_id and text; other columns are not
    read. n_windows is the longest diagonal's number of matched windows, and
    `reworded` tells that numbers, units or names were replaced. Null and
    empty texts match nothing; rows without item_id are left out; repeated
    rows of a document count once; repeated items are found each, and texts that share
    an item_id are items of their own, of which the row tells the best. Rows without
    a doc_id are reported with a null doc_id. Empty tables give an empty result.
    """
    bench = materialise(benchmark_windows(items.filter("item_id IS NOT NULL"), window, literals), "benchmark-windows")
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(_bit_map(bench, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, mask = Words(), shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                hashes, kinds, tokens, plain = template(text, words)
                row = None
                for size in sizes:
                    # one literal less: the benchmark has first words as names, too
                    for typed, (at, found) in (
                        (True, windows(hashes, kinds, size, min(literals, size) - 1)), (False, plain_windows(plain, kinds, size))
                    ):
                        slot = found & mask
                        keep = np.flatnonzero(known[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                        if len(keep):
                            row = zlib.crc32(text.encode()) if row is None else row
                            rows += [
                                (doc, row, p, h, _slots(tokens, kinds, p, size) if typed else [])
                                for p, h in zip(at[keep].tolist(), found[keep].view(np.int64).tolist())
                            ]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "row", "pos", "hash", "slots"])

    # written: the pass over the texts runs once, and the join below sees the true size
    near = materialise(map_arrow(docs.select("doc_id", "text"), run, DOCS), "document-windows")
    item = bench.withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}).drop("size").distinct()
    pairs = _pairs(near, item, hits)
    met = F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(x["item_slots"].alias("a"), x["slots"].alias("b")))
    diagonal = pairs.groupBy("doc_id", "row", "item_id", "version", "diagonal").agg(
        F.collect_set(F.struct("item_pos", "plain", (F.col("item_slots") == F.col("slots")).alias("same"))).alias("at"),
        F.first("total").alias("total"), F.first("whole").alias("whole"), F.array_distinct(F.flatten(F.collect_set(met))).alias("met"),
    )
    places = lambda keep: F.size(F.array_distinct(F.transform(F.filter("at", keep), lambda x: x["item_pos"])))
    typed, same, every = places(lambda x: ~x["plain"]), places(lambda x: x["same"]), places(lambda x: F.lit(True))
    consistent = F.size("met") == F.size(F.array_distinct(F.transform("met", lambda x: x["a"])))
    reworded = consistent & (typed >= F.greatest(F.lit(1), F.least(F.lit(hits), F.col("total"))))
    verbatim = same >= F.least(F.lit(hits), F.col("whole"))
    diagonal = diagonal.withColumn("n", F.when(consistent, every).otherwise(same).cast("long"))
    found = diagonal.filter(reworded | verbatim).withColumn("other", F.exists("met", lambda x: x["a"] != x["b"]))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n").alias("n_windows"), F.max("whole").cast("long").alias("n_item_windows"), F.bool_and("other").alias("reworded")
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
