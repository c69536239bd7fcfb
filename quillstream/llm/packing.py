"""Bounded-space online packing of documents into token windows.

Each partition streams through its documents with a fixed number of open
windows. A document's full windows leave at once; its rest goes to the open
window that it fits best. Where none fits, the fullest window is filled with
the head of the rest, emitted, and replaced by a new one that takes what
remains. The windows still open at the end of a partition are merged over
groups of partitions, level by level, until one group is left; what then
doesn't fill a window is cut at powers of two, which need no padding.
Token ids are those of the `tokenizers` vocabulary file; they are made with
`tiktoken` from the same ranks, which gives equal ids several times faster.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, map_arrow, materialise

WINDOW = 2048
OPEN_WINDOWS = 16
END_ID = 1
#: Partitions (or groups of them) whose leftovers one task merges: at most this many times OPEN_WINDOWS windows.
MERGE = 64
#: From this length on, texts with a run of this many letters or blanks go to the other library, which is linear in a run.
LONG_RUN = 20_000

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long, ids binary"
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Encoder:
    """Token ids of whole texts, equal to the `tokenizers` vocabulary's."""

    def __init__(self, vocabulary: str, ranks: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.other = Tokenizer.from_file(vocabulary)
        special = {t.content: i for i, t in self.other.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and self.run.search(text):
            return np.array(self.other.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


class Windows:
    """Open windows of one partition; emit() gets the pieces of a full one."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list] = []  # [free, [piece, ...]]
        self.full: list[list] = []

    def put(self, piece: tuple, n: int, cut) -> None:
        """piece has n tokens; cut(piece, k) gives its first k tokens and the rest."""
        while n >= self.size:
            head, piece = cut(piece, self.size)
            self.full.append([head])
            n -= self.size
        while n:
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                w, k = min(fits, key=lambda w: w[0]), n
            elif len(self.open) < self.most:
                self.open.append(w := [self.size, []])
                k = n
            else:
                w = min(self.open, key=lambda w: w[0])
                k = w[0]
            head, piece = cut(piece, k)
            w[1].append(head)
            w[0] -= k
            n -= k
            if not w[0]:
                self.open.remove(w)
                self.full.append(w[1])


def _cut(piece: tuple, k: int) -> tuple:
    doc, start, total, ids = piece
    return (doc, start, total, ids[:k]), (doc, start + k, total, ids[k:])


def _rows(pieces: list[tuple], sequence: int, place: int | None) -> Iterator[tuple]:
    at = 0
    for doc, start, total, ids in pieces:
        yield doc, start, len(ids), crc(ids), total, sequence, at, place, None if place is None else ids.astype("<u4").tobytes()
        at += len(ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*RESULT, "place", "ids"])


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(
    docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID,
    vocabulary: str | None = None, ranks: str | None = None,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs (doc_id, text) is a document, also where doc_ids repeat
    or are null; a null or empty text is the end id alone. Other columns are
    not read. An empty table gives an empty result. All sequences are full but
    for a few at the very end, whose lengths are powers of two. The pass over
    the texts is written to the shared folder once, so that a lost executor
    cannot mix two packings.
    """
    vocabulary, ranks = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, sequence, out = Encoder(vocabulary, ranks), Windows(window, open_windows), 0, []
        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text), end]) if text else end
                windows.put((doc, 0, len(ids), ids), len(ids), _cut)
                for pieces in windows.full:
                    out += _rows(pieces, (part << 24) | sequence, None)
                    sequence += 1
                windows.full.clear()
            if out:
                yield _batch(out)
                out = []
        for _, pieces in windows.open:
            out += _rows(pieces, (part << 24) | sequence, part)
            sequence += 1
        if out:
            yield _batch(out)

    first = materialise(map_arrow(docs.select("doc_id", "text"), run, SCHEMA), "packed")
    parts = [first.filter("place IS NULL").select(RESULT)]
    left, level = first.filter("place IS NOT NULL"), 0
    most = left.agg(F.max("place")).first()[0]
    groups = 0 if most is None else most + 1
    while groups:
        level, groups = level + 1, -(-groups // MERGE)
        done = materialise(_merged(left, window, level, groups == 1), "merged")
        parts.append(done.filter("place IS NULL").select(RESULT))
        left = done.filter("place IS NOT NULL")
        if groups == 1:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _merged(left: DataFrame, window: int, level: int, last: bool) -> DataFrame:
    """Leftover windows of MERGE neighbours poured into full windows; what is
    left of a group goes up a level, or is cut at powers of two on the last."""

    def pour(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        rows = rows.sort_values(["place", "sequence_id", "offset"], kind="stable")
        pieces = [
            (None if pd.isna(d) else int(d), int(s), int(t), np.frombuffer(i, "<u4"))
            for d, s, t, i in zip(rows["doc_id"], rows["start"], rows["doc_tokens"], rows["ids"])
        ]
        total = sum(len(p[3]) for p in pieces)
        sizes = [window] * (total // window)
        rest = total % window
        sizes += powers(rest) if last else [rest] * bool(rest)
        out, k = [], 0
        for number, size in enumerate(sizes):
            own, room = [], size
            while room:
                n = min(room, len(pieces[k][3]))
                head, tail = _cut(pieces[k], n)
                own.append(head)
                room -= n
                if len(tail[3]):
                    pieces[k] = tail
                else:
                    k += 1
            up = not last and size == rest and number == len(sizes) - 1 and size < window
            out += _rows(own, (level << 56) | (group << 24) | number, group if up else None)
        frame = pd.DataFrame(out, columns=[*RESULT, "place", "ids"])
        return frame.astype({"doc_id": "Int64", "place": "Int64"})

    grouped = left.withColumn("_group", F.expr(f"place div {MERGE}")).groupBy("_group")
    return grouped.applyInPandas(pour, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
