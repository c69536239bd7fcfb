"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as its byte symbols in a doubly linked list. A heap holds the
adjacent pairs that the vocabulary can merge, by rank and position; the lowest
is popped and merged until none is left. The count is the number of initial
symbols minus the merges: no token identifier is ever produced. Counts of
words are remembered in a bounded table, since words repeat. Texts are split
here by the vocabulary's own pattern; a text with characters that Python's
Unicode tables don't know yet is split by the library, whose tables differ.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import documents, map_arrow

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Words remembered by a worker, and their length at most; the table is emptied when it is full.
REMEMBERED, SHORT = 300_000, 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte:
    itself where printable, else the next free code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, spare = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class WordCounter(dict):
    """Number of tokens of each word; a missing word is merged on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        bpe = model["model"]
        ids = bpe["vocab"]
        suffix = bpe["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + suffix] for s in symbols]
        self.pairs = {(ids[a] << 20) | ids[b]: (rank << 20) | ids[a + b] for rank, (a, b) in enumerate(bpe["merges"])}
        self.split = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.library = path, None
        self.byte = {s: b for b, s in enumerate(symbols)}
        #: Characters seen, all of which Python's tables know.
        self.old: set[str] = set()
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode(errors="surrogateescape"))
        if len(word) <= SHORT and len(self) <= REMEMBERED:
            self[word] = n
        return n

    def merged(self, data: bytes) -> int:
        n = len(data)
        if n == 1:
            return 1
        inner, pairs = self.inner, self.pairs.get
        sym = [inner[b] for b in data]
        sym[-1] = self.final[data[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (hit := pairs((sym[i] << 20) | sym[i + 1])) is not None:
                heap.append(((hit >> 20) << 32) | i)
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            hit = pairs((sym[i] << 20) | sym[j])
            if hit is None or hit >> 20 != top >> 32:  # an older pair at this place
                continue
            sym[i], sym[j] = new, _ = hit & 0xFFFFF, -1
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (hit := pairs((new << 20) | sym[k])) is not None:
                    push(heap, ((hit >> 20) << 32) | i)
            if (p := before[i]) >= 0 and (hit := pairs((sym[p] << 20) | new)) is not None:
                push(heap, ((hit >> 20) << 32) | p)
        return n - merges

    def plain(self, text: str) -> int:
        if not text.isascii():
            if (new := set(text) - self.old) and any(unicodedata.category(c) == "Cn" for c in new):
                return sum(map(self.__getitem__, self.library_words(text)))
            self.old |= new
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased letter by letter: no final form
        return sum(map(self.__getitem__, self.split.findall(text.lower())))

    def library_words(self, text: str) -> list[str]:
        """The words of a text as the library's own tables of characters have them."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, piece)).decode(errors="surrogateescape") for piece, _ in pieces]

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if len(self) > REMEMBERED:
            self.clear()
        if self.specials is None or "<|" not in text:
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null,
    repeated rows are counted one by one, other columns are not read; an empty
    table gives an empty result. Whole texts are counted, of any length.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
