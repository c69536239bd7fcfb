"""Line dedup, SimHash, token counts, packing and TIFF against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstream.llm import line_dedup, media_tiff, packing, simhash, token_count

from .conftest import ROWS


def _lines_brute(rows, min_chars, min_docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in top and i is not None and top[key(x)] not in (None, i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = ["This line is long enough to count", "  THIS LINE is long enough to count\t", "Another one that is quite long too", "short"]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = [(i, "\n".join(LINES[j] for j in range(4) if (i >> j) & 1)) for i in range(16)] + [(None, LINES[0]), (15, LINES[0]), (20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(docs, 20, 3, batches, fanout).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == _lines_brute(rows, 20, 3)


def test_line_dedup_edges(clashing, none):
    got = line_dedup.drop_repeated_lines(clashing, 5, 2)
    assert set(got.columns) >= {"h", "score", "label", "n_lines", "n_dropped"} and got.count() == len(ROWS)
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_runs_keep_keys_once(spark):
    runs = line_dedup.LevelledRuns(spark, 2)
    new = [runs.add(spark.createDataFrame([(bytes([k]), d) for k, d in part], "h binary, doc_id long")).count() for part in ([(1, 1), (2, 1)], [(2, 2), (3, 2)], [(1, 3), (3, 3), (4, 3)], [(9, 4)])]
    assert new == [2, 1, 1, 1]
    assert sorted(r["h"] for r in runs.runs().collect()) == [bytes([k]) for k in (1, 2, 3, 4, 9)]
    assert len(runs.levels) > 1 and {bytes(r["h"]): r["top"] for r in runs.frequent(2).collect()} == {b"\1": 3, b"\2": 2, b"\3": 3}


def _simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB c\n\x0b\x1cé", max_size=60) | st.none())
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _simhash_brute(text)


def _components_brute(codes, ids):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(codes))]


@pytest.mark.parametrize("bucket, piece", [(64, 4096), (1, 40), (4, 10)])
def test_components(spark, bucket, piece):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    codes = set(base)
    for k in range(900):
        c = base[0 if k < 400 else int(rng.integers(12))]
        for _ in range(int(rng.integers(0, 6))):
            c ^= 1 << int(rng.integers(64))
        codes.add(c)
    codes = sorted(codes)
    ids = [int(x) for x in rng.permutation(len(codes))]
    rows = spark.createDataFrame([(i, simhash._signed(c)) for i, c in zip(ids, codes)], "node long, code long")
    found = dict(map(tuple, simhash.components(simhash.links(rows, len(codes), 4, bucket, piece)).collect()))
    assert [found.get(i, i) for i in ids] == _components_brute(codes, ids)


def test_near_duplicates(docs, clashing, none):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(clashing).collect()}
    known = [(i, t) for i, t, *_ in ROWS if i is not None]
    want = dict(zip([i for i, _ in known], _components_brute([_simhash_brute(t) for _, t in known], [i for i, _ in known])))
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == want and got[None]["component_id"] is None
    assert simhash.near_duplicates(docs).count() == len(ROWS) and simhash.near_duplicates(none).count() == 0


def test_gray_rank_is_the_sequence():
    n = np.arange(64, dtype=np.uint64)
    gray = n ^ (n >> np.uint64(1))
    assert (simhash.gray_rank(gray) == n).all()


WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
COUNTER = token_count.WordCounter(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abthe 'sΣσİé1½<|endoftext>", max_size=60))
def test_token_count(text):
    assert COUNTER.count(text) == len(WORD.encode(text, add_special_tokens=False).ids)


def test_token_count_rows(clashing, none):
    got = token_count.count_tokens(clashing).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(
        (i or 0, len((t or "").encode()), n, n > 2048) for i, t, *_ in ROWS for n in [len(WORD.encode(t or "", add_special_tokens=False).ids)]
    )
    assert token_count.count_tokens(none).count() == 0


BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab  \n\t'sé1<|endoftext>", max_size=80))
def test_encoders_agree(text):
    assert ENCODER(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("parts, window, opened", [(1, 2048, 16), (5, 2048, 16), (6, 256, 2)])
def test_packing(clashing, parts, window, opened):
    rows = packing.pack(clashing.repartition(parts), window, opened).collect()
    want = defaultdict(int)
    for i, t, *_ in ROWS:
        want[i, zlib.crc32(np.array([*BYTES.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t, *_ in ROWS:
        ids = np.array([*BYTES.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        if i == 6:  # a doc_id that repeats has every token twice
            assert sum(r["length"] for r in by_doc[i]) == 2 * len(ids)
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert all(s == window or (s < window and s & (s - 1) == 0) for s in sizes)
    assert sum(s < window for s in sizes) <= window.bit_length()


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.lists(st.sampled_from([b"aaaa", b"ab", b"\0" * 150]), max_size=8).map(b"".join))
def test_tiff_codings(data):
    for kind in (media_tiff.PLAIN, media_tiff.LZW, media_tiff.PACKBITS, media_tiff.ADOBE_DEFLATE):
        assert media_tiff.decode_block(media_tiff.encode_block(data, kind), kind, len(data)) == data


def test_tiff_pages(spark):
    rng = np.random.default_rng(1)
    image, long_ = rng.integers(0, 256, (37, 50, 3), dtype=np.uint8), rng.bytes(70_000)
    assert media_tiff.lzw_decode(media_tiff.lzw_encode(long_), len(long_)) == long_
    for kind in (1, 5, 8, 32773, 32946):
        for tile in (None, (16, 32)):
            for order in "<>":
                pages = list(media_tiff.read_pages(media_tiff.write_tiff([image, image[:5, :9, 0]], kind, 2, 8, tile, order)))
                assert (pages[0] == image).all() and (pages[1][:, :, 0] == image[:5, :9, 0]).all()
    good = media_tiff.write_tiff([image, image[:2]], 5)
    rows = spark.createDataFrame([(1, good), (2, None), (3, b"II*\0junk"), (None, good[:40])], "doc_id long, media binary")
    got = media_tiff.tiff_pages(rows).collect()
    assert [(r["page"], r["width"], r["height"]) for r in got if r["doc_id"] == 1] == [(0, 50, 37), (1, 50, 2)]
    assert all(r["page"] == -1 and r["error"] for r in got if r["doc_id"] in (2, 3))


def test_text_media(clashing, none):
    got = media_tiff.text_media(clashing).collect()
    assert len(got) == len(ROWS)
    want = {(i, hashlib.sha256(media_tiff.text_payload((t or "").encode())).hexdigest()) for i, t, *_ in ROWS}
    assert {(r["doc_id"], r["payload_sha256"]) for r in got} == want
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"]) for r in got)
    assert media_tiff.text_media(none).count() == 0


def test_line_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = sorted(map(tuple, line_dedup.op5_line_dedup(spark, small).collect()))
    assert got == sorted(con.sql(line_dedup.OP5_SQL).fetchall())
