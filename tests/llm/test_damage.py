"""Damaged images, and characters on which the tables of libraries differ."""

import random
import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quillstream.llm import langid, media_tiff, token_count
from quillstream.llm.media_tiff import ADOBE_DEFLATE, LZW, PACKBITS, PLAIN, write_tiff

IMAGE = np.add.outer(np.arange(200), np.arange(64)).astype(np.uint8)


def _pages(spark, files):
    rows = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "doc_id long, media binary")
    return {r["doc_id"]: r for r in media_tiff.tiff_pages(rows).collect()}


def _patched(data, tag, value):
    at = struct.unpack_from("<I", data, 4)[0]
    out = bytearray(data)
    for k in range(struct.unpack_from("<H", data, at)[0]):
        if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == tag:
            struct.pack_into("<HII", out, at + 4 + 12 * k, 4, 1, value)
    return bytes(out)


def test_damage_is_an_error(spark):
    good = [write_tiff([IMAGE], c, 1) for c in (PLAIN, PACKBITS, LZW, ADOBE_DEFLATE)]
    counts = [media_tiff.directories(f).__next__()[1][media_tiff.STRIP_COUNTS][0] for f in good]
    bad = [_patched(f, media_tiff.STRIP_COUNTS, n // 2) for f, n in zip(good, counts)]
    bad += [_patched(good[0], media_tiff.PREDICTOR, 3), _patched(_patched(good[3], media_tiff.WIDTH, 200_000), media_tiff.LENGTH, 200_000)]
    bad += [_patched(good[0], media_tiff.WIDTH, 0), good[0][:-20], b"II*\0" + b"\xff" * 40]
    got = _pages(spark, good + bad)
    assert all(got[k]["error"] is None and got[k]["pixels"] == IMAGE.tobytes() for k in range(4))
    assert all(got[k]["page"] == -1 and got[k]["error"] for k in range(4, len(good) + len(bad)))


@pytest.mark.parametrize("compression", [PLAIN, PACKBITS, LZW, ADOBE_DEFLATE])
def test_random_damage_never_kills(compression):
    r, data = random.Random(compression), write_tiff([IMAGE, IMAGE[:50]], compression)
    for _ in range(300):
        broken = bytearray(data)
        for _ in range(r.randrange(1, 5)):
            broken[r.randrange(len(broken))] = r.randrange(256)
        try:
            list(media_tiff.read_pages(bytes(broken)))
        except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error):
            pass


def test_characters_that_tables_differ_on():
    counter = token_count.WordCounter(public_tokenizers.path(token_count.VOCABULARY))
    library = Tokenizer.from_file(public_tokenizers.path(token_count.VOCABULARY))
    r = random.Random(1)
    texts = ["у\U00019169", "✓\U0001DF55", "Ɤ x Ƛ", "a\U00016EA0b \U00011DB0", "plain", "é\U0001E6C0"]
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(r.choice(points)) if r.random() < 0.5 else r.choice("ab 1é's") for _ in range(12)) for _ in range(3000)]
    for t in texts:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), ascii(t)


def test_a_small_language_keeps_its_words(spark):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(400)), "en") for i in range(60)] + [(99, "zaba pelu zaba mirdo " * 3, "qq")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), kept=50)
    assert model.predict("zaba mirdo pelu")[0] == "qq"
