"""Media columns: TIFF images, written and read without an imaging library.

The reader walks the chain of image directories in either byte order, decodes
strips or tiles that are stored plain, as PackBits, LZW or deflate, undoes
the horizontal predictor and gives one row for each page. A strip that is short,
too long or damaged, a size that the data can't hold and an unknown coding are
errors, never filled up. The writer makes
multi-page files in any of these codings from 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow

# Fixed values of the TIFF 6.0 format: tags, field types, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
PLAIN, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Bytes that one stored byte can decode to at most (deflate; the others stay below).
EXPANSION = 1040

ROW = 64
PAGE_ROWS = 4096
STRIP_ROWS = 1024


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes([257 - (j - i), data[i]])
        else:
            j = i
            while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, one code early."""
    bits, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table = {bytes([i]): i for i in range(256)}
    free, width, word = 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = free
        free += 1
        if free == 4095:
            put(256, width)
            table = {bytes([i]): i for i in range(256)}
            free, width = 258, 9
        elif free == (1 << width):
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        free += 1
        if free == (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, table, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, None
    at, total = 0, len(data) * 8
    while at + width <= total and len(out) < size:
        first = at >> 3
        chunk = int.from_bytes(data[first : first + 4].ljust(4, b"\0"), "big")
        code = chunk >> (32 - (at & 7) - width) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code > len(table):
            raise ValueError("LZW code beyond the table")
        else:
            word = last + last[:1]
            table.append(word)
        out += word
        last = word
        n = len(table) + 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    return bytes(out[:size])


def encode_block(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1) if compression in (ADOBE_DEFLATE, DEFLATE) else data


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data[:size]
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (ADOBE_DEFLATE, DEFLATE):
        stream = zlib.decompressobj()
        out = stream.decompress(data, size + 1)
        if not stream.eof:
            raise ValueError("the deflate stream doesn't end with its strip")
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(out) != size:
        raise ValueError(f"a strip or tile of {len(out)} bytes instead of {size}")
    return out


def write_tiff(
    pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS,
    tile: tuple[int, int] | None = None, order: str = "<",
) -> bytes:
    """A TIFF of 8-bit pages, each (rows, columns) or (rows, columns, samples)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        th, tw = tile or (min(strip_rows, max(h, 1)), w)
        offsets, counts = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = page[y : y + th, x : x + tw]
                if tile and block.shape[:2] != (th, tw):
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    diff = block.copy()
                    diff[:, 1:] -= block[:, :-1]
                    block = diff
                data = encode_block(block.tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
                out += b"\0" * (len(out) & 1)
        fields = {WIDTH: [w], LENGTH: [h], BITS: [8] * s, COMPRESSION: [compression], PHOTOMETRIC: [1 if s < 3 else 2], SAMPLES: [s], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tw], TILE_LENGTH: [th], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [th], STRIP_COUNTS: counts}
        entries = []
        for tag, values in sorted(fields.items()):
            kind = 4 if max(values, default=0) > 0xFFFF or tag in (STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS) else 3
            raw = struct.pack(f"{order}{len(values)}{FIELD_CODE[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory; a chain that loops ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        if at + 2 > len(data):
            raise ValueError("a directory lies outside the file")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            where, size = at + 10 + 12 * k, FIELD_SIZE.get(kind, 0) * count
            if kind not in FIELD_CODE:
                continue
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
                if where + size > len(data):
                    raise ValueError(f"field {tag} lies outside the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, where)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_pages(data: bytes) -> Iterator[np.ndarray]:
    """Samples (rows, columns, samples) of each page; 8 or 16 bits, chunky or planar."""
    for order, f in directories(data):
        w, h, s = f[WIDTH][0], f[LENGTH][0], f.get(SAMPLES, (1,))[0]
        bits = f.get(BITS, (1,))[0]
        if bits not in (8, 16) or len(set(f.get(BITS, (1,)))) > 1:
            raise ValueError(f"{bits} bits a sample are not supported")
        kind = np.dtype("u1" if bits == 8 else order + "u2")
        compression, predictor = f.get(COMPRESSION, (PLAIN,))[0], f.get(PREDICTOR, (1,))[0]
        planes = s if f.get(PLANAR, (1,))[0] == 2 else 1
        per = s // planes
        tiled = TILE_OFFSETS in f
        th, tw = (f[TILE_LENGTH][0], f[TILE_WIDTH][0]) if tiled else (min(f.get(ROWS_PER_STRIP, (h,))[0], max(h, 1)), w)
        offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} is not supported")
        if min(w, h, s, th, tw) < 1 or planes * per != s:
            raise ValueError("a page without samples")
        if len(offsets) != len(counts) or len(offsets) < planes * -(-h // th) * -(-w // tw):
            raise ValueError("strips or tiles are missing")
        if max(w * h, th * tw) * s * kind.itemsize > EXPANSION * sum(min(c, len(data)) for c in counts):
            raise ValueError(f"{w} x {h} samples are more than the data can hold")
        page = np.zeros((h, w, s), kind.newbyteorder("="))
        k = 0
        for plane in range(planes):
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    rows = th if tiled else min(th, h - y)
                    raw = decode_block(data[offsets[k] : offsets[k] + counts[k]], compression, rows * tw * per * kind.itemsize)
                    block = np.frombuffer(raw, kind).reshape(rows, tw, per).astype(page.dtype)
                    if predictor == 2:
                        block = np.cumsum(block, axis=1, dtype=page.dtype)
                    page[y : y + rows, x : x + tw, plane * per : (plane + 1) * per] = block[: h - y, : w - x]
                    k += 1
        yield page


def features(pages: list[np.ndarray]) -> str:
    """Pages, size, sum, sum of squares and a 16-bin histogram of the samples."""
    counts = sum((np.bincount(p.reshape(-1), minlength=256) for p in pages), np.zeros(256, np.int64))
    level = np.arange(len(counts))
    bins = ",".join(map(str, counts.reshape(16, -1).sum(axis=1)))
    return f"pages={len(pages)};rows={sum(p.shape[0] for p in pages)};columns={pages[0].shape[1]};sum={int(counts @ level)};squares={int(counts @ level**2)};bins={bins}"


def text_payload(data: bytes) -> bytes:
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0")


def text_to_tiff(payload: bytes) -> bytes:
    """The payload as rows of 64 8-bit samples, deflate strips with predictor, 4096 rows a page."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_tiff([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)])


def tiff_pages(images: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each page of each image: key, page, width, height, samples, pixels, error.

    A null or broken image gives one row with page -1 and the reason in error;
    an image without directories gives none. The key must be a long; null keys
    and repeated rows stay. Other columns are not read.
    """
    schema = "key long, page int, width int, height int, samples int, pixels binary, error string"
    names = ["key", "page", "width", "height", "samples", "pixels", "error"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    if data is None:
                        raise ValueError("no image")
                    for n, p in enumerate(read_pages(data)):
                        rows.append((k, n, p.shape[1], p.shape[0], p.shape[2], p.tobytes(), None))
                except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    rows = [(k, -1, None, None, None, None, str(e) or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return map_arrow(images.select(key, column), run, schema).withColumnRenamed("key", key)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a TIFF, read back, and described by what was read.

    A null text is empty (64 zero bytes). Null doc_ids and repeated rows stay;
    equal texts give equal values; other columns are not read; an empty table
    gives an empty result.
    """
    names = [c.split()[0] for c in MEDIA_SCHEMA.split(", ")]

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = text_to_tiff(text_payload(raw))
        pages = list(read_pages(media))
        back = b"".join(p.tobytes() for p in pages)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return map_arrow(docs.select("doc_id", "text"), run, MEDIA_SCHEMA)


def op9_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
