"""PNG columns: bytes stored as grey samples, read back chunk by chunk, and hashed by low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of a stored image, and rows of 64 bytes in a payload.
WIDTH = 64
#: Bytes per pixel by PNG colour type, 8 bits a sample: grey, RGB, grey and alpha, RGBA.
PIXEL = {0: 1, 2: 3, 4: 2, 6: 4}


class BadImage(ValueError):
    """Bytes that are no readable 8-bit PNG: wrong signature, checksum, size or kind."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """Store bytes losslessly as an 8-bit grey image, `width` samples a row; the length must be a multiple of it.

    One row filter (none, left or up) serves the whole image: the one with the least sum of signed differences.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    best = min(range(3), key=lambda k: int(np.abs((rows, left, up)[k].view(np.int8).astype(np.int16)).sum()))
    filtered = np.empty((len(rows), width + 1), np.uint8)
    filtered[:, 0], filtered[:, 1:] = best, (rows, left, up)[best]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the filters that look at the pixel to the left and above, which go pixel by pixel (average, Paeth)."""
    out = np.zeros(len(line) + bpp, np.int64)
    upper = np.concatenate([np.zeros(bpp, np.int64), above.astype(np.int64)])
    for i in range(bpp, len(out)):
        a, b, c = out[i - bpp], upper[i], upper[i - bpp]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (line[i - bpp] + guess) & 255
    return out[bpp:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG, rows by bytes in a row. Every chunk's checksum is tested.

    All five row filters are undone; runs of rows with the same simple filter in one numpy step. Raises BadImage for
    whatever is not such an image, interlaced and palette images included.
    """
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            raise BadImage("a chunk is cut short")
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise BadImage("a chunk's checksum is wrong")
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if header is None or not ended:
        raise BadImage("no header or no end")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or colour not in PIXEL or interlaced:
        raise BadImage("not a plain 8-bit image")
    bpp = PIXEL[colour]
    stride = width * bpp
    try:
        raw = zlib.decompressobj().decompress(b"".join(parts), height * (stride + 1) + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from None
    if len(raw) != height * (stride + 1):
        raise BadImage("the samples do not fill the image")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    kinds, body = lines[:, 0], lines[:, 1:]
    out, above = np.empty((height, stride), np.uint8), np.zeros(stride, np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, height], strict=True):
        kind = int(kinds[a]) if height else 0
        if kind == 0:
            out[a:b] = body[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(body[a:b].reshape(b - a, width, bpp), axis=1, dtype=np.uint8).reshape(b - a, stride)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([above[None], body[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(a, b):
                out[y] = above = _unfilter(kind, body[y], above, bpp)
        else:
            raise BadImage("an unknown row filter")
        if b > a:
            above = out[b - 1]
    return out


_N, _LOW = 32, 8
_k, _x = np.arange(_N)[:, None], np.arange(_N)[None, :]
#: The orthonormal cosine transform of 32 samples.
COSINE = np.where(_k == 0, np.sqrt(1 / _N), np.sqrt(2 / _N)) * np.cos(np.pi * (2 * _x + 1) * _k / (2 * _N))


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means over `n` nearly equal bands of the first axis; with fewer rows than bands, rows repeat."""
    starts = np.arange(n) * len(a) // n
    sums = np.add.reduceat(a, starts, axis=0)
    counts = np.maximum(1, np.diff(np.append(starts, len(a))))
    return sums / counts[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the 8 by 8 lowest frequencies lie above their median, the constant one apart."""
    small = _means(_means(samples.astype(np.float64), _N).T, _N).T
    low = np.round(COSINE[:_LOW] @ small @ COSINE[:_LOW].T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = (text or "").encode("utf-8")
            media = encode_png(data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)))
            samples = decode_png(media)
            back = samples.tobytes()
            rows.append((doc_id, len(data), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), cosine_hash(samples)))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.string())],
            names=["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"],
        )


def media_column(df: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a PNG in the binary column `media`.

    The payload's figures and the cosine hash come from the samples read back out of the PNG. A null text counts as
    empty: 64 bytes of 0. Needs doc_id, which may be null, and text; other columns, of any names, are not carried. Row by row, without a
    shuffle: repeated rows give equal rows, an empty table gives none, and a task holds one text and its samples, however long it is.
    """
    return df.select("doc_id", "text").mapInArrow(_store, SCHEMA)


def op3_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as PNG columns, as figures and digests."""
    return media_column(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
