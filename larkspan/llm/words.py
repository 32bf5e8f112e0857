"""Words and word n-grams of many texts at once, by numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240917)
#: A random 64-bit value for each byte, and an odd factor for its place; fixed, so that hashes agree everywhere.
_BYTES = _SEED.integers(1, 1 << 64, 256, np.uint64)
_FACTOR = int(_SEED.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1
_MASK = (1 << 64) - 1
_GRAM = np.uint64(int(_SEED.integers(1, 1 << 62, dtype=np.uint64)) * 2 + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. Sorting is several times faster here than the hash table behind numpy's unique."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_FACTOR, -1, 1 << 64)

    def table(f: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(f, len(out), 1 << 64))])
        return out[:n]

    return table(_FACTOR), table(inverse)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins in them, with the end behind; null texts are empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, ends, data = col.buffers()
    offsets = np.frombuffer(ends, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or offsets[0] == offsets[-1]:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a column of texts: runs of what is not ASCII white space, with or without A-Z in lower case.

    start, end: places in the bytes; text: the number of the text that each word is in; hash: 64 bits of the word's bytes;
    first: number of each text's first word, with the number of words behind.
    """

    def __init__(self, col: pa.Array, lower: bool = False):
        data, offsets = utf8(col)
        self.data, self.offsets = data, offsets
        if lower and len(data):
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        inside = (data != 32) & ((data < 9) | (data > 13))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = inside[edges]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        stops[edges] = inside[edges]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        n = len(data)
        power, inverse = powers(max(1 << 22, 1 << max(0, n - 1).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[:n], out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash for each place where n words of one text follow each other, and the number of the first word."""
        count = len(self) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        # Sums of doubling length: x of 2k words is that of k words, times the factor's k-th power, plus that of the next k.
        out, have, base = None, 0, (self.hash, 1)
        rest = n
        while rest:
            values, size = base
            if rest & 1:
                if out is None:
                    out, have = values, size
                else:
                    f = np.uint64(pow(int(_GRAM), size, 1 << 64))
                    m = min(len(out), len(values) - have)
                    out, have = out[:m] * f + values[have : have + m], have + size
            rest >>= 1
            if rest:
                f = np.uint64(pow(int(_GRAM), size, 1 << 64))
                base = values[:-size] * f + values[size:], 2 * size
        at = np.flatnonzero(self.text[:count] == self.text[n - 1 :])
        return mix64(out[at] + np.uint64(n)), at
