"""Word and shingle hashes of whole Arrow batches with numpy: no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
#: Bytes that are worked on at once; a longer text is taken alone.
CHUNK = 1 << 18
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]  # lower-cases A-Z
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, kept for the life of a worker."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(base):
                full = np.full(n, U(base), U)
                full[0] = U(1)
                return np.multiply.accumulate(full)

            self.up, self.down = run(_BASE), run(pow(_BASE, -1, 2**64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to limit bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+, which never cross texts, and the first word of each text (one more entry
    for the end). data begins at offsets[0]. separator: another table of the bytes between words."""
    at = offsets - offsets[0]
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    stops = at[1:][at[1:] > 0] - 1
    after[stops] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: a polynomial of random byte values, taken from prefix sums."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, the first word of each text and one more entry). offsets are into data."""
    part = data[offsets[0] : offsets[-1]]
    starts, ends, first = word_spans(part, offsets)
    return hash_words(part, starts, ends), first


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs that cross texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(k), U)
    for j in range(k):
        h = mix(h * GOLDEN + hashes[j : j + n])
    return h


def text_shingles(h: np.ndarray, all_shingles: np.ndarray, first: int, last: int, k: int) -> np.ndarray:
    """Distinct shingle hashes, sorted, of the text of words first to last; with fewer words than k, its whole sequence."""
    if last - first >= k:
        return np.unique(all_shingles[first : last - k + 1])
    return shingles(h[first:last], last - first) if last > first else np.zeros(0, U)


class Lookup:
    """Positions of 64-bit keys in a table, found for whole arrays at once: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for one slot the last stays
            self.key[slot[free]] = keys[left[free]]
            lost = self.at[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * GOLDEN) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table's array, or -1."""
        slot = self._slot(keys)
        out, miss = self.at[slot], self.key[slot] != keys
        more = np.flatnonzero(miss & (out >= 0))
        out[miss] = -1
        slot = slot[more]
        while len(more):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            at, hit = self.at[slot], self.key[slot] == keys[more]
            out[more[hit & (at >= 0)]] = at[hit & (at >= 0)]
            go = ~hit & (at >= 0)
            more, slot = more[go], slot[go]
        return out


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts) pairs, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
