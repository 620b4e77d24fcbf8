"""Vectorised words, word hashes and window hashes over Arrow string arrays."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; bounds a Python worker's memory.
PIECE_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(text).fill_null(0), dtype=np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words (runs of anything but space and \\t to \\r) of an array of texts; null is a text without words.

    ``buf`` holds the bytes, ``starts`` and ``lens`` place each word in it, and
    words ``at[i]`` to ``at[i + 1]`` are those of text i.
    """

    def __init__(self, text: pa.Array, lower: bool = False):
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        text = text.fill_null("").cast(pa.large_string())
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        buf = raw[off[0] : off[-1]]
        off = off - off[0]
        self.buf = _LOWER[buf] if lower else buf
        n = len(buf)
        inside = ~_SPACE[buf]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | cut[1:n]
            last[:-1] &= ~inside[1:] | cut[1:n]
        self.starts = np.flatnonzero(first)
        self.lens = np.flatnonzero(last) + 1 - self.starts
        self.at = np.searchsorted(self.starts, off)
        self.off = off

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self, i: int, stay: np.ndarray | None = None) -> str:
        """Text i's words (those that ``stay``) joined by a space."""
        a, z = self.starts[self.at[i] : self.at[i + 1]], self.lens[self.at[i] : self.at[i + 1]]
        if not len(a):
            return ""
        raw = self.buf[a[0] : a[-1] + z[-1]].tobytes()
        words = raw.split()
        if stay is not None and not stay.all():
            words = list(itertools.compress(words, stay.tolist()))
        return b" ".join(words).decode("utf-8", "replace")

    def lanes(self) -> np.ndarray:
        """The first eight bytes of every word as a little-endian number, what lies beyond the word masked off."""
        return self._lane(self.starts, self.lens)

    def _lane(self, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_padded"):
            self._padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        view = np.ndarray(shape=(len(self.buf) + 1,), dtype="<u8", buffer=self._padded, strides=(1,))
        x = view[starts]
        bits = np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        return np.where(left >= 8, x, x & ((np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1)))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        with np.errstate(over="ignore"):
            h = (self.lens.astype(np.uint64) + np.uint64(seed)) * M1
            h = mix(h ^ (self.lanes() * M3))
            todo = np.flatnonzero((self.lens > 8) & (self.lens <= _LONG_WORD))
            k = 8
            while len(todo):
                h[todo] = mix((h[todo] * M2) ^ (self._lane(self.starts[todo] + k, self.lens[todo] - k) * M3))
                k += 8
                todo = todo[self.lens[todo] > k]
        for i in np.flatnonzero(self.lens > _LONG_WORD):
            s = self.starts[i]
            h[i] = xxhash.xxh64_intdigest(self.buf[s : s + self.lens[i]].tobytes(), seed)
        return h


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """The Rabin-Karp value, modulo 2**64, of each run of ``width`` entries of h: the sum of h[i + j] * B**(width - 1 - j).

    Runs of length 1, 2, 4, ... are doubled, and those that make up ``width`` are joined, so that each costs a
    few multiplications whatever the width.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        out, have, run, size = None, 0, h, 1
        left = width
        while True:
            if left & 1:
                if out is None:
                    out, have = run, size
                else:  # out covers what follows the new run
                    m = len(h) - (have + size) + 1
                    out = run[:m] * np.uint64(pow(base, have, 1 << 64)) + out[size : size + m]
                    have += size
            left >>= 1
            if not left:
                return out[:n]
            m = len(run) - size
            run = run[:m] * np.uint64(pow(base, size, 1 << 64)) + run[size : size + m]
            size *= 2


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up in as few bytes each as the largest needs, behind a byte that says how many."""
    top = int(x.max()) if len(x) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)
