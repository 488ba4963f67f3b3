"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return scramble((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


class Spans:
    """Keyed 64-bit hashes of any spans of a byte array, equal for equal bytes.

    A span is read in chunks of 8 bytes; each is scrambled under a key for its place, and the sum is scrambled with the length. Spans of
    one chunk never collide; for longer ones a collision takes knowledge of the key, which callers draw anew for every run.
    """

    def __init__(self, key: int = 1):
        self.key = np.array([key & (1 << 64) - 1], np.uint64)
        self.places = scramble(self.key)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """The 8 bytes from each position on, zeros after the end."""
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))

    def hashes(self, chunks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = scramble(chunks[starts] & _low_bytes(size) ^ self.places[0])
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) >> 3  # further chunks
            most = int(n.max()) + 1
            if len(self.places) < most:
                room = np.arange(2 * most, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                self.places = scramble(room + self.key)
            own = np.repeat(long, n)
            first = np.cumsum(n) - n
            place = np.arange(len(own)) - np.repeat(first, n) + 1
            chunk = chunks[starts[own] + 8 * place] & _low_bytes(size[own] - 8 * place)
            out[long] += np.add.reduceat(scramble(chunk ^ self.places[place]), first)
        return scramble(out ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.key))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _low_bytes(size: np.ndarray) -> np.ndarray:
    """Masks of the bytes of a chunk that lie in a span of so many bytes."""
    return _MASKS[np.minimum(size, 8)]


class Rolling:
    """64-bit polynomial hashes of all windows of one width; equal for equal bytes, and at times for others."""

    def __init__(self, width: int, seed: int = 1):
        self.width, self.table = width, numbers(256, seed)
        self.base = np.uint64(int(numbers(1, seed + 7)[0]) & ~7 | 5)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            room = max(n + 1, 2 * len(self.up))
            steps = np.full(room, self.base, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = np.uint64(pow(int(self.base), -1, 1 << 64))
            self.down = np.cumprod(steps)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        return scramble((total[self.width :] - total[: n - self.width + 1]) * self.down[: n - self.width + 1])


def word_spans(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~spaces[data]
    edges = offsets[offsets < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    last = offsets[offsets > 0] - 1
    finishes[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, rows_of(starts, offsets)


def rows_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each ascending byte position lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(positions, offsets)))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of 0/1 flags over the bytes of each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15 | 1) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return scramble(out)


def keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return scramble(hashes ^ (rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of keys that occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def first_seen(keys: np.ndarray) -> np.ndarray:
    """Flags of the first occurrence of each key."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out
