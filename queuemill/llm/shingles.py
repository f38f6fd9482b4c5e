"""Hashes of word shingles, computed on whole batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 18
BASE = 0xD6E8FEB86659FD93
#: Odd multipliers, one per word of a shingle; more words take powers of BASE.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 1 << 64)
            steps = [np.full(n, x, U) for x in (BASE, inverse)]
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES; a longer text is a range of its own."""
    begin = 0
    while begin < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1
        end = min(max(end, begin + 1), len(offsets) - 1)
        yield begin, end
        begin = end


def _words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that lie end to end in ``data``, and how many words each text has."""
    data = _LOWER[data]
    word = ~_WHITE[data]
    if not word.any():
        return np.zeros(0, U), np.zeros(len(borders) - 1, np.int64)
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = borders[1:-1]
    inner = inner[inner < len(data)]
    starts[inner] = word[inner]
    before = inner[inner > 0] - 1
    ends[before] = word[before]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first])
    return hashes, np.diff(np.searchsorted(first, borders))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of each text, in order.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A text of fewer than
    ``width`` words has one shingle, the whole; one without words, or NULL, has none.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    factors = _powers.get(64)[0] if width <= 64 else _powers.get(width)[0]
    for begin, end in _slices(offsets):
        borders = offsets[begin : end + 1] - offsets[begin]
        hashes, counts = _words(data[offsets[begin] : offsets[end]], borders)
        windows = np.zeros(max(0, len(hashes) - width + 1), U)
        for j in range(width if len(windows) else 0):
            windows += hashes[j : j + len(windows)] * factors[j]
        windows = mix(windows)
        at = 0
        for row, n in enumerate(counts.tolist(), begin):
            if n >= width:
                found = np.sort(windows[at : at + n - width + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield row, found[keep]
            elif n:
                whole = (hashes[at : at + n] * factors[:n]).sum(dtype=U) + U(n)
                yield row, mix(np.array([whole ^ U(0x5851F42D4C957F2D)], U))
            else:
                yield row, np.zeros(0, U)
            at += n
