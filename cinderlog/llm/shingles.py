"""Hashed word shingles of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import SLICE, mixed, slices
from .powers import powers

#: Bytes from which a word is hashed by itself.
_LONG = 1 << 16
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(_LOWER + np.uint64(0x51ED27))


def _window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a piece that ends between words."""
    ink = ~_WHITE[data]
    edge = np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8))
    begin, close = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    large = np.flatnonzero(close - begin > _LONG)
    if len(data) > 4 * SLICE:  # one huge word and what is around it
        out = np.zeros(len(begin), np.uint64)
        for i in range(len(begin)):
            if close[i] - begin[i] <= _LONG:
                out[i] = _window(data[begin[i] : close[i]])[1][0]
    else:
        power, inverse = powers(len(data))
        sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * power[: len(data)]))
        out = mixed((sums[close] - sums[begin]) * inverse[begin] + (close - begin).astype(np.uint64))
    for i in large:
        word = _LOWER[data[begin[i] : close[i]]].astype(np.uint8).tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return begin, out


def _words(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and hashes of the words, piece by piece."""
    at = 0
    while at < len(data):
        to = min(at + 2 * SLICE, len(data))
        if to < len(data):
            blank = np.flatnonzero(_WHITE[data[at:to]])
            if len(blank):
                to = at + int(blank[-1]) + 1
            else:
                while to < len(data) and not _WHITE[data[to]]:
                    more = np.flatnonzero(_WHITE[data[to : to + SLICE]])
                    to = to + int(more[0]) if len(more) else min(to + SLICE, len(data))
        begin, hashes = _window(data[at:to])
        yield begin + at, hashes
        at = to


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (runs of other than ASCII white space, A-Z as a-z), and the text it is in."""
    data = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8)
    ends = np.cumsum(np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts)))
    found = list(_words(data))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin, hashes = (np.concatenate(x) for x in zip(*found))
    return hashes, np.searchsorted(ends, begin, side="right")


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """For each text in turn its distinct shingles of ``words`` words, as 62-bit hashes in order; a shorter text is one shingle."""
    for a, b in slices(texts):
        hashes, row = word_hashes(texts[a:b])
        step = np.uint64(0x9E3779B97F4A7C15)
        n = len(hashes)
        full = np.zeros(max(n - words + 1, 0), np.uint64)
        for j in range(words):
            full = mixed(full * step + hashes[j : j + len(full)])
        whole = row[: len(full)] == row[words - 1 :] if len(full) else np.zeros(0, bool)
        full, own = full[whole] >> np.uint64(2), row[: len(full)][whole]
        first = np.searchsorted(own, np.arange(b - a + 1))
        begin = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            if first[i] < first[i + 1]:
                yield np.unique(full[first[i] : first[i + 1]])
            elif begin[i] < begin[i + 1]:
                value = np.zeros(1, np.uint64)
                for h in hashes[begin[i] : begin[i + 1]]:
                    value = mixed(value * step + h)
                yield mixed(value + np.uint64(begin[i + 1] - begin[i])) >> np.uint64(2)
            else:
                yield np.zeros(0, np.uint64)
