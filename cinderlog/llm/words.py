"""Words of whole texts (runs of other than ASCII white space), with a number for each that is equal for equal words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Words:
    """``spaced``: the bytes of all words, each followed by a blank. ``length``: bytes of each. ``number``: its place in ``known``.
    ``known``: the different words. ``sizes``: words of each text."""

    spaced: np.ndarray
    length: np.ndarray
    number: np.ndarray
    known: pa.Array
    sizes: np.ndarray


def read_words(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    ink = ~_WHITE[data]
    edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    if ink[0]:
        edge = np.concatenate([[0], edge])
    begin, close = edge[::2], edge[1::2]
    length = close - begin
    sizes = np.diff(np.searchsorted(begin, ends), prepend=0)
    offsets = np.concatenate([[0], np.cumsum(length)])
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[ink])])
    coded = held.dictionary_encode()
    spaced = data.copy()
    spaced[close] = 32
    ink = ink.copy()
    ink[close] = True
    return Words(spaced[ink], length, coded.indices.to_numpy().astype(np.int64), coded.dictionary, sizes)


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` that start at ``at`` and have ``size`` values, after each other."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
