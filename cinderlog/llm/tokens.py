"""Token counts of whole texts by a byte-level BPE.

Texts are cut into pre-tokens by character classes, and the transducer of :mod:`transducer` reads all pre-tokens of a slice side
by side. A long text is cut into chunks at any place. What a chunk does to the count, whatever state it is entered in, is its
state map: the characters up to its first certain boundary (their count depends on what came before), the count from there to its
last certain boundary, and the open characters behind it. Maps are composed pairwise, in as many rounds as a prefix scan has, and
the seams of a round are counted together.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, slices, texts_of
from .transducer import TRANSITIONS, BpeTransducer

#: Characters of a chunk.
CHUNK = 1 << 16
_LETTER, _NUMBER, _SPACE, _WHITE, _OTHER = range(5)
#: The characters that count as white space, and the word endings that are pre-tokens of their own.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point, from the general categories."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = _WHITE
    out[32] = _SPACE
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pre_tokens(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. ``heads`` holds the first place of every (non-empty) text."""
    n = len(points)
    kind = _classes()[points]
    white = (kind == _SPACE) | (kind == _WHITE)
    run = np.where(white, np.uint8(_WHITE), kind)
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True
    change = head.copy()
    change[1:n] |= run[1:] != run[:-1]
    start = change[:n].copy()
    # The last of several white characters before a word leaves its run: a blank joins the word, another one stands alone.
    last = np.flatnonzero(white & change[1:] & ~head[1:])
    start[last] = True
    blank = last[kind[last] == _SPACE]
    start[blank + 1] = False
    # Endings after an apostrophe that starts a pre-token.
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[(mark + 1 < n)]
    mark = mark[~head[mark + 1] & (kind[np.minimum(mark + 1, n - 1)] == _LETTER)]
    if len(mark):
        one = points[mark + 1]
        far = np.minimum(mark + 2, n - 1)
        two = np.where((mark + 2 < n) & ~head[np.minimum(mark + 2, n)], points[far], 0)
        size = np.zeros(len(mark), np.int64)
        for ending in ENDINGS:
            fits = one == ord(ending[0])
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            size[fits & (size == 0)] = len(ending)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        after = after[after < n]
        start[after] = True
    return start


def certain_starts(points: np.ndarray) -> np.ndarray:
    """Places inside a chunk where a pre-token starts whatever precedes the chunk: the class changes, and neither a blank nor
    an apostrophe stands before."""
    kind = _classes()[points]
    run = np.where(kind == _SPACE, np.uint8(_WHITE), kind)
    sure = (run[1:] != run[:-1]) & (run[:-1] != _WHITE) & (points[:-1] != 39)
    return np.flatnonzero(sure) + 1


class TokenCounter:
    """Counts as the library does for a byte-level BPE file: special strings in a text are one token each."""

    def __init__(self, vocabulary: str, transitions: int = TRANSITIONS, chunk: int = CHUNK):
        spec = json.loads(vocabulary)
        special = spec.get("added_tokens") or []
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only a byte-level BPE without normalizer and prefix space can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError("special tokens have to be plain strings")
        self.special = sorted((t["content"] for t in special), key=len, reverse=True)
        self.machine, self.chunk = BpeTransducer(vocabulary, transitions), max(2, chunk)

    def _segments(self, text: str) -> tuple[list[str], int]:
        parts, found = [text], 0
        for mark in self.special:
            if mark in text:
                parts = [p for part in parts for p in part.split(mark)]
        found = len(parts) - 1
        return [p for p in parts if p], found

    def plain(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without special strings, each read whole."""
        out = np.zeros(len(texts), np.int64)
        for a, b in slices(texts):
            sizes = np.fromiter((len(t) for t in texts[a:b]), np.int64, b - a)
            if not sizes.sum():
                continue
            joined = "".join(texts[a:b])
            points = _points(joined)
            heads = np.cumsum(sizes) - sizes
            starts = np.flatnonzero(pre_tokens(points, heads[sizes > 0]))
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            place = np.concatenate([[0], np.cumsum(width)])
            begin = place[starts]
            length = np.diff(np.append(begin, place[-1]))
            counts = self.machine.counts(np.frombuffer(joined.encode(), np.uint8), begin, length)
            row = np.searchsorted(heads, starts, side="right") - 1
            # Empty texts share their first place with the next one, which is the last of them.
            out[a:b] = np.bincount(row, weights=counts, minlength=b - a).astype(np.int64)
        return out

    def _map(self, piece: str) -> tuple[str, str, str] | None:
        sure = certain_starts(_points(piece))
        return (piece[: sure[0]], piece[sure[0] : sure[-1]], piece[sure[-1] :]) if len(sure) else None

    def long(self, text: str) -> int:
        """Count of one long text by composing the state maps of its chunks."""
        pieces = [text[i : i + self.chunk] for i in range(0, len(text), self.chunk)]
        maps = [self._map(p) for p in pieces]
        inner = self.plain([m[1] if m else "" for m in maps])
        nodes = [(m[0], int(c), m[2]) if m else (p, None, "") for m, c, p in zip(maps, inner, pieces)]
        while len(nodes) > 1:
            pairs = list(zip(nodes[::2], nodes[1::2]))
            seams = self.plain([a[2] + b[0] if a[1] is not None and b[1] is not None else "" for a, b in pairs])
            joined = []
            for (a, b), seam in zip(pairs, seams):
                if a[1] is None:
                    joined.append((a[0] + b[0], b[1], b[2]))
                elif b[1] is None:
                    joined.append((a[0], a[1], a[2] + b[0]))
                else:
                    joined.append((a[0], a[1] + int(seam) + b[1], b[2]))
            nodes = joined + nodes[2 * len(pairs) :]
        head, count, tail = nodes[0]
        return int(self.plain([head, tail]).sum()) + (count or 0)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Counts of any texts."""
        owner, short, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts, found = self._segments(text)
            total[i] = found
            for part in parts:
                if len(part) > self.chunk:
                    total[i] += self.long(part)
                else:
                    owner.append(i)
                    short.append(part)
        if short:
            np.add.at(total, np.array(owner), self.plain(short))
        return total


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> TokenCounter:
    """One per Python worker: the states found by a task serve the next."""
    return TokenCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    ``vocabulary`` is the JSON text of the tokenizer, read once by the driver. Null counts as empty: 0 bytes, 0 tokens. Other
    columns stay; those named like the new ones are replaced. Rows never leave their partition.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    docs = docs.drop(*new)
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(words.value)
        for part in parts:
            texts = texts_of(part.column(part.schema.get_field_index(text)))
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            found = machine.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(sizes), pa.array(found)], names=[*part.schema.names, "n_bytes", "n_tokens"]
            )

    schema = columns_of(docs) + ", n_bytes long, n_tokens long"
    return docs.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


