"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. The field sees features of the line itself and of the lines before and after it, and a chain of
transitions between neighbours. It learns from documents marked as a whole: all lines of a good document are good; which lines of
a bad document are bad is found by rounds in which its lines take the probabilities of the field so far, shifted so that the worst
line counts as bad. Forward-backward gives each line's probability of being good; weighted by length these give the document's
share of good text, and a logistic curve fitted on the learning documents turns the share into the score.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, discard, lean, mixed, slices, texts_of, written
from .powers import powers

#: Documents that the fit uses at most, the first by a hash of their id, and lines of all of them within which the last one starts.
SAMPLE, SAMPLE_LINES = 3000, 200_000
_SMALL, _LARGE, _DIGIT, _BLANK, _STOP, _MARK, _SYMBOL, _BAR, _LETTER = range(9)
FEATURES = ("one", "length", "large", "stops", "marks", "symbols", "bars", "digits", "repeats", "word", "all_large", "glued", "ends", "same")


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"Lu": _LARGE, "Lt": _LARGE, "Ll": _SMALL, "Nd": _DIGIT, "Nl": _DIGIT, "No": _DIGIT}
    out = np.full(0x110000, _SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = kinds.get(kind, _LETTER if kind[0] in "LM" else _BLANK if kind[0] in "ZC" else _SYMBOL)
    for marks, kind in ((".,;:'\"-()?", _STOP), ("!", _MARK), ("|", _BAR)):
        out[[ord(c) for c in marks]] = kind
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length plus one, and the lines of each text. Lines are split at line ends; an empty text has one."""
    joined = "".join(t + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10)
    starts = np.append(0, ends[:-1] + 1)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    lines = np.bincount(np.searchsorted(np.cumsum(sizes), ends, side="right"), minlength=len(texts))
    kind = _classes()[points]
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    n = {k: total(kind == k) for k in range(9)}
    length = (ends - starts).astype(float)
    letters = n[_SMALL] + n[_LARGE] + n[_LETTER]
    filled = np.maximum(length - n[_BLANK] + 1, 1)
    # Words: their number, and how many repeat the word before.
    ink = kind != _BLANK
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begin = np.flatnonzero(first)
    close = np.flatnonzero(ink & np.append(~ink[1:], True)) + 1
    words = total(first)
    repeats = np.zeros(len(starts))
    glued = np.zeros(len(starts))
    if len(begin):
        value = mixed(points.astype(np.uint64) + np.uint64(7))
        power = powers(len(points))
        sums = np.append(np.uint64(0), np.cumsum(value * power[0][: len(points)]))
        word = (sums[close] - sums[begin]) * power[1][begin]
        line = np.searchsorted(ends, begin)
        again = np.append(False, (word[1:] == word[:-1]) & (line[1:] == line[:-1]))
        repeats = np.bincount(line, weights=again, minlength=len(starts))
        odd = (kind[close - 1] == _SYMBOL) | (kind[close - 1] == _MARK) | (kind[close - 1] == _BAR)
        glued = np.bincount(line, weights=odd, minlength=len(starts))
    lineword = np.maximum(words, 1)
    last = kind[np.maximum(ends - 1, 0)]
    # The same line as the one before, by its word hashes' sum and length.
    if len(begin):
        mark = np.zeros(len(starts), np.uint64)
        np.add.at(mark, line, mixed(word + np.arange(len(word), dtype=np.uint64) - np.searchsorted(begin, starts)[line].astype(np.uint64)))
        same = np.append(False, (mark[1:] == mark[:-1]) & (length[1:] == length[:-1]) & (length[1:] > 0))
    else:
        same = np.zeros(len(starts), bool)
    same[np.cumsum(lines) - lines] = False
    out = np.stack([
        np.ones(len(starts)), np.log1p(length) / 5, n[_LARGE] / np.maximum(letters, 1), n[_STOP] / filled * 5, np.minimum(n[_MARK] / lineword, 1),
        np.minimum(n[_SYMBOL] / lineword, 1), np.minimum(n[_BAR] / lineword, 1), n[_DIGIT] / filled, repeats / lineword,
        np.minimum(letters / lineword, 20) / 5, (n[_LARGE] > 0) & (n[_SMALL] == 0), glued / lineword, (ends > starts) & (last == _STOP), same,
    ], axis=1).astype(np.float32)
    return out, length + 1, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after; zeros beyond the document."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(lines) - lines] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[np.append(first[1:], True)] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(logit: np.ndarray, stay: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good (state 1), and for each line of the pair it forms with the next one (2 x 2; the last
    line of a document: zeros). Documents run side by side, longest first. ``stay``: 2 x 2 transition weights."""
    p, pair = np.zeros(len(logit)), np.zeros((len(logit), 2, 2))
    order = np.argsort(-lines, kind="stable")
    begin, size = (np.cumsum(lines) - lines)[order], lines[order]
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    node = np.stack([np.zeros(len(logit)), logit], axis=1)
    ahead = np.zeros_like(node)
    for t, k in enumerate(running):
        at = begin[:k] + t
        here = node[at]
        if t:
            here = here + np.logaddexp(ahead[at - 1, 0, None] + stay[0], ahead[at - 1, 1, None] + stay[1])
        ahead[at] = here - np.logaddexp(here[:, 0], here[:, 1])[:, None]
    back = np.zeros_like(node)
    for t in range(longest - 1, 0, -1):
        at = begin[: running[t]] + t
        ahead_of = node[at] + back[at]
        value = np.logaddexp(stay[:, 0] + ahead_of[:, :1], stay[:, 1] + ahead_of[:, 1:])
        back[at - 1] = value - value.max(axis=1, keepdims=True)
        both = ahead[at - 1][:, :, None] + stay + ahead_of[:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        pair[at - 1] = both / both.sum(axis=(1, 2), keepdims=True)
    whole = ahead + back
    p = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500)))
    return p, pair


class Field(NamedTuple):
    """``weights`` of the features with neighbours, ``stay`` the transitions, ``curve`` of the score."""

    weights: np.ndarray
    stay: np.ndarray
    curve: np.ndarray

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good, length and document sizes of all lines."""
        x, length, lines = line_features(texts)
        return marginals(with_neighbours(x, lines) @ self.weights, self.stay, lines)[0], length, lines

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts):
            out[a:b] = 1 / (1 + np.exp(-_summary(*self.lines(texts[a:b])) @ self.curve))
        return out


def _summary(p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """One, and the length-weighted share of good text as a logit."""
    if not len(lines):
        return np.zeros((0, 2))
    first = np.cumsum(lines) - lines
    share = np.add.reduceat(p * length, first) / np.add.reduceat(length, first)
    return np.stack([np.ones(len(lines)), np.log((share + 0.01) / (1.01 - share))], axis=1)


def fit(x: np.ndarray, length: np.ndarray, lines: np.ndarray, good: np.ndarray, rounds: int = 3, steps: int = 60) -> Field:
    """Fit on documents given as their lines. ``good``: mark of each document."""
    owner = np.repeat(np.arange(len(lines)), lines)
    inputs = with_neighbours(x, lines).astype(np.float64)
    weight = 1.0 / np.maximum(lines, 1)[owner]  # every document counts alike
    target = good[owner].astype(float)
    weights, stay = np.zeros(inputs.shape[1]), np.zeros((2, 2))
    last = np.zeros(len(owner), bool)
    last[np.cumsum(lines) - 1] = True
    for turn in range(rounds):
        moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))]
        both = np.zeros((len(owner), 2, 2))
        following = np.append(target[1:], 0)
        for a in (0, 1):
            for b in (0, 1):
                both[:, a, b] = np.where(a, target, 1 - target) * np.where(b, following, 1 - following) * ~last
        for step in range(1, steps + 1):
            p, pair = marginals(inputs @ weights, stay, lines)
            down = inputs.T @ ((target - p) * weight) / len(lines) - 1e-4 * weights
            across = ((both - pair) * weight[:, None, None]).sum(axis=0) / len(lines) - 1e-3 * stay
            for value, gradient, m in ((weights, down, 0), (stay, across, 2)):
                moments[m] = 0.9 * moments[m] + 0.1 * gradient
                moments[m + 1] = 0.99 * moments[m + 1] + 0.01 * gradient**2
                value += 0.2 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[m + 1] / (1 - 0.99**step)) + 1e-8)
        if turn + 1 < rounds:
            p = marginals(inputs @ weights, stay, lines)[0]
            worst = np.minimum.reduceat(p, np.cumsum(lines) - lines)[owner]
            target = np.where(good[owner] == 1, 1.0, np.where(p <= worst + 1e-9, 0.0, p))
    p = marginals(inputs @ weights, stay, lines)[0]
    view = _summary(p, length, lines)
    curve = np.zeros(2)
    for _ in range(25):  # Newton
        s = 1 / (1 + np.exp(-view @ curve))
        h = (view * (s * (1 - s))[:, None]).T @ view + 1e-2 * np.eye(2)
        curve += np.linalg.solve(h, view.T @ (good - s) - 1e-2 * curve)
    return Field(weights, stay, curve)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` labelled documents of ``docs``, the first by a hash of their id.

    Of these, in the same order, as many whole documents as start within ``SAMPLE_LINES`` lines. Labels other than 0 and 1 and ids with
    contradicting labels are left out. Without any document every text scores 0.5.
    """
    marks = (
        labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_good"), F.max(label).alias("_most"))
        .where(F.col("_good") == F.col("_most")).orderBy(F.xxhash64("_key"), "_key").limit(sample).select("_key", "_good")
    )
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(marks), "_key").select("_key", "_text", "_good")

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts, good = (part.column(i).to_pylist() for i in range(3))
            for i, t, g in zip(ids, texts, good):
                x, length, _ = line_features([t or ""])
                row = {"key": [str(i)], "good": [int(g)], "lines": [len(length)], "x": [x.tobytes()], "length": [length.tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema)

    schema = pa.schema([("key", pa.string()), ("good", pa.int32()), ("lines", pa.int64()), ("x", pa.binary()), ("length", pa.binary())])
    found = written(chosen.mapInArrow(features, "key string, good int, lines long, x binary, length binary"), "labelled-lines")
    order = [F.xxhash64("key"), F.col("key"), F.xxhash64("x")]
    # At most ``sample`` rows of a hash and a number.
    sizes = found.select("key", F.xxhash64("x").alias("mark"), "lines").orderBy(F.xxhash64("key"), "key", "mark").limit(sample).collect()
    begins = np.cumsum([0, *(r["lines"] for r in sizes)])[:-1]
    rows = found.orderBy(*order).limit(int((begins < SAMPLE_LINES).sum())).collect() if sizes else []
    discard(found)
    if not rows:
        return Field(np.zeros(3 * len(FEATURES)), np.zeros((2, 2)), np.zeros(2))
    lengths = [np.frombuffer(bytes(r.length)) for r in rows]
    x = np.concatenate([np.frombuffer(bytes(r.x), np.float32).reshape(-1, len(FEATURES)) for r in rows])
    lines = np.array([len(v) for v in lengths], np.int64)
    return fit(x, np.concatenate(lengths), lines, np.array([r.good for r in rows], float))


def score(docs: DataFrame, field: Field, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold``) to every row. Null counts as empty, which is one empty line.
    Columns of these names are replaced, all others stay."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(field))

    @lean
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for part in parts:
            found = own.scores(texts_of(part.column(part.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, columns_of(docs) + ", score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
