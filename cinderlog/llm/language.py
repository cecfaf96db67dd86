"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes one blank, and all its n-grams of one to three characters fall into a fixed
number of buckets. Counts per language and bucket are added up over all documents that may be learned from; the logarithms of the
smoothed shares are the model, whose size is languages times buckets whatever the corpus.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns_of, discard, slices, texts_of, written

BUCKETS, ORDERS, SMOOTHING = 1 << 15, 3, 0.5
#: More languages than this are refused (the model goes to every executor).
LANGUAGES = 1000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def n_grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every order, the bucket of each n-gram and the text that it is in, in text order."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    letters = _letters()[np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), sizes)
    blank = letters == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word; the added line end makes it for the last
    letters, row, blank = letters[keep].astype(np.uint64), row[keep], blank[keep]
    key = np.zeros(len(letters), np.uint64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for order in range(1, ORDERS + 1):
        n = len(letters) - order + 1
        if n <= 0:
            return
        key = key[:n] * np.uint64(0x100000001B3) + letters[order - 1 :]
        bucket = (((key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        whole = row[:n] == row[order - 1 :]
        if order == 1:
            whole &= ~blank
        yield bucket[whole], row[:n][whole]


class Model(NamedTuple):
    """``logs``: one row of bucket logarithms for each language; ``priors``: logarithm of each language's share of documents."""

    languages: list[str]
    logs: np.ndarray
    priors: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Most likely language (the first by code point on a tie) and its probability; ``und``, 0 without letters."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a, b in slices(texts):
            total, seen = np.tile(self.priors, (b - a, 1)), np.zeros(b - a, bool)
            for bucket, row in n_grams(texts[a:b]):
                if not len(row):
                    continue
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                seen[row[first]] = True
                for k, logs in enumerate(self.logs):
                    total[row[first], k] += np.add.reduceat(logs[bucket], first, dtype=np.float64)
            if self.languages:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(seen):
                    names[a + i], scores[a + i] = self.languages[best[i]], share[i]
        return names, scores


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count over all given documents with a text and a language."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        sums: list[np.ndarray] = []
        documents: list[int] = []
        for part in parts:
            texts, langs = texts_of(part.column(0)), part.column(1).to_pylist()
            for name in langs:
                if numbers.setdefault(name, len(numbers)) == len(sums):
                    sums.append(np.zeros(BUCKETS, np.int64))
                    documents.append(0)
            which = np.array([numbers[x] for x in langs], np.int64)
            for k, n in zip(*np.unique(which, return_counts=True)):
                documents[k] += int(n)
            for a, b in slices(texts):
                own = which[a:b]
                for bucket, row in n_grams(texts[a:b]):
                    label = own[row]
                    for k in np.unique(own):
                        sums[k] += np.bincount(bucket[label == k], minlength=BUCKETS)
        for name, k in numbers.items():
            at = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(sums[k][at], documents[k]))],
                names=["lang", "bucket", "n"],
            )

    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sums = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = written(sums, "language-counts")
    several = sums.select("lang").distinct().limit(LANGUAGES + 1).count()
    if several > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = sums.toPandas()  # at most LANGUAGES times BUCKETS numbers
    discard(sums)
    names = sorted(set(rows["lang"]))
    counts, documents = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    at = rows["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(np.int64)
    bucket, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    documents[at[bucket < 0]] = n[bucket < 0]
    counts[at[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model(names, logs.astype(np.float32), np.log(documents / max(documents.sum(), 1)))


def held_out(key: str | Column = "doc_id", part: int = 2) -> Column:
    """True for documents that nothing may be learned from: crc32 of the id as text, modulo 4, is ``part``. A null id is not one."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == part, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; columns of these names are replaced, all others stay."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in parts:
            names, scores = own.predict(texts_of(part.column(part.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(predict, columns_of(docs) + ", lang_pred string, score double")
