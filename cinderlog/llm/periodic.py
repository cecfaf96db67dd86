"""Runs of repeated words in whole texts, and the texts without the repetitions.

A run is a stretch of words with smallest period ``q`` that repeats it often enough and that neither neighbour extends. Every run of
period ``p`` with at least four periods holds three words ``p`` apart that start on a grid of step ``2 p``; grids of all periods have
about ``n log n / 2`` places for ``n`` words. Where the three are the same, the grammar of :mod:`recompression` tells how far the
words ``p`` apart agree in both directions, which is the run itself. A stretch also met with a multiple of its period keeps the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import slices, texts_of
from .recompression import Grammar
from .words import read_words

#: Places of grids looked at in one go.
PLACES = 1 << 21
#: A run repeats its period at least so often, and has at least so many words.
TIMES, LEAST = 4, 6
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_RUNS = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))


def grid(sizes: np.ndarray, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, places in them and periods: for texts of ``sizes`` words, all places of all grids, in bounded parts."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[text] - 2 * period - 1) // (2 * period) + 1
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        # A single grid of a text has fewer places than the text has words.
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + places, side="right")))
        c = count[at:to]
        number = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(period[at:to], c)
        yield np.repeat(text[at:to], c), number * 2 * p, p
        at = to


def runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts that follow each other in ``words`` (numbers from 0), with ``sizes`` words each.

    Gives text, start, length and period, in order of text, start and period.
    """
    heads = np.cumsum(sizes) - sizes
    met: list[list[np.ndarray]] = [[], [], []]
    for text, place, p in grid(sizes):
        at = heads[text] + place
        same = np.flatnonzero(words[at] == words[at + p])
        same = same[words[at[same]] == words[at[same] + 2 * p[same]]]
        for found, values in zip(met, (text[same], place[same], p[same])):
            found.append(values)
    if not sum(map(len, met[0])):
        return (np.zeros(0, np.int64),) * 4
    text, place, p = map(np.concatenate, met)
    # The grammar is that of the texts with such places, with a name of its own before each and behind the last.
    used, own = np.unique(text, return_inverse=True)
    size = sizes[used]
    inside = np.concatenate([np.arange(h, h + s) for h, s in zip(heads[used], size)])
    border = np.cumsum(size + 1) - size - 1
    names = np.empty(int(size.sum()) + len(used) + 1, np.int64)
    marks = np.append(border, len(names) - 1)
    plain = np.ones(len(names), bool)
    plain[marks] = False
    names[plain] = words[inside]
    names[marks] = int(words.max()) + 1 + np.arange(len(marks))
    grammar = Grammar(names)
    x = border[own] + 1 + place
    ahead, behind = grammar.agree(x, x + p), grammar.agree(x - 1, x + p - 1, -1)
    start, length = place - behind, behind + ahead + p
    enough = length >= np.maximum(LEAST, TIMES * p)
    text, start, length, p = text[enough], start[enough], length[enough], p[enough]
    order = np.lexsort((p, length, start, text))
    text, start, length, p = text[order], start[order], length[order], p[order]
    # The same stretch with several periods: they are multiples of the smallest, as four of them fit into it.
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, p = text[fresh], start[fresh], length[fresh], p[fresh]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


def _slice(texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    words = read_words(texts)
    data, length, number, sizes = words.spaced, words.length, words.number, words.sizes
    text, start, extent, period = runs(number, sizes)
    change = np.zeros(len(number) + 1, np.int64)
    head = np.cumsum(sizes) - sizes
    np.add.at(change, head[text] + start + period, 1)
    np.add.at(change, head[text] + start + extent, -1)
    kept = np.cumsum(change[:-1]) == 0
    # The first period of a run is kept, so a text with words keeps some; the blank behind its last one goes.
    owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
    ends = np.cumsum(length + 1)
    keep = np.repeat(kept, length + 1)
    final = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else owner
    keep[ends[np.flatnonzero(kept)[final]] - 1] = False
    weight = np.bincount(owner, weights=(length + 1)[kept], minlength=len(sizes)).astype(np.int64)
    weight[owner[final]] -= 1
    offsets = np.concatenate([[0], np.cumsum(weight)])
    collapsed = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[keep]))
    of_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(start), pa.array(extent), pa.array(period)], fields=list(_RUNS.value_type))
    return pa.array(sizes), pa.ListArray.from_arrays(pa.array(of_text), found, type=_RUNS), collapsed.cast(pa.string())


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words`` (long), ``runs`` (array of ``start, length, period``, by start, then period) and ``collapsed`` (string).

    ``runs`` are the stretches of words (runs of other than ASCII white space, numbered from 0) whose smallest period fits into them
    four times at least, of six words at least, and that no neighbouring word extends. ``collapsed`` has the words that no run holds
    behind its first period, joined by one blank. A null or empty text has no words, no runs and collapses to the empty text. Every row
    is worked out by itself: repeated rows give repeated results, an empty table an empty one. Other columns stay; those named like the
    new ones are replaced. A text is read whole; one row takes about 150 bytes of memory for each of its words.
    """
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    docs = docs.drop(*(f.name for f in new))
    schema = T.StructType([*docs.schema.fields, *new])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = texts_of(part.column(part.schema.get_field_index(text)))
            for a, b in slices(texts):
                made = _slice(texts[a:b])
                yield pa.RecordBatch.from_arrays([*part.slice(a, b - a).columns, *made], names=schema.names)

    return docs.mapInArrow(work, schema)


def tail_repeated(doc_id: Column, text: Column) -> Column:
    """The text, of one document in ten with its words from some place on replaced by repetitions of the first few of them.

    With ``h`` the crc32 of the id as text and ``g = h div 10``: if ``h`` is a multiple of 10 and there are ``n > 0`` words, every word
    from ``a = g % n`` on is one of the ``p = 1 + (n - a) div (3 + g % 8)`` words from there, in turn.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(state: Column) -> Column:
        w, g = state["words"], state["g"]
        n = F.size(w)
        a = F.pmod(g, n.cast("long"))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int"))))

    # One array element as a place for values that are used several times.
    state = F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g")))
    made = F.get(F.transform(state, lambda s: F.array_join(repeated(s), " ")), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), made).otherwise(text)


def most_repeated(found: Column) -> Column:
    """The run with the greatest ratio of length to period, null if there is none; at equal ratios the first one."""

    def better(best: Column, one: Column) -> Column:
        more = one["length"] * best["period"] > best["length"] * one["period"]
        return F.when(best.isNull() | more, one).otherwise(best)

    return F.aggregate(found, F.lit(None).cast(RUN), better)
