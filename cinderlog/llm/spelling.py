"""Spelling variants: words one letter apart, and the common form that each rare spelling stands for.

Two words are near if one inserted, deleted or replaced code point turns one into the other. For every (position, letter) a group of
words holds the bitset of its words with that letter there. A word is compared with all of its group at once: going through its
letters, one bitset keeps the words that agree so far (no error), one those that agree but for a replaced letter, and one, read at the
next position, those that agree but for a letter more. The set without error feeds both others where a word first departs, so every
near pair is met with its error at one certain place: the first one where the two words differ.

Groups come from where that place may be. A region ``[a, b)`` of words of ``m`` letters gathers the words of ``m`` letters and those
of ``m + 1`` with the same letters before ``a`` and the same ``m - b`` letters at the end: all pairs whose first difference is inside
the region (at the end of the shorter word: in its last region) are in one group. Words start with two halves. Groups that are too
large are split into the halves of their region until they are small: in a region of one place only the letters of one or two
places differ, so a group has at most as many words as there are letters and pairs of letters. No word and no pair is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import SLICE, written

#: Different words that a task counts before it hands them on, and characters of text it reads in between at most.
COUNTED = 1 << 18
READ = 1 << 28
#: Words of a group, and letters in its region, above which the region is halved.
GROUP = 4096
LETTERS = 1 << 22
#: Parts that the words of a too large group are dealt to when they are marked.
SALT = 16
#: Rows that a task compares in one go.
ROWS = 1 << 16


# -- words ---------------------------------------------------------------------------------------


def _runs(text: str, pattern: re.Pattern) -> Iterator[list[bytes]]:
    """Runs of letters, A-Z as a-z, in Latin-1: all letters that count have one byte there, and all others none."""
    raw = text.encode("latin-1", "replace").lower()
    if len(raw) <= SLICE:
        yield pattern.findall(raw)
        return
    found = pattern.finditer(raw)
    while part := [m.group() for m in islice(found, SLICE >> 4)]:
        yield part


def count_runs(counts: Counter, doc_id: str, text: str, pattern: re.Pattern, least: int, every: int) -> None:
    """Add the words of one text to ``counts``."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    for runs in _runs(text, pattern):
        counts.update(runs)
        if every:
            hashes = [zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), seed) for r in runs]
            for r, h in zip(runs, hashes):
                if not h % every:
                    counts[r] -= 1
                    k = h % len(r)
                    if len(r) > least:
                        counts[r[:k] + r[k + 1 :]] += 1


def word_counts(docs: DataFrame, least: int = 7, every: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of Latin letters (ASCII and U+00C0 to U+00FF) of at least ``least`` letters, A-Z as a-z, and how often they occur.

    With ``every``, a run loses one letter where the crc32 ``h`` of ``<doc_id>:<run>`` is a multiple of it: the one at ``h`` modulo the
    length. Null texts have no words; a null id reads as an empty text. Long texts are read whole, in parts. Other columns are ignored.
    """
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
    narrow = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def batch(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if n]
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"]
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, read = Counter(), 0
        for part in parts:
            for name, content in zip(part.column(0).to_pylist(), part.column(1)):
                content = content.as_py() or ""
                count_runs(counts, name, content, pattern, least, every)
                read += len(content)
                if len(counts) > COUNTED or read > READ:
                    yield batch(counts)
                    counts, read = Counter(), 0
        yield batch(counts)

    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- near words ----------------------------------------------------------------------------------


def _regions(words: DataFrame) -> DataFrame:
    """The two halves of every word, once as the shorter word of a pair (or of two equally long ones), once as the longer one."""
    size = F.length("word")
    half = lambda m: F.array(
        F.struct(m.alias("m"), F.lit(0).alias("a"), F.floor(m / 2).cast("int").alias("b")),
        F.struct(m.alias("m"), F.floor(m / 2).cast("int").alias("a"), m.alias("b")),
    )
    return words.select("word", "n", F.inline(F.concat(half(size), half(size - 1)))).where("a < b")


def _key() -> Column:
    """What all words of a group share."""
    start, end = F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)")
    return F.concat(F.concat_ws(" ", "m", "a", "b"), F.lit(" "), start, end)


def _bitsets(letters: np.ndarray, slots: np.ndarray, alphabet: int, groups: int, width: int) -> np.ndarray:
    """Bitsets by (letter, group) of the words that have the letter: one machine word for every ``width`` up to 64 slots."""
    flat = np.zeros((alphabet, groups * width), bool)
    flat[letters, slots] = True
    packed = np.packbits(flat, axis=1, bitorder="little").reshape(alphabet, groups, width // 8)
    return packed.view(f"<u{min(8, width // 8)}")


def near_pairs(letters: np.ndarray, region: int, longer: np.ndarray, group: np.ndarray, width: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(i, j)``: word ``j`` of the same group is near word ``i``, which is none of the longer ones.

    ``letters``: dense numbers of the letters in the region, a row per word, the last one past the end of words that are not
    ``longer``. ``group`` numbers groups from 0 in row order, none with more than ``width`` words (a power of two, 8 at least).
    ``last`` tells for every group whether nothing follows the region.
    """
    groups, alphabet = len(last), int(letters.max()) + 1
    first = np.searchsorted(group, np.arange(groups))
    slots = group * width + np.arange(len(group)) - first[group]
    ask = np.flatnonzero(~longer)
    own = group[ask]
    short = _bitsets(np.zeros(len(ask), np.int64), slots[ask], 1, groups, width)[0][own]
    long = _bitsets(np.zeros(int(longer.sum()), np.int64), slots[longer], 1, groups, width)[0][own]
    same = short | long  # no error so far
    replaced, more = np.zeros_like(same), np.zeros_like(same)
    here = _bitsets(letters[:, 0], slots, alphabet, groups, width)
    for i in range(region):
        shifted = _bitsets(letters[:, i + 1], slots, alphabet, groups, width)
        letter = letters[ask, i]
        agree, agree_shifted = here[letter, own], shifted[letter, own]
        departed = same & ~agree
        replaced = (replaced & agree) | departed
        more = (more | departed) & agree_shifted
        same &= agree
        here = shifted
    found = (replaced & short) | (more & long)
    found |= np.where(last[own, None], same & long, 0).astype(found.dtype)
    some = np.flatnonzero(found.any(axis=1))
    bits = np.unpackbits(np.ascontiguousarray(found[some]).view(np.uint8), axis=1, bitorder="little")
    row, slot = np.nonzero(bits)
    return ask[some[row]], first[own[some[row]]] + slot


def _compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of the rows, whose groups are whole and follow each other."""
    key = rows["key"].combine_chunks()
    if not len(key):
        return
    fresh = np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)])
    group = np.cumsum(fresh) - 1
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(group)))
    m, a, b = (rows[c].to_numpy().astype(np.int64) for c in "mab")
    words = rows["word"].combine_chunks()
    longer = pc.utf8_length(words).to_numpy(zero_copy_only=False) > m
    asked = np.add.reduceat(~longer, start)
    width = np.maximum(8, 1 << np.ceil(np.log2(size)).astype(np.int64))
    region, last = (b - a)[start], (b == m)[start]
    use = (size > 1) & (asked > 0)
    texts = words.to_pylist()
    near, other = [], []
    for r, w in sorted(set(zip(region[use].tolist(), width[use].tolist()))):
        chosen = np.flatnonzero(use & (region == r) & (width == w))
        # Groups side by side as long as the bitsets of a position and the answers stay within a few megabytes.
        step = max(1, min((1 << 25) // (w * w), (1 << 16) // w))
        for k in range(0, len(chosen), step):
            part = chosen[k : k + step]
            take = np.concatenate([np.arange(start[g], start[g] + size[g]) for g in part])
            cut = [texts[t][a[t] : a[t] + r + int(longer[t])] for t in take]
            codes = np.array(cut, f"<U{r + 1}").view(np.uint32).reshape(len(cut), r + 1)
            codes[~longer[take], r] = 0xFFFFFFFF
            letters = np.unique(codes, return_inverse=True)[1].reshape(codes.shape)
            i, j = near_pairs(letters, r, longer[take], np.repeat(np.arange(len(part)), size[part]), w, last[part])
            i, j = take[i], take[j]
            back = longer[j]  # pairs of equally long words are met from both sides
            near += [i, j[back]]
            other += [j, i[back]]
    if near:
        near, other = pa.array(np.concatenate(near)), pa.array(np.concatenate(other))
        table = pa.table({"word": words.take(near), "near": words.take(other), "n": rows["n"].combine_chunks().take(other)})
        yield from table.to_batches(max_chunksize=ROWS)


def _compared(keyed: DataFrame) -> DataFrame:
    """Near words of all groups. A task reads its groups in order and holds a bounded number of rows beside one group."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            rows += part.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            other = pc.not_equal(table["key"], table["key"][rows - 1]).to_numpy()
            whole = int(other.sum())  # rows are in order, so the open group is at the end
            yield from _compare(table.slice(0, whole))
            held, rows = table.slice(whole).to_batches(), rows - whole
        if held:
            yield from _compare(pa.Table.from_batches(held).combine_chunks())

    ordered = keyed.select("key", "m", "a", "b", "word", "n").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "word string, near string, n long")


def near_words(words: DataFrame, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """``word, near, n`` for all pairs of near words, in both directions; ``n`` is that of ``near``.

    ``words`` has distinct, non-null words of one letter at least in ``word`` and a number ``n``.
    """
    pending, found = _regions(words), []
    while True:
        keyed = pending.withColumn("key", _key())
        sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max(F.expr("b - a")).alias("region"))
        busy = written(sizes.where((F.col("region") > 1) & ((F.col("size") > group) | (F.col("size") * F.col("region") > letters))).select("key"), "busy-groups")
        if busy.isEmpty():
            found.append(_compared(keyed))
            break
        # The words of a large group are dealt to several keys, so that marking them is no work for one task.
        dealt = busy.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"), F.lit(True).alias("busy"))
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALT)).cast("int"))
        marked = written(salted.join(dealt, ["key", "salt"], "left"), "marked-groups")
        found.append(_compared(marked.where("busy IS NULL")))
        middle = F.expr("(a + b) div 2").cast("int")
        halves = F.array(F.struct("m", "a", middle.alias("b")), F.struct("m", middle.alias("a"), "b"))
        pending = marked.where("busy").select("word", "n", F.inline(halves))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


# -- forms ---------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``word, form``: the end of the chain of forms, found by doubling its steps.

    A form occurs many times as often as its word, so chains are short: the number of rounds is the logarithm of a logarithm.
    """
    chain = forms.withColumnRenamed("form", "root")
    while True:
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(chain.join(onward, "root", "left"), "roots")
        chain = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if stepped.where("next IS NOT NULL").isEmpty():
            return chain


def variants(words: DataFrame, times: int = 10, group: int = GROUP, letters: int = LETTERS) -> DataFrame:
    """For every word its common form: ``word, form, root, n, n_near, form_n``.

    ``words`` has ``word`` and ``n`` (how often it occurs); repeated words are added up, null and empty ones left out. ``n_near``
    counts the near words. ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if it occurs at least
    ``times`` times as often, else null, as is its ``form_n``. ``root`` follows the forms to the last; the word itself if it has none.
    An empty table gives an empty one.
    """
    if times < 2:
        raise ValueError("a form has to occur more often than its word")
    distinct = words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    known = written(distinct, "words")
    best = near_words(known, group, letters).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    )
    is_form = -F.col("best.less") >= times * F.col("n")
    formed = written(
        known.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
