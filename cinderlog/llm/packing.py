"""Pack tokenised documents into as few sequences as possible: best-fit decreasing with certificates.

Pieces are dealt to partitions of bounded size and packed best-fit decreasing. Dual feasible functions give a lower bound of each
partition's number of sequences; where the bound is met, the partition is certified and stays. The others release the pieces of
their unfilled sequences, which are dealt anew with those of other partitions and packed again, as long as that saves sequences.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE, give_back, lean, slices, texts_of, written
from .words import gather, read_words

LENGTH, END = 2048, 0
#: Pieces of a partition, and rounds of exchange.
PART, ROUNDS = 4096, 4
#: Runs that a worker remembers in each of two generations, and bytes of the longest remembered one.
_RUNS, _LONGEST = 1 << 17, 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of plain words, the second byte of a Latin letter apart; and classes: 0 letters, 1 digits, 2 what is between them."""
    plain, kind = np.zeros(256, bool), np.full(256, 2, np.uint8)
    # ASCII without the apostrophe, which starts endings, and the bracket, which starts added tokens.
    plain[0x21:0x7F] = True
    plain[[ord("'"), ord("<")]] = False
    kind[ord("a") : ord("z") + 1] = kind[0x80:] = 0
    kind[ord("0") : ord("9") + 1] = 1
    return plain, kind


_PLAIN, _KIND = _byte_classes()


class Encoder:
    """Token ids of whole texts. The tokenizer never merges across white space, so a text's ids are those of its words in turn,
    and every different word of a slice is looked up once. A word of ASCII and Latin letters is put together from its runs of letters, its digits
    and what is between them, which the tokenizer keeps apart as well; new runs go to the library many at a time."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        kept = json.loads(spec)
        ending = kept["model"].get("end_of_word_suffix")
        last = [False] * self.library.get_vocab_size()
        for token, i in kept["model"]["vocab"].items():
            last[i] = bool(ending) and token.endswith(ending)
        self.last = np.array(last)
        self.marked = bool(ending)
        self.new_runs, self.old_runs = {}, {}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and how many each has."""
        words = read_words(texts)
        flat, size = self._known(words.known)
        own = size[words.number]
        values = gather(flat, (np.cumsum(size) - size)[words.number], own)
        ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(words.sizes)]
        return values, np.diff(ends, prepend=0)

    def _known(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words after each other, and how many each has."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begin = offsets[:-1] - offsets[0]
        # Latin letters are 0xc3 and a second byte, but for two signs; this byte's lower case is 32 above, as that of ASCII letters.
        second = np.concatenate([[False], data[:-1] == 0xC3])
        latin = second & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        fits = _PLAIN[data] | latin | (data == 0xC3)
        plain = np.logical_and.reduceat(fits, begin) & self.marked
        large = ((data >= 65) & (data <= 90)) | (latin & (data < 0x9F))
        lower = data + (large.view(np.uint8) << 5)
        inside = np.repeat(plain, np.diff(offsets))
        # A run starts with its word, where the class changes, and at every digit.
        kind = _KIND[lower]
        edge = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 1)])
        edge[begin] = True
        held, first = lower[inside], np.flatnonzero(edge[inside])
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(held))), pa.py_buffer(held)]
        ).dictionary_encode()
        found = self._runs(runs.dictionary.to_pylist())
        number = runs.indices.to_numpy().astype(np.int64)
        length = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        parts = gather(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(length) - length)[number], length[number])
        # Ids of a plain word: those of its runs.
        ends = np.concatenate([[0], np.cumsum(length[number])])[np.cumsum(np.add.reduceat(edge, begin, dtype=np.int64) * plain)]
        size = np.diff(ends, prepend=0)
        others = np.flatnonzero(~plain)
        if not len(others):
            return parts, size
        rest = [np.array(ids, "<u4") for ids in self._encoded([w.decode() for w in words.take(pa.array(others)).to_pylist()])]
        size[others] = [len(r) for r in rest]
        flat = np.empty(size.sum(), "<u4")
        own = np.repeat(plain, size)
        flat[own], flat[~own] = parts, np.concatenate(rest)
        return flat, size

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of different runs that are one word each to the tokenizer, as bytes."""
        new, old = self.new_runs.get, self.old_runs.get
        out = list(map(new, runs))
        absent = [i for i, f in enumerate(out) if f is None]
        for i in absent:
            out[i] = old(runs[i])
        missing = [i for i in absent if out[i] is None]
        for a in range(0, len(missing), 512):
            part = missing[a : a + 512]
            ids = np.array(self._encoded([b" ".join([runs[i] for i in part]).decode()])[0], "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end every word with a mark of its own")
            held, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            for i, x, y in zip(part, at, at[1:]):
                out[i] = held[x:y]
        if len(self.new_runs) + len(absent) > _RUNS:
            self.old_runs, self.new_runs = self.new_runs, {}
        self.new_runs.update([(runs[i], out[i]) for i in absent if len(runs[i]) <= _LONGEST])
        return out

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        out = []
        for a in range(0, len(texts), 4096):
            out += [e.ids for e in self.library.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
        return out


@functools.lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    """One per Python worker."""
    return Encoder(spec)


def pieces(docs: DataFrame, spec: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut every document's ids, followed by ``end``, into pieces of at most ``length``. Null counts as empty: one piece, ``end``."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    tail = np.array([end], "<u4").tobytes()

    @lean
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the worker kept from an earlier query
        machine = encoder(shared.value)
        for part in parts:
            rows, docs_of, texts = [], part.column(0).to_pylist(), texts_of(part.column(1))
            for a, b in slices(texts, 2 * SLICE):
                values, counts = machine.ids(texts[a:b])
                ends = np.cumsum(counts).tolist()
                for doc, first, last in zip(docs_of[a:b], [0, *ends], ends):
                    ids = values[first:last].tobytes() + tail
                    for n, at in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[at : at + 4 * length]
                        rows.append((doc, n, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    kinds, names = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], [c.split()[0] for c in PIECE.split(", ")]
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(cut, PIECE)


def lower_bound(sizes: np.ndarray, room: int) -> int:
    """Least possible number of bins, by two families of dual feasible functions over the histogram of sizes."""
    count = np.bincount(sizes, minlength=room + 1).astype(np.int64)
    x = np.arange(room + 1)
    held, number = np.cumsum(count * x), np.cumsum(count)
    # Sizes above room - k count as whole bins, those below k as nothing.
    k = np.arange(1, room // 2 + 1)
    large = number[-1] - number[room - k]
    best = int(np.max(-(-(large * room + held[room - k] - held[k - 1]) // room))) if len(k) else 0
    for k in range(1, 33):  # sizes rounded to multiples of room / k
        exact = (k + 1) * x % room == 0
        # Times k * room, to stay with whole numbers.
        value = np.where(exact, x * k, (k + 1) * x // room * room)
        best = max(best, int(-(-int((value * count).sum()) // (k * room))))
    return max(best, int(-(-int(held[-1]) // room)))


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, largest first into the fullest bin with room; and the number of bins."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    some, used = 0, 0  # bit r: a bin with r free places
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            at, left = used, room
            used += 1
        bins[i], offsets[i] = at, room - left
        left -= size
        if left:
            free[left].append(at)
            some |= 1 << left
    return bins, offsets, used


def _packed(rows: DataFrame, turn: int, parts: int, room: int) -> DataFrame:
    """Deal rows to partitions by a hash of the round, and pack each. ``gap``: sequences above the partition's bound."""
    columns = [c for c in rows.columns if c not in ("turn", "part", "bin", "offset", "filled", "gap")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        sizes = frame["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit(sizes, room)
        filled = np.bincount(bins, weights=sizes, minlength=used).astype(np.int64)[bins]
        return frame[columns].assign(turn=turn, part=frame["part"], bin=bins, offset=offsets, filled=filled, gap=used - lower_bound(sizes, room))

    schema = f"{', '.join(f'`{c}` {rows.schema[c].dataType.simpleString()}' for c in columns)}, turn int, part long, bin long, offset long, filled long, gap long"
    dealt = rows.select(*columns).withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(parts)).cast("long"))
    return dealt.groupBy("part").applyInPandas(run, schema)


def _sequences(rows: DataFrame) -> int:
    """Number of sequences: each has one piece at its start."""
    return rows.where(F.col("offset") == 0).count()


def pack(cut: DataFrame, room: int = LENGTH, part: int = PART, rounds: int = ROUNDS) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``. ``cut``: rows of :func:`pieces`, whatever further columns they have."""
    cut = written(cut.drop("sequence_id", "offset").withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == room)
    rest = cut.where(F.col("length") < room)
    parts = lambda n: max(1, -(-n // part))
    state = written(_packed(rest, 0, parts(rest.count()), room), "packed-0")
    done = []
    for turn in range(1, rounds + 1):
        # Full sequences stay, and so do certified partitions unless their last sequence can help others.
        open_now = (F.col("gap") > 0) & (F.col("filled") < room)
        loose = state.where(open_now)
        before = _sequences(loose)
        if before < 2:
            break
        again = written(_packed(loose, turn, parts(loose.count()), room), f"packed-{turn}")
        if _sequences(again) >= before:
            break
        done.append(state.where(~open_now))
        state = again
    for rows in done:
        state = state.unionByName(rows)
    # A round, a partition and a sequence within it; sequences of one piece of full length count down from -1.
    number = (F.col("turn").cast("long") * (1 << 58)) + F.col("part") * (1 << 20) + F.col("bin")
    columns = [c for c in cut.columns if c != "row"]
    packed = state.select(*columns, number.alias("sequence_id"), "offset")
    return packed.unionByName(whole.select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
