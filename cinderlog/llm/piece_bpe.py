"""Encoding and decoding as sentencepiece does for a merge-type (BPE) model, by backtracking instead of by merging.

The encoding of a text is the only sequence of reachable pieces whose neighbours are all compatible: two pieces are compatible
when merging the text of both gives back these two. (The first merge that crossed a border between pieces would cross it as well
if only the two pieces beside it were there.) So the longest piece at a place is tried first, then the shorter ones that start it,
each checked against the piece before it only; a place from which nothing leads on is marked in a bitfield and never tried again,
since no other way leads to a place that the encoding passes. An Aho-Corasick automaton gives the longest piece at a place.

A text falls into stretches at characters that stand beside each other in no piece. Merges never cross such a place, so stretches
are encoded by themselves and common ones are remembered.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, types as T

from .common import SLICE, slices, texts_of
from .words import gather

#: The mark that stands for a blank inside pieces (a fixed value of the model format).
BLANK = "▁"
#: Stretches remembered in each of two generations, bytes of the longest remembered one, and pairs of pieces remembered.
REMEMBERED = 1 << 18
LONGEST = 64
PAIRS = 1 << 18
NEVER = math.inf


class PieceBpe:
    """A merge-type model with byte fallback: ``encode`` and ``decode`` give what the library gives without begin and end ids."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules, trainer = spec.normalizer_spec, spec.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only a merge-type model with byte fallback and leading blanks can be read")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only a model that leaves its texts as they are can be read")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        if any(library.is_unused(i) for i in range(size)) or any(p.type == 4 for p in spec.pieces):
            raise ValueError("models with unused or user-defined pieces are not read")
        self.size = size
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        hidden = {i for i in range(size) if library.is_control(i) or library.is_unknown(i)}
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if library.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in hidden and i not in self.byte_of}
        self.length = [len(p) for p in self.pieces]
        # Equal scores are equal ranks: the library then takes the leftmost pair.
        order = {s: r for r, s in enumerate(sorted({library.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = [order.get(library.get_score(i), NEVER) for i in range(size)]
        self.merged = {}
        for text, i in self.ids.items():
            for k in range(1, len(text)):
                left, right = self.ids.get(text[:k]), self.ids.get(text[k:])
                if left is not None and right is not None:
                    self.merged[left * size + right] = i
        self.matches = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.matches.add_word(text, i)
        self.matches.make_automaton()
        self.reach = max(self.length)
        self._pairs()
        self.shorter = [self._shorter(i) for i in range(size)]
        self.edges: dict[int, tuple | None] = {}
        self.known: dict[int, bool] = {}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        shown = [p.replace(BLANK, " ") for p in self.pieces]
        unknown = trainer.unk_surface
        self.shown = [unknown if library.is_unknown(i) else "" if i in hidden else shown[i] for i in range(size)]
        self.hidden = frozenset(i for i in hidden if not library.is_unknown(i))
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.shown)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, size)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        #: Ids that are more than a text of their own, wherever they stand: parts of characters, and control ids.
        self.odd = np.array([i in self.hidden or self.byte_of.get(i, 0) >= 0x80 for i in range(size)])
        self.blank_first = np.array([bool(self.prefix) and i not in self.byte_of and p.startswith(BLANK) for i, p in enumerate(self.pieces)])

    # -- tables of the model ---------------------------------------------------------------------

    def _pairs(self) -> None:
        """A class for every character of pieces of several characters, and which classes follow each other in any piece."""
        many = [p for p in self.ids if len(p) > 1]
        names = {c: n + 1 for n, c in enumerate(sorted(set("".join(many))))}
        self.kind = np.zeros(0x110000, np.int32)
        for c, n in names.items():
            self.kind[ord(c)] = n
        self.kinds = len(names) + 1
        self.kind[32] = names.get(BLANK, 0)
        self.beside = np.zeros(self.kinds * self.kinds, bool)
        for p in many:
            for a, b in zip(p, p[1:]):
                self.beside[names[a] * self.kinds + names[b]] = True

    def _shorter(self, i: int) -> int:
        """The longest piece that starts piece ``i`` and is not itself; -1 for none."""
        text = self.pieces[i]
        if i not in self.byte_of:
            for k in range(len(text) - 1, 0, -1):
                if text[:k] in self.ids:
                    return self.ids[text[:k]]
        return -1

    def merge(self, symbols: list[int]) -> Iterator[tuple[float, int, int]]:
        """Merge ``symbols`` in place as the library does: best score first, then leftmost. Gives rank, place and piece."""
        size, merged, rank = self.size, self.merged, self.rank
        while True:
            best, at = NEVER, -1
            for k in range(len(symbols) - 1):
                i = merged.get(symbols[k] * size + symbols[k + 1])
                if i is not None and rank[i] < best:
                    best, at = rank[i], k
            if at < 0:
                return
            symbols[at : at + 2] = [merged[symbols[at] * size + symbols[at + 1]]]
            yield best, at, symbols[at]

    def _edges(self, i: int) -> tuple | None:
        """How the first and the last symbol of piece ``i`` grow while it is merged: symbols with the rank that ends each.

        ``None`` for a piece that merging its own text does not give. The last value tells whether ranks only rise on the way.
        """
        if i not in self.edges:
            symbols = [self.ids[c] for c in self.pieces[i]]
            first, last, before, rising = [[symbols[0], NEVER]], [[symbols[-1], NEVER]], -1.0, True
            for rank, at, piece in self.merge(symbols):
                rising &= rank >= before
                before = rank
                if at == 0:
                    first[-1][1] = rank
                    first.append([piece, NEVER])
                if at == len(symbols) - 1:
                    last[-1][1] = rank
                    last.append([piece, NEVER])
            self.edges[i] = (first, last, rising) if symbols == [i] else None
        return self.edges[i]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` (reachable) may follow ``left`` (-1: none): merging both texts gives back these two pieces."""
        own = self._edges(right)
        if own is None or left < 0:
            return own is not None
        _, ends, rising = self._edges(left)
        if not (rising and own[2]):
            symbols = [self.ids[c] for c in self.pieces[left] + self.pieces[right]]
            for _ in self.merge(symbols):
                pass
            return symbols == [left, right]
        # Merge both again in order of rank, looking only at the two symbols that meet.
        starts, a, b = own[0], 0, 0
        while True:
            x, gone = ends[a]
            y, taken = starts[b]
            i = self.merged.get(x * self.size + y)
            # At equal ranks the pair further left is merged first.
            if i is not None and self.rank[i] < gone and self.rank[i] <= taken:
                return False
            if gone == taken == NEVER:
                return True
            if gone <= taken:
                a += 1
            else:
                b += 1

    # -- encoding --------------------------------------------------------------------------------

    def stretch(self, text: str) -> list[int]:
        """Pieces of a stretch (blanks as marks), all of whose characters are pieces."""
        whole = self.ids.get(text)
        if whole is not None and self._edges(whole) is not None:
            return [whole]
        n, size, reach = len(text), self.size, self.reach
        length, shorter, known, longest = self.length, self.shorter, self.known, self.matches.iter_long
        failed, out = bytearray((n >> 3) + 1), []
        at, last = 0, -1
        piece = next(longest(text[:reach]))[1]
        while True:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    key = last * size + piece
                    fits = known.get(key)
                    if fits is None:
                        if len(known) >= PAIRS:
                            known.clear()
                        fits = known[key] = self.fits(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, last = end, piece
                if at == n:
                    return out
                # The longest piece here: every character is a piece, so the leftmost match is here.
                piece = next(longest(text[at : at + reach]))[1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                taken = out.pop()
                at -= length[taken]
                last, piece = out[-1] if out else -1, shorter[taken]

    def _stretch_bytes(self, raw: bytes) -> bytes:
        """Ids of a stretch, as bytes. ``raw`` is its text in UTF-8, with blanks as they are."""
        found = self.old.get(raw)
        if found is None:
            text = raw.decode().replace(" ", BLANK)
            if len(text) == 1 and text not in self.ids:
                out = [self.byte_id[b] for b in raw]
            else:
                out = self.stretch(text)
            found = struct.pack(f"<{len(out)}i", *out)
        if len(raw) <= LONGEST:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[raw] = found
        return found

    def _borders(self, points: np.ndarray) -> np.ndarray:
        """For every code point but the first, whether no merge crosses the place before it."""
        kind = self.kind[points]
        return ~self.beside[kind[:-1] * self.kinds + kind[1:]]

    def _part(self, part: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that follow each other and end at ``ends``, and how many each has. Each different stretch is looked up once."""
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        mark = np.concatenate([[True], self._borders(points), [True]])
        mark[ends] = True
        place = np.flatnonzero(mark)
        data, at = part.encode(), place
        if len(data) > len(points):
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[place]
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        number, get = coded.indices.to_numpy(), self.new.get
        found = [get(t) or self._stretch_bytes(t) for t in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        values = gather(np.frombuffer(b"".join(found), "<i4"), (np.cumsum(size) - size)[number], size[number])
        held = np.concatenate([[0], np.cumsum(size[number])])
        return values, np.diff(held[np.searchsorted(place, ends)], prepend=0)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, and how many each has."""
        marked = [self.prefix + t if t else "" for t in texts]
        ids, counts = [], np.zeros(len(texts), np.int64)
        for a, b in slices(marked, 2 * SLICE):
            sizes = np.fromiter(map(len, marked[a:b]), np.int64, b - a)
            for part in self._parts(marked[a:b]):
                whole = len(part) == sizes.sum()
                values, held = self._part(part, np.cumsum(sizes) if whole else np.array([len(part)]))
                ids.append(values)
                counts[a:b] += held if whole else held * (sizes > 0)
        return (np.concatenate(ids) if ids else np.zeros(0, "<i4")), counts

    def _parts(self, texts: list[str]) -> Iterator[str]:
        """All texts joined; a text longer than a slice instead in parts that end where no merge crosses."""
        full = [t for t in texts if t]
        if len(full) != 1 or len(full[0]) <= 4 * SLICE:
            if full:
                yield "".join(full)
            return
        text, at = full[0], 0
        while at < len(text):
            to = min(at + 2 * SLICE, len(text))
            while to < len(text):
                since = max(at, to - SLICE)
                cuts = np.flatnonzero(self._borders(np.frombuffer(text[since : to + 1].encode("utf-32-le"), np.uint32)))
                if len(cuts):
                    to = since + int(cuts[-1]) + 1
                    break
                to = min(to + SLICE, len(text))
            yield text[at:to]
            at = to

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    # -- decoding --------------------------------------------------------------------------------

    def _bytes(self, values: list[int]) -> str:
        """Text of byte pieces in a row; every byte that is no part of a character becomes a replacement character."""
        raw, out, at = bytes(values), [], 0
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids."""
        if ids and min(ids) < 0:
            raise IndexError("negative id")
        shown = self.shown
        # A blank that the encoder put in front goes again; control ids before it show nothing.
        first = next((k for k, i in enumerate(ids) if i not in self.hidden), len(ids))
        out = "".join(map(shown.__getitem__, ids)) if not self.byte_of.keys() & set(ids) else self._mixed(ids)
        if self.prefix and first < len(ids) and ids[first] not in self.byte_of and self.pieces[ids[first]].startswith(BLANK):
            return out[1:]
        return out

    def _mixed(self, ids: list[int]) -> str:
        out, run, byte_of = [], [], self.byte_of
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(self._bytes(run))
                run = []
            out.append(self.shown[i])
        return "".join(out) + self._bytes(run)

    def decode_many(self, values: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of sequences of ids that follow each other."""
        out, ends = [], np.cumsum(counts)
        if len(values) and (values.min() < 0 or values.max() >= self.size):
            raise IndexError("an id outside the model")
        a = 0
        while a < len(counts):
            since = int(ends[a] - counts[a])
            b = max(a + 1, int(np.searchsorted(ends, since + SLICE, side="right")))
            ids, held = values[since : ends[b - 1]], counts[a:b]
            size, at = self.raw_size[ids], self.raw_at[ids]
            first = (np.cumsum(held) - held)[held > 0]
            lead = first[self.blank_first[ids[first]]]
            size[lead] -= 1
            at[lead] += 1
            length = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(held)])]
            texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(length), pa.py_buffer(gather(self.raw, at, size)))
            odd = np.flatnonzero(np.bincount(np.repeat(np.arange(b - a), held)[self.odd[ids]], minlength=b - a))
            if len(odd):
                mask = np.zeros(b - a, bool)
                mask[odd] = True
                begin = np.cumsum(held) - held
                by_hand = [self.decode(ids[begin[k] : begin[k] + held[k]].tolist()) for k in odd]
                # Their bytes may be no text as they are, so only the others are taken from the buffer.
                plain = texts.filter(pa.array(~mask)).to_pylist()
                rest, hand = iter(plain), iter(by_hand)
                texts = pa.array([next(hand) if m else next(rest) for m in mask.tolist()], pa.large_string())
            out.append(texts.cast(pa.string()))
            a = b
        return pa.concat_arrays(out) if out else pa.array([], pa.string())


@functools.lru_cache(maxsize=2)
def coder(model: bytes) -> PieceBpe:
    """One per Python worker: the stretches and pairs met by a task serve the next."""
    return PieceBpe(model)


def _mapped(df: DataFrame, model: bytes, source: str, new: dict[str, T.DataType], work) -> DataFrame:
    """``df`` with the columns ``new``, worked out from ``source`` by ``work(coder, column)``; rows stay in their partition."""
    df = df.drop(*new)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = coder(shared.value)
        for part in parts:
            made = work(machine, part.column(part.schema.get_field_index(source)))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *new])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in new.items())]))


def _encoded(machine: PieceBpe, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    values, counts = machine.encode_many(texts_of(column))
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return values, counts, pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def encode_texts(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int): the ids of the whole text in column ``text``, without begin and end ids.

    ``model`` is the content of the model's file, read once by the driver (its size is a few hundred kilobytes). A null text counts
    as empty and has no ids. Every row is worked out by itself, so repeated rows give repeated results, and an empty table an empty
    one. Other columns stay; one named ``ids`` is replaced. A very long text is read in parts, at no loss.
    """
    return _mapped(docs, model, text, {"ids": T.ArrayType(T.IntegerType())}, lambda m, c: [_encoded(m, c)[2]])


def decode_ids(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (string): the text of the ids in column ``ids``; null ids and no ids give the empty text.

    Bytes that form no character become replacement characters, control ids nothing, as in the library. An id outside the model, or
    a null among the ids, is an error. Other columns stay; one named ``decoded`` is replaced.
    """

    def work(machine: PieceBpe, column: pa.Array) -> list[pa.Array]:
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("null among the ids")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return [machine.decode_many(flat.to_numpy().astype(np.int64), sizes)]

    return _mapped(df, model, ids, {"decoded": T.StringType()}, work)


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Add ``ids`` as :func:`encode_texts` does and ``decoded``, what :func:`decode_ids` makes of them, in one pass over the rows."""

    def work(machine: PieceBpe, column: pa.Array) -> list[pa.Array]:
        values, counts, lists = _encoded(machine, column)
        return [lists, machine.decode_many(values, counts)]

    return _mapped(docs, model, text, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, work)
