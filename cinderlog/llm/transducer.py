"""Byte-pair encoding as a deterministic transducer that only counts.

A byte-level BPE breaks every pre-token into tokens, and the encoding of a pre-token's prefix is known from shorter prefixes:
its last token ``t`` is the one suffix that is a token and may follow the last token before it. So a run over the bytes needs
to remember, for each place from which an unfinished token may still start, the last token there and the count there.
That memory is the state. Reading a byte moves to another state and changes the count by a fixed number, which is what the
transition is annotated with. States are found on demand and kept in one table; a full table is thrown away and filled anew,
so memory is bounded and every text gets its exact count.
"""

from __future__ import annotations

import json

import numpy as np

#: Room for transitions, of which half is used; twelve bytes each and about a hundred more for the state's own memory.
TRANSITIONS = 1 << 20
#: A transition is the next state in the low bits and the change of the count, moved up by _ZERO, above them.
_BITS, _ZERO = 22, 256


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            letters[chr(spare)] = b
            spare += 1
    return letters


class BpeTransducer:
    """Counts the tokens of pre-tokens. ``vocabulary`` is the JSON text of a byte-level BPE without word-end marks."""

    def __init__(self, vocabulary: str, transitions: int = TRANSITIONS):
        model, letters = json.loads(vocabulary)["model"], byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        # Only tokens that the merges rebuild from their own bytes can appear.
        self.longest = max(map(len, self.tokens))
        self.starts = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.room = 1 << max(4, (transitions - 1).bit_length())
        self.reset()

    def reset(self) -> None:
        self.cells, self.moves, self.used = np.full(self.room, -1, np.int64), np.zeros(self.room, np.int32), 0
        start = (b"", ((b"", 0),))
        self.keys, self.ids = [start], {start: 0}

    def _slots(self, cell: np.ndarray) -> np.ndarray:
        """Where each (state, byte) is kept, or the free slot for it: scattered by a multiplication, then the next free one."""
        mask = self.room - 1
        slot = ((cell * 0x9E3779B1) >> 12) & mask
        held = self.cells[slot]
        wrong = np.flatnonzero((held != cell) & (held >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            held = self.cells[slot[wrong]]
            wrong = wrong[(held != cell[wrong]) & (held >= 0)]
        return slot

    def encode(self, text: bytes) -> list[bytes]:
        """Merge by rank, the plain way: for short byte strings."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: bytes, token: bytes) -> bool:
        key = (before, token)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[key] = self.encode(before + token) == ([before, token] if before else [token])
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the count. A state: the unfinished bytes, and before each of them and after the last one
        the last token and the count, counted from the last place."""
        open_bytes, places = self.keys[state]
        grown = open_bytes + bytes([byte])
        for at in range(max(0, len(grown) - self.longest), len(grown)):
            token = grown[at:]
            last, count = places[at]
            if token in self.tokens and self.may_follow(last, token):
                break
        else:  # cannot be: single bytes are tokens and something always fits
            raise AssertionError("no token fits")
        delta = count + 1
        places = (*places, (token, delta))
        keep = next((i for i in range(max(0, len(grown) - self.longest + 1), len(grown)) if grown[i:] in self.starts), len(grown))
        key = (grown[keep:], tuple((t, c - delta) for t, c in places[keep:]))
        found = self._numbered(key)
        cell = state << 8 | byte
        slot = self._slots(np.array([cell], np.int64))[0]
        self.used += int(self.cells[slot] < 0)
        self.cells[slot], self.moves[slot] = cell, found | (delta + _ZERO) << _BITS
        return found, delta

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``data[start : start + length]``; all of them read one byte at a time, side by side."""
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(size) else []
        for at, lanes in enumerate(running):
            symbol = data[begin[:lanes] + at].astype(np.int64)
            cell = (state[:lanes] << 8) | symbol
            slot = self._slots(cell)
            missing = np.unique(cell[self.cells[slot] < 0])
            if len(missing):
                if 2 * (self.used + len(missing)) > self.room:
                    cell = self._renewed(state[:lanes], symbol)
                    missing = np.unique(cell)
                for x in missing.tolist():
                    self.step(x >> 8, x & 255)
                slot = self._slots(cell)
            move = self.moves[slot].astype(np.int64)
            state[:lanes] = move & ((1 << _BITS) - 1)
            total[:lanes] += (move >> _BITS) - _ZERO
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out

    def _renewed(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The table is full: start an empty one with the states in use, renumbered in place. Gives the cells to read."""
        used, place = np.unique(state, return_inverse=True)
        keys = [self.keys[i] for i in used.tolist()]
        self.reset()
        state[:] = np.array([self._numbered(k) for k in keys], np.int64)[place]
        cell = (state << 8) | symbol
        while 2 * len(np.unique(cell)) > self.room:
            self.room *= 2
            self.cells, self.moves = np.full(self.room, -1, np.int64), np.zeros(self.room, np.int32)
        return cell

    def _numbered(self, key) -> int:
        found = self.ids.setdefault(key, len(self.keys))
        if found == len(self.keys):
            self.keys.append(key)
        return found
