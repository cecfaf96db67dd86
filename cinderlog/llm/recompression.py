"""Grammars by recompression, and how far two places of a sequence agree.

A sequence of names is shortened in rounds until little is left. Block compression makes one symbol of every stretch of equal symbols
(its name stands for symbol and length). Pair compression deals the symbols of a round to a left and a right side and makes one symbol
of every left one that a right one follows. Both look at symbols and not at places, so equal stretches are compressed alike but for
their ends. All rounds together are a run-length grammar of the sequence: every symbol knows its parent and its first and last child.

Two places agree as far as walking from both shows: up while both start symbols whose parents are equal, on by equal symbols (inside
blocks by all that both have left), down where symbols differ, until single names differ. That takes a few steps a round, whatever
the length, since equal symbols beside unequal ones are never on the same side. Queries are walked side by side.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

#: Symbols of a round below which no further one is made.
FEW = 8


class Grammar:
    """The run-length grammar of ``names`` (numbers from 0). Names at both ends must stand nowhere else in the sequence.

    It has about 100 bytes for every name, up to twice that for sequences full of blocks.
    """

    def __init__(self, names: np.ndarray):
        levels, level, at, fresh, turn = [], np.asarray(names, np.int64), 0, int(names.max(initial=-1)) + 1, 0
        child = last_child = np.full(len(level), -1, np.int64)
        while True:
            n = len(level)
            change = np.flatnonzero(level[1:] != level[:-1]) + 1
            begin, close = np.concatenate([[0], change]), np.concatenate([change, [n]])
            size = close - begin
            place = np.arange(n)
            if len(begin) < n:
                ahead, behind = np.repeat(close, size) - place, place - np.repeat(begin, size) + 1
                many = np.flatnonzero(size > 1)
                key = level[begin[many]] * (n + 1) + size[many]
                made = level[begin]
                kinds, number = np.unique(key, return_inverse=True)
                made[many], fresh = fresh + number, fresh + len(kinds)
            else:
                ahead = behind = np.ones(n, np.int64)
                begin, made, fresh = self._pairs(level, turn, fresh)
                turn += 1
                close = np.append(begin[1:], n)
                size = close - begin
            end = n <= FEW
            parent = np.full(n, -1, np.int64) if end else at + n + np.repeat(np.arange(len(begin)), size)
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            first[begin] = last[close - 1] = True
            levels.append((level, parent, first, last, ahead, behind, child, last_child))
            if end:
                break
            child, last_child = at + begin, at + close - 1
            level, at = made, at + n
        columns = [np.concatenate(c) for c in zip(*levels)]
        self.name, self.parent, first, last, ahead, behind, child, last_child = (
            c if c.dtype == bool else c.astype(np.int32 if at < 1 << 30 and fresh < 1 << 31 else np.int64) for c in columns
        )
        self.ways = {1: (first, ahead, child), -1: (last, behind, last_child)}

    @staticmethod
    def _pairs(level: np.ndarray, turn: int, fresh: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Starts and names of the symbols of the next round: those of a left and a right symbol become one."""
        right = mixed(level.astype(np.uint64) + np.uint64(0x9E3779B9 * (turn + 1))) & np.uint64(1) == 1
        there, back = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        paired = np.flatnonzero(there if there.sum() >= back.sum() else back)
        kinds, number = np.unique(level[paired] * fresh + level[paired + 1], return_inverse=True)
        made = level.copy()
        made[paired] = fresh + number
        keep = np.ones(len(level), bool)
        keep[paired + 1] = False
        return np.flatnonzero(keep), made[keep], fresh + len(kinds)

    def agree(self, x: np.ndarray, y: np.ndarray, way: int = 1) -> np.ndarray:
        """How many names from places ``x`` and ``y`` on (``way`` -1: up to them, backwards) are the same, one by one.

        No walk may pass an end of the sequence: its first and last name are like no other.
        """
        edge, steps, child = self.ways[way]
        name, parent = self.name, self.parent
        out = np.zeros(len(x), np.int64)
        row, since = np.arange(len(x)), np.asarray(x, np.int64)
        x, y = since.copy(), np.asarray(y, np.int64).copy()
        while len(row):
            above, beyond = parent[x], parent[y]
            up = edge[x] & edge[y] & (above >= 0) & (name[above] == name[beyond])
            same = name[x] == name[y]
            step = np.minimum(steps[x], steps[y]) * way
            below, under = child[x], child[y]
            stop = ~same & (below < 0)
            if stop.any():
                out[row[stop]] = np.abs(x[stop] - since[stop])
            x = np.where(up, above, np.where(same, x + step, below))
            y = np.where(up, beyond, np.where(same, y + step, under))
            go = ~stop
            if not go.all():
                row, since, x, y = row[go], since[go], x[go], y[go]
        return out
