"""A run-length grammar by recompression, and longest common extensions on it.

A string of symbols is shortened in rounds.  *Block compression* replaces every block ``aaa`` by
one symbol that stands for (a, 3); *pair compression* divides the symbols in two halves by a
hash and replaces every pair whose first symbol is in the one half and whose second is in the
other.  Both look at neighbours only, so equal strings are parsed alike but for their ends, and
a common extension is found by climbing while both sides stand at the start of a symbol and
descending again where they differ: a constant number of steps in each round.

All functions work on arrays of queries at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Odd multipliers of the hash that divides symbols in halves.
_MIX, _SEED = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


@dataclass(frozen=True)
class Level:
    """One round's string and how it becomes the next one's."""

    symbols: np.ndarray
    #: Index of the next round's symbol that each symbol is part of.
    parent: np.ndarray
    #: First symbol of each of the next round's symbols, and the length at the end.
    first: np.ndarray
    #: Whether the next round's symbols are blocks of one symbol (else pairs).
    blocks: bool


def _halves(symbols: np.ndarray, seed: int) -> np.ndarray:
    salt = np.uint64((seed + 1) * _SEED % (1 << 64))
    mixed = (symbols.astype(np.uint64) + salt) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(_SEED)) >> np.uint64(60)) & np.uint64(1) == 1


def _renamed(symbols: np.ndarray, starts: np.ndarray, other: np.ndarray, made: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """The next string: new names, the same for the same (symbol, other), where ``made``."""
    result = symbols[starts].copy()
    keys = result[made] * (int(other.max()) + 1) + other[made]
    codes, names = pd.factorize(keys)
    result[made] = fresh + codes
    return result, fresh + len(names)


def recompressed(symbols: np.ndarray) -> list[Level]:
    """The rounds from ``symbols`` (non-negative) down to one symbol."""
    current, levels, seed = symbols.astype(np.int64), [], 0
    fresh = int(current.max()) + 1 if len(current) else 0
    while len(current) > 1:
        head = np.ones(len(current), bool)
        head[1:] = current[1:] != current[:-1]
        blocks = not head.all()
        if not blocks:
            half = _halves(current, seed)
            seed += 1
            up, down = half[:-1] & ~half[1:], ~half[:-1] & half[1:]
            pair = up if np.count_nonzero(up) >= np.count_nonzero(down) else down
            if not pair.any():
                continue
            head[1:] = ~pair
        starts = np.flatnonzero(head)
        first = np.append(starts, len(current))
        size = np.diff(first)
        other = size if blocks else current[np.minimum(starts + 1, len(current) - 1)]
        levels.append(Level(current, np.cumsum(head) - 1, first, blocks))
        current, fresh = _renamed(current, starts, other, size > 1, fresh)
    return levels


def common_extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
    """Equal symbols from each ``a`` and ``b`` on (or back from them, themselves included).

    Each query has to end inside the string by a difference: the string starts and ends with
    symbols that occur once, and ``a`` is not ``b``.
    """
    at_a, at_b = a.astype(np.int64), b.astype(np.int64)
    stopped: list[np.ndarray] = []
    active = np.arange(len(at_a))

    def begins(level: Level, at: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (level.first[parent] if forward else level.first[parent + 1] - 1) == at

    def step(level: Level, which: np.ndarray) -> np.ndarray:
        """Moves the queries whose symbols are equal over them, in a block over all that both
        have left of it; says which moved."""
        left, right = at_a[which], at_b[which]
        same = level.symbols[left] == level.symbols[right]
        left, right, moved = left[same], right[same], which[same]
        move = np.ones(len(moved), np.int64)
        if level.blocks:
            rooms = []
            for at in (left, right):
                parent = level.parent[at]
                rooms.append(level.first[parent + 1] - at if forward else at - level.first[parent] + 1)
            move = np.minimum(*rooms)
        at_a[moved] = left + (move if forward else -move)
        at_b[moved] = right + (move if forward else -move)
        return same

    for level in levels:
        left, right = level.parent[at_a[active]], level.parent[at_b[active]]
        inside = ~(begins(level, at_a[active], left) & begins(level, at_b[active], right))
        which = active[inside]
        moved = which[step(level, which)]
        clear = begins(level, at_a[moved], level.parent[at_a[moved]]) & begins(level, at_b[moved], level.parent[at_b[moved]])
        climbs = np.zeros(len(at_a), bool)
        climbs[active[~inside]] = climbs[moved[clear]] = True
        rising = climbs[active]
        stopped.append(active[~rising])
        active = active[rising]
        at_a[active], at_b[active] = level.parent[at_a[active]], level.parent[at_b[active]]
        if not len(active):
            break
    falling = active  # none, since two symbols of the last string but one are never both its first
    for level, own in zip(reversed(levels[: len(stopped)]), reversed(stopped), strict=True):
        if len(falling):
            for at in (at_a, at_b):
                at[falling] = level.first[at[falling]] if forward else level.first[at[falling] + 1] - 1
            step(level, falling)
        falling = np.concatenate([falling, own])
    return at_a - a if forward else a - at_a
