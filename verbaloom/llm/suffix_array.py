"""Sorting suffixes of a block of bytes with a difference cover.

The cover {0, 1, 3} modulo 7 has the property that any two positions reach covered positions
within 6 steps, both at once.  So once the suffixes at covered positions are ranked, two
others compare by their next bytes and one rank, however long their common part is.
"""

from __future__ import annotations

import numpy as np

PERIOD, COVER = 7, (0, 1, 3)
#: From residues a and b, the fewest steps after which both are in the cover.
STEPS = [[next(d for d in range(PERIOD) if {(a + d) % PERIOD, (b + d) % PERIOD} <= set(COVER)) for b in range(PERIOD)]
         for a in range(PERIOD)]


def next_bytes(x: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes from each position as a number that orders like them; zeros follow the end."""
    padded = np.concatenate([x, np.zeros(room + 8, np.uint8)])
    size = len(x) + room
    key = np.zeros(size, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : size + k]
    return key


def cover_ranks(key: np.ndarray, size: int, depth: int) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of the suffixes at covered positions by ``depth`` bytes at least, in an
    array over all positions, 0 elsewhere; and the largest rank."""
    at = np.arange(size)
    at = at[np.isin(at % PERIOD, COVER)]
    ranks = np.zeros(size + 2 * depth + 8, np.int64)
    _, inverse = np.unique(key[at], return_inverse=True)
    ranks[at] = inverse + 1
    most, step = (int(inverse.max()) + 1 if len(at) else 0), PERIOD
    while step < depth and most < len(at):
        _, inverse = np.unique(ranks[at] * (most + 1) + ranks[at + step], return_inverse=True)
        ranks[at] = inverse + 1
        most, step = int(inverse.max()) + 1, 2 * step
    return ranks, most


def sorted_suffixes(key: np.ndarray, size: int, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes; those with ``depth`` equal bytes are neighbours.

    One bucket of suffixes, those with the same eight bytes, is ordered by counting for each
    suffix how many others of its bucket are less, residue by residue, from the cover's ranks.
    """
    order = starts[np.argsort(key[starts], kind="stable")]
    first = key[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    if not tied.any():
        return order
    ranks, most = cover_ranks(key, size, depth)
    at, of = order[tied], group[tied]
    residue = at % PERIOD
    groups = int(group[-1]) + 1
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    less = np.zeros(len(at), np.int64)
    for b in range(PERIOD):
        if not len(members[b]):
            continue
        before = np.concatenate([[0], np.cumsum(np.bincount(of[members[b]], minlength=groups))])
        known: dict[int, np.ndarray] = {}
        for a in range(PERIOD):
            if not len(members[a]):
                continue
            step = STEPS[a][b]
            if step not in known:
                known[step] = np.sort(of[members[b]] * (most + 1) + ranks[at[members[b]] + step])
            mine = of[members[a]] * (most + 1) + ranks[at[members[a]] + step]
            less[members[a]] += np.searchsorted(known[step], mine) - before[of[members[a]]]
    order[tied] = at[np.lexsort((less, of))]
    return order


def repeated_starts(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` have a string of ``length`` bytes that another of them has too."""
    key = next_bytes(x, 2 * length + 16)
    place = np.argsort(starts, kind="stable")
    order = sorted_suffixes(key, len(x), starts[place], length)
    left, right = order[:-1], order[1:]
    same = np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8]:
        same = same[key[left[same] + k] == key[right[same] + k]]
    repeated = np.concatenate([left[same], right[same]])
    return np.isin(starts, repeated)
