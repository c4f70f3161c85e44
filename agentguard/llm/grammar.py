"""Recompression of a sequence into a run-length grammar, and longest common extensions by it.

Levels of the grammar alternate between two compressions of the level below. Block compression makes one
symbol of every stretch of equal symbols. Pair compression splits the alphabet into a left and a right half and
makes one symbol of every left symbol that is followed by a right one. Equal stretches are cut alike except
at their ends, so two positions that agree on a long stretch soon reach borders of equal symbols of higher levels.

A query climbs while both positions stand at the start of equal symbols, moves on by at most two symbols
a level where they do not, and goes down again from the first symbols that differ. All queries of a call
do this together, level by level.
"""

from __future__ import annotations

import numpy as np

from agentguard.llm.flat import mix


def _block_parents(symbols: np.ndarray) -> np.ndarray:
    """Index of the symbol above each symbol: stretches of equal symbols share one."""
    new = np.ones(len(symbols), dtype=bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    return np.cumsum(new) - 1


def _pair_parents(symbols: np.ndarray, level: int) -> np.ndarray:
    """As above: a symbol of the left half shares its parent with a symbol of the right half after it."""
    left = mix(symbols.astype(np.uint64) + np.uint64((level + 1) << 40)) >> np.uint64(63) == 0
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = ~(left[:-1] & ~left[1:])
    return np.cumsum(new) - 1


def recompress(symbols: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(symbols, parents) per level; `parents[k]` leads from level k to k + 1, the last level has none.

    A symbol without a partner keeps its number; others are numbered on from the largest, equal ones alike.
    """
    levels, parents = [symbols.astype(np.int64)], []
    fresh = int(symbols.max()) + 1 if len(symbols) else 0
    while len(levels[-1]) > 2:
        below = levels[-1]
        by_blocks = len(parents) % 2 == 0
        up = _block_parents(below) if by_blocks else _pair_parents(below, len(parents))
        first = np.flatnonzero(np.diff(up, prepend=-1))
        sizes = np.diff(first, append=len(below))
        above = below[first].copy()
        joint = np.flatnonzero(sizes > 1)
        if len(joint):
            second = sizes[joint] if by_blocks else below[first[joint] + 1]
            _, number = np.unique(above[joint] * (int(second.max()) + 1) + second, return_inverse=True)
            above[joint] = fresh + number
            fresh += int(number.max()) + 1
        parents.append(up)
        levels.append(above)
    return levels, parents


class Extensions:
    """Common extensions to the right of pairs of positions, over the levels of a grammar."""

    def __init__(self, levels: list[np.ndarray], parents: list[np.ndarray]):
        self.levels, self.parents = levels, parents
        self.starts = [np.flatnonzero(np.diff(up, prepend=-1)) for up in parents]
        self.first = []
        self.left_in_block = []
        for k, up in enumerate(parents):
            flags = np.zeros(len(up) + 1, dtype=bool)
            flags[self.starts[k]] = True
            self.first.append(flags)
            #: symbols from here to the end of the block; for pairs one step is all there is
            self.left_in_block.append(np.append(self.starts[k][1:], len(up))[up] - np.arange(len(up)) if k % 2 == 0 else None)

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal symbols from x and from y on; the sequence must end in a symbol that occurs once."""
        out = np.zeros(len(x), dtype=np.int64)
        at = np.flatnonzero(self.levels[0][x] == self.levels[0][y])
        u, v = x[at], y[at]
        stopped: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.levels]
        for k, symbols in enumerate(self.levels):
            if not len(at):
                break
            if k == len(self.parents):
                raise ValueError("the sequence must begin and end in symbols that occur once")
            for _ in range(1 if k % 2 == 0 else 2):
                within = ~(self.first[k][u] & self.first[k][v])
                if not within.any():
                    break
                step = np.minimum(self.left_in_block[k][u[within]], self.left_in_block[k][v[within]]) if k % 2 == 0 else 1
                u[within] += step
                v[within] += step
                ends = symbols[u] != symbols[v]
                if ends.any():
                    stopped[k].append((at[ends], u[ends], v[ends]))
                    at, u, v = at[~ends], u[~ends], v[~ends]
            u, v = self.parents[k][u], self.parents[k][v]
            ends = self.levels[k + 1][u] != self.levels[k + 1][v]
            if ends.any():
                stopped[k + 1].append((at[ends], u[ends], v[ends]))
                at, u, v = at[~ends], u[~ends], v[~ends]
        at = np.zeros(0, dtype=np.int64)
        u = v = at
        for k in range(len(self.levels) - 1, -1, -1):
            if len(at):
                symbols = self.levels[k]
                u, v = self.starts[k][u], self.starts[k][v]
                same = symbols[u] == symbols[v]
                step = np.minimum(self.left_in_block[k][u[same]], self.left_in_block[k][v[same]]) if k % 2 == 0 else 1
                u[same] += step
                v[same] += step
            if stopped[k]:
                parts = [*stopped[k], (at, u, v)]
                at, u, v = (np.concatenate([p[i] for p in parts]) for i in range(3))
        out[at] = u - x[at]
        return out


def both_ways(symbols: np.ndarray) -> tuple[Extensions, Extensions]:
    """Extensions of a sequence, and of the same grammar read from the end."""
    levels, parents = recompress(symbols)
    mirrored = [len(levels[k + 1]) - 1 - up[::-1] for k, up in enumerate(parents)]
    return Extensions(levels, parents), Extensions([s[::-1] for s in levels], mirrored)
