"""Phrases with edits in long texts: bit i of a state says that i letters of the phrase are behind, in many places of the text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Letters that are gone through at once, and places among them where that begins.
CHUNK, LANES = 1 << 20, 8192


@dataclass(frozen=True, eq=False)
class Pattern:
    """A phrase over letters that are bytes."""

    n: int
    edits: int
    #: By letter, bits 2 << i for the i-th letters of the phrase it stands for, and for letters i - 1 and i it stands for together.
    one: np.ndarray
    split: np.ndarray | None
    #: Two letters of the text, and the bits of letters they stand for together.
    pairs: tuple[tuple[int, int, int], ...]
    #: Bits of letters of the phrase that may be left out at no cost.
    soft: int

    @property
    def reach(self) -> int:
        """Letters of the longest stretch that is aligned with the phrase, if each stands for two and a soft one follows each edit."""
        return 2 * (self.n + self.edits) + 2


def width(n: int) -> type | None:
    """The narrowest type with a bit for each of n letters and one more."""
    return np.uint16 if n < 16 else np.uint32 if n < 32 else np.uint64 if n < 64 else None


def ends(text: np.ndarray, p: Pattern, soft: int) -> np.ndarray:
    """Where in text the phrase ends with p.edits edits at most; letters from 1 to soft may be left out of the text at no cost."""
    found = []
    for at in range(0, len(text), CHUNK):
        back = min(at, p.reach)
        own = _ends(text[at - back : at + CHUNK], p, soft)
        found.append(own[own >= back] + (at - back))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ends(text: np.ndarray, p: Pattern, soft: int) -> np.ndarray:
    n, back, kind, levels = len(text), p.reach, p.one.dtype, range(p.edits + 1)
    lanes = max(1, min(LANES, n // (8 * back)))
    each = -(-n // lanes)
    padded = np.zeros(back + lanes * each, np.uint8)
    padded[back : back + n] = text
    grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, back + each)[::each].T)
    one, split = p.one.take(grid), None if p.split is None else p.split.take(grid)
    two = None
    if p.pairs:
        two = np.zeros(grid.shape, kind)
        for a, b, bits in p.pairs:
            two[1:] |= ((grid[:-1] == a) & (grid[1:] == b)) * kind.type(bits)
    left_out = ((grid >= 1) & (grid <= soft)) * kind.type(~kind.type(0)) if soft else None
    first = [1 | p.soft & 2]
    for _ in levels[1:]:
        x = first[-1] | first[-1] << 1
        first.append(x | x << 1 & p.soft)
    mask, last = (1 << 8 * kind.itemsize) - 1, levels[-1]
    states = [np.full(lanes, x & mask, kind) for x in first]
    before = [np.zeros(lanes, kind) for _ in levels]
    room, t = [[np.empty(lanes, kind) for _ in levels] for _ in range(3)], np.empty(lanes, kind)
    seen = np.empty(grid.shape, kind)
    add, both, either = np.add, np.bitwise_and, np.bitwise_or  # x + x is faster than x << 1
    for j in range(len(grid)):
        now = room[j % 3][:last] + [seen[j]]
        for d in levels:
            x, new = states[d], now[d]
            add(x, x, out=new)
            both(new, one[j], out=new)
            if d:
                y = states[d - 1]
                either(y, now[d - 1], out=t)
                add(t, t, out=t)
                either(new, t, out=new)
                either(new, y, out=new)
            else:
                either(new, 1, out=new)
            if two is not None:
                add(before[d], before[d], out=t)
                both(t, two[j], out=t)
                either(new, t, out=new)
            if split is not None:
                add(x, x, out=t)
                add(t, t, out=t)
                both(t, split[j], out=t)
                either(new, t, out=new)
            if left_out is not None:
                both(x, left_out[j], out=t)
                either(new, t, out=new)
            if p.soft:
                add(new, new, out=t)
                both(t, p.soft, out=t)
                either(new, t, out=new)
        before, states = states, now
    steps, lane = np.divmod(np.flatnonzero((seen[back:] & kind.type(1 << p.n)) != 0), lanes)
    found = lane * each + steps
    return np.sort(found[found < n])
