"""Suffix arrays by linear-time grouping.

Phase 1 groups suffixes by their Lyndon prefix. It starts from groups by first symbol and takes the groups in descending order. Each
member's previous smaller suffix is found by following the pointers of suffixes already done; those suffixes that are pointed at leave their
group for new ones just above it, ordered by how many members point at them. Phase 2 emits the order inside every group by one ascending pass: when a
suffix is emitted, the suffix before it and those on its chain of previous smaller suffixes come next in their groups. Nothing is renamed and nothing
recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of the suffixes in ascending order; the last symbol must be smaller than all others, and occur once."""
    n = len(symbols)
    alphabet = {c: k for k, c in enumerate(sorted(set(symbols)))}
    group = [alphabet[c] for c in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    lower = list(range(-1, len(alphabet) - 1))
    upper = list(range(1, len(alphabet) + 1))
    upper[-1] = -1
    prev = [-1] * n
    done = bytearray(n)
    final: list[int] = []
    g = len(alphabet) - 1
    while g >= 0:
        count: dict[int, int] = {}
        if size[g] == len(members[g]):
            own = members[g]
        else:
            own = [i for i in members[g] if group[i] == g]
            members[g] = own
        if len(own) == 1:
            i = own[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            final.append(g)
            # A single suffix that leaves a group of several; alone in its group it stays.
            if p >= 0 and size[old := group[p]] > 1:
                count[p] = 1
        elif own:
            own.sort()
            for i in own:
                done[i] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    count[p] = count.get(p, 0) + 1
            final.append(g)
        if count:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in count.items():
                moved.setdefault((-times, group[p]), []).append(p)
            for key in sorted(moved) if len(moved) > 1 else moved:
                old, leave = key[1], moved[key]
                if len(leave) == size[old]:
                    continue  # the whole rest moves: the group itself takes the new one's place
                new, above = len(members), upper[old]
                members.append(leave)
                size.append(len(leave))
                size[old] -= len(leave)
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
                for p in leave:
                    group[p] = new
        g = lower[g]
    front = [0] * len(members)
    at = 0
    for g in reversed(final):
        front[g] = at
        at += len(members[g])
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = prev[j]
    return out


def equal_windows(symbols: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start, the number of its class: starts are of one class iff the `width` symbols from there are equal.

    Symbols are positive. The suffix array is built over all of them; starts with equal windows are next to each other in it.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    order = np.array(suffix_array([*symbols.tolist(), 0]), np.int64)
    wanted = np.full(len(symbols) + 1, -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    found = order[wanted[order] >= 0]
    new = np.zeros(len(found), bool)
    new[0] = True
    for k in range(width):
        column = symbols[found + k]
        new[1:] |= column[1:] != column[:-1]
    out = np.empty(len(starts), np.int64)
    out[wanted[found]] = np.cumsum(new) - 1
    return out
