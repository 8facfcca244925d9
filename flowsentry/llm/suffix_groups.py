"""Suffix sorting by linear grouping.

A suffix's Lyndon prefix reaches up to its next smaller suffix. The first phase puts suffixes with equal
Lyndon prefixes into groups, in order of those prefixes: it starts with groups by first symbol and takes the groups
from the largest down. Each member has a pointer to the previous suffix of a smaller group. Those previous
suffixes' prefixes run on through the group's: they leave their group for a new one right behind it, the ones that
were pointed at most often last. The second phase walks the suffixes in order, from the smallest: the suffixes whose
next smaller one it has just met, found along the previous-smaller pointers, are the next of their groups. No
shorter string is named or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` in order; the last symbol must be the only smallest one."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    start, previous = groups(symbols)
    out, filled = [0] * n, list(range(n))  # filled[g]: where the next member of the group that starts at g goes
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            g = start[s]
            out[filled[g]] = s
            filled[g] += 1
            s = previous[s]
    return np.array(out)


def groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix the start of its group among all, and the previous suffix of a smaller group (-1: none)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    start_of = np.empty(n, "i8")
    start_of[order] = first
    place_of = np.empty(n, "i8")
    place_of[order] = np.arange(n)
    member, start, place = order.tolist(), start_of.tolist(), place_of.tolist()
    end = {}  # of groups that have lost members
    ends = np.append(np.flatnonzero(new)[1:], n)
    end = dict(zip(np.flatnonzero(new).tolist(), ends.tolist()))
    previous = [-1] * n

    stop = n
    while stop > 0:
        g = start[member[stop - 1]]
        if stop - g == 1:
            i = member[g]
            j = i - 1
            while j >= 0 and start[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0 and end[h := start[j]] - h > 1:
                last = end[h] - 1
                k, x = place[j], member[last]
                member[k], member[last] = x, j
                place[x], place[j] = k, last
                end[h], end[last] = last, last + 1
                start[j] = last
            stop = g
            continue
        pointed: dict[int, int] = {}
        for i in sorted(member[g:stop]):
            j = i - 1
            while j >= 0 and start[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            by_group: dict[int, list[int]] = {}
            for j in by_count[count]:
                by_group.setdefault(start[j], []).append(j)
            for h, moved in by_group.items():
                last = end[h]
                low = last - len(moved)
                if low == h:  # the whole group moves: it stays as it is
                    continue
                for j in moved:
                    last -= 1
                    k, x = place[j], member[last]
                    member[k], member[last] = x, j
                    place[x], place[j] = k, last
                end[h], end[low] = low, end[h]
                for j in moved:
                    start[j] = low
        stop = g
    return start, previous
