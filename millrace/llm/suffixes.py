"""Linear suffix sorting by Lyndon groups.

Suffixes are grouped by their longest Lyndon prefix. Groups are refined in
descending order: a suffix's previous smaller one (the last before it in a
lower group) is promoted right above its own group, further the more members
of the group point at it. Then one ascending pass puts each suffix in the next
free place of its group, following the pointers. Nothing is renamed and there
is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. The last symbol must be the only smallest."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    by_symbol = np.argsort(symbols, kind="stable")
    ranked = symbols[by_symbol]
    fresh = np.flatnonzero(np.diff(ranked, prepend=ranked[0] - 1))
    heads = np.repeat(fresh, np.diff(np.append(fresh, n)))
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    group = np.empty(n, np.int64)
    group[by_symbol] = heads
    order, place, group = by_symbol.tolist(), place.tolist(), group.tolist()
    size = [0] * n  # of the group that starts here
    for head, count in zip(fresh.tolist(), np.diff(np.append(fresh, n)).tolist(), strict=True):
        size[head] = count
    before = [-1] * n

    end = n
    while end:
        head = group[order[end - 1]]
        pointed: dict[int, int] = {}
        members = order[head:end]
        if len(members) > 1:
            members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(members) == 1:
            levels = (list(pointed),)
        else:
            by_count: dict[int, list[int]] = {}
            for j, times in pointed.items():
                by_count.setdefault(times, []).append(j)
            levels = [by_count[times] for times in sorted(by_count, reverse=True)]
        for promoted in levels:
            moved: dict[int, int] = {}
            for j in promoted:
                home = group[j]
                count = moved[home] = moved.get(home, 0) + 1
                to = home + size[home] - count
                at, other = place[j], order[to]
                order[at], order[to] = other, j
                place[other], place[j] = at, to
            for home, count in moved.items():
                if count < size[home]:
                    size[home] -= count
                    top = home + size[home]
                    size[top] = count
                    for k in range(top, top + count):
                        group[order[k]] = top
        end = head

    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free = size  # from here on: the next free place of a group
    for i in range(n):
        if group[i] >= 0:
            free[group[i]] = group[i]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            head = group[s]
            out[free[head]] = s
            free[head] += 1
            placed[s] = 1
            s = before[s]
    return np.array(out)
