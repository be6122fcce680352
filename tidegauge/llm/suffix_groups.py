"""Suffix arrays by linear grouping construction.

Phase 1 refines groups of suffixes until each holds the suffixes with one Lyndon prefix: groups are taken in descending
order, and what points to a group by previous-smaller pointers moves up within its own group, the more pointers the
higher. Phase 2 reads the groups off in ascending order: each sorted suffix places the one before it, and along that one's
pointers its ancestors, at the front of their groups. No names are given anew and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``values`` (non-negative integers) in order; a suffix sorts before its extensions."""
    n = len(values) + 1
    coded = np.append(np.asarray(values, np.int64) + 1, 0)
    order = np.argsort(coded, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(coded[order]) != 0])
    sizes = np.diff(np.r_[heads, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, sizes)
    group = group.tolist()
    size, members, ending = [0] * n, [None] * n, [0] * n
    for head, count in zip(heads.tolist(), sizes.tolist(), strict=True):
        size[head], ending[head + count - 1] = count, head
        members[head] = order[head : head + count].tolist()
    smaller = [-1] * n
    _refine(group, size, members, ending, smaller)
    return _emit(group, smaller)


def _refine(group: list, size: list, members: list, ending: list, smaller: list) -> None:
    """Phase 1: ``group`` becomes the start of each suffix's final group, ``smaller`` its previous-smaller pointer."""
    end = len(group) - 1
    while end > 0:
        head = ending[end]
        end = head - 1
        if size[head] == 1:
            held = members[head]
            i = held[0] if len(held) == 1 else next(s for s in held if group[s] == head)
            p = i - 1
            while p >= 0 and group[p] >= head:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                _raise([p], group, size, members, ending)
            continue
        held = sorted(s for s in members[head] if group[s] == head)
        pointed: dict[int, int] = {}
        for i in held:
            p = i - 1
            while p >= 0 and group[p] >= head:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            _raise(list(pointed), group, size, members, ending)
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, count in pointed.items():
            by_count.setdefault(count, {}).setdefault(group[p], []).append(p)
        for count in sorted(by_count, reverse=True):
            regrouped: dict[int, list[int]] = {}
            for p in (p for ps in by_count[count].values() for p in ps):
                regrouped.setdefault(group[p], []).append(p)
            for ps in regrouped.values():
                _raise(ps, group, size, members, ending)


def _raise(moved: list, group: list, size: list, members: list, ending: list) -> None:
    """Moves suffixes of one group into a new group right above it."""
    head = group[moved[0]]
    left = size[head] - len(moved)
    if not left:
        return
    fresh = head + left
    ending[fresh + len(moved) - 1], ending[fresh - 1] = fresh, head
    size[head], size[fresh], members[fresh] = left, len(moved), moved
    for s in moved:
        group[s] = fresh


def _emit(group: list, smaller: list) -> np.ndarray:
    """Phase 2: the order of all suffixes but the empty one."""
    n = len(group)
    out, placed, front = [-1] * n, bytearray(n), list(range(n))
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = smaller[j]
    return np.array(out[1:], np.int64)
