"""Signature trees over one block of sets: which of them are alike enough.

A tree's nodes hold the OR of their members' token bitmaps, their size range
and the most tokens that any member has beyond its bits.  Two trees are walked
together; a pair of nodes is left as soon as the largest overlap that any pair
of members could have is too small for the threshold.
"""

from __future__ import annotations

import numpy as np

LEAF = 16


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], members: np.ndarray, bits: int):
        self.sets = sets
        sizes = np.array([len(sets[i]) for i in members])
        # Near sizes and near smallest tokens lie together, so ORs stay sparse.
        order = np.lexsort(([int(sets[i][0]) for i in members], sizes))
        self.members, self.sizes = members[order], sizes[order]
        self.maps = np.zeros((len(members), bits // 8), np.uint8)
        for row, i in enumerate(self.members):
            bit = (sets[i] % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(self.maps[row], bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(1)
        # Each level: (first member, end, OR bitmap, least size, most size, most excess).
        level = [self._node(lo, min(lo + LEAF, len(members))) for lo in range(0, len(members), LEAF)]
        self.levels = [level]
        while len(level) > 1:
            level = [self._node(level[i][0], level[min(i + 3, len(level) - 1)][1]) for i in range(0, len(level), 4)]
            self.levels.append(level)

    def _node(self, lo: int, hi: int) -> tuple:
        return lo, hi, np.bitwise_or.reduce(self.maps[lo:hi], 0), int(self.sizes[lo]), int(self.sizes[hi - 1]), int(self.excess[lo:hi].max())


def _may_link(a: tuple, b: tuple, num: int, den: int) -> bool:
    if a[4] * den < b[3] * num or b[4] * den < a[3] * num:
        return False
    common = int(np.bitwise_count(a[2] & b[2]).sum()) + min(a[5], b[5])
    return common * (num + den) >= num * (a[3] + b[3])


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, num: int, den: int, forest: Forest) -> list[tuple[int, int]]:
    """Pairs of ``left`` x ``right`` (or within ``left``) with Jaccard
    similarity of at least ``num / den`` that join two trees of ``forest``.

    They span the same components as all linked pairs do.
    """
    if not len(left) or right is not None and not len(right):
        return []
    bits = max(64, 1 << int(4 * max(len(sets[i]) for i in (left if right is None else np.concatenate([left, right]))) - 1).bit_length())
    bits = min(bits, 1 << 17)
    a = SignatureTree(sets, left, bits)
    b = a if right is None else SignatureTree(sets, right, bits)
    found: list[tuple[int, int]] = []
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, ia, lb, ib = todo.pop()
        x, y = a.levels[la][ia], b.levels[lb][ib]
        if not _may_link(x, y, num, den):
            continue
        if la or lb:
            if la >= lb:
                nexts = [(la - 1, j, lb, ib) for j in range(4 * ia, min(4 * ia + 4, len(a.levels[la - 1])))]
            else:
                nexts = [(la, ia, lb - 1, j) for j in range(4 * ib, min(4 * ib + 4, len(b.levels[lb - 1])))]
            if a is b:
                nexts = [n for n in nexts if a.levels[n[0]][n[1]][0] < b.levels[n[2]][n[3]][1]]
            todo += nexts
            continue
        bound = np.bitwise_count(a.maps[x[0] : x[1], None] & b.maps[None, y[0] : y[1]]).sum(2, dtype=np.int64) + np.minimum(a.excess[x[0] : x[1], None], b.excess[None, y[0] : y[1]])
        able = bound * (num + den) >= num * (a.sizes[x[0] : x[1], None] + b.sizes[None, y[0] : y[1]])
        for i, j in zip(*np.nonzero(able), strict=True):
            i, j = i + x[0], j + y[0]
            if a is b and i >= j:
                continue
            p, q = int(a.members[i]), int(b.members[j])
            if forest.find(p) == forest.find(q):
                continue
            if overlap(sets[p], sets[q]) * (num + den) >= num * (len(sets[p]) + len(sets[q])):
                forest.union(p, q)
                found.append((p, q))
    return found
