"""A trie of ordered sets that a set is compared with as a whole.

The sets of a block are written in one order of elements, the frequent ones
first, so that like sets share long paths. A walk keeps the overlap of the probe
with the path so far; it counts a shared path once for all sets below, and leaves
out a subtree when what remains of the probe and of the sets can't reach the
threshold any more, or when all its sets are in the probe's class already.
"""

from __future__ import annotations

import numpy as np


class Classes:
    """Union-find over the positions of a block."""

    def __init__(self, start: list[int]) -> None:
        self.above = start

    def find(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.above[max(i, j)] = min(i, j)


class _Node:
    __slots__ = ("run", "below", "ends", "most", "least", "any", "alike")

    def __init__(self, run: np.ndarray, most: int, least: int, any_: int) -> None:
        self.run = run
        self.below: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.most, self.least = most, least  # elements at most, size at least, of the sets below
        self.any, self.alike = any_, True  # one of them; whether all are in its class


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets over 0, 1, ... with the most frequent elements first, each in order."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(s) for s in np.split(rank[inverse], cuts)], len(counts)


class Trie:
    """Sets by position: ``elements`` as ``ranked`` gives them, ``sizes`` with unshared elements."""

    def __init__(self, elements, n_elements: int, sizes, classes: Classes, percent: int) -> None:
        self.elements, self.sizes, self.classes = elements, sizes, classes
        self.percent = percent
        self.mask = np.zeros(n_elements, bool)
        self.root = _Node(np.zeros(0, np.int64), 0, 1 << 62, -1)

    def insert(self, i: int) -> None:
        rest, size, node = self.elements[i], self.sizes[i], self.root
        total = len(rest)
        while True:
            if node.any < 0:
                node.any = i
            elif node.alike:
                node.alike = self.classes.find(node.any) == self.classes.find(i)
            node.most, node.least = max(node.most, total), min(node.least, size)
            if not len(rest):
                node.ends.append(i)
                return
            child = node.below.get(int(rest[0]))
            if child is None:
                node.below[int(rest[0])] = leaf = _Node(rest, total, size, i)
                leaf.ends.append(i)
                return
            run = child.run
            n = min(len(run), len(rest))
            differ = np.flatnonzero(run[:n] != rest[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(run):  # the child keeps what lies below the fork
                fork = _Node(run[:same], child.most, child.least, child.any)
                fork.alike = child.alike
                child.run = run[same:]
                fork.below[int(child.run[0])] = child
                node.below[int(rest[0])] = fork
                child = fork
            node, rest = child, rest[same:]

    def link(self, i: int) -> list[int]:
        """Join set ``i`` with all sets in the trie that reach the threshold; those it joined."""
        x, size, percent, mask = self.elements[i], self.sizes[i], self.percent, self.mask
        find = self.classes.find
        mask[x] = True
        found = []
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, shared = todo.pop()
            if node.any < 0 or node.alike and find(node.any) == find(i):
                continue
            if len(node.run):
                shared += int(np.count_nonzero(mask[node.run]))
                depth += len(node.run)
                passed = int(np.searchsorted(x, node.run[-1], "right"))
                best = min(len(x) - passed + shared, node.most - depth + shared)
                if 100 * best < percent * (size + node.least - best):
                    continue
            for j in node.ends:
                if find(j) != find(i) and 100 * shared >= percent * (size + self.sizes[j] - shared):
                    self.classes.join(i, j)
                    found.append(j)
            likely = []
            for first, child in node.below.items():
                (likely if mask[first] else todo).append((child, depth, shared))
            todo.extend(likely)
        mask[x] = False
        return found


def linked(sets: list[np.ndarray], sizes: list[int], percent: int) -> list[int]:
    """For every set the lowest position of its class, by links within this block."""
    elements, n = ranked(sets)
    classes = Classes(list(range(len(sets))))
    trie = Trie(elements, n, sizes, classes, percent)
    for i in range(len(sets)):
        trie.link(i)
        trie.insert(i)
    return [classes.find(i) for i in range(len(sets))]


def linked_across(
    stored: list[np.ndarray], stored_sizes: list[int], stored_classes: list[int],
    probes: list[np.ndarray], probe_sizes: list[int], probe_classes: list[int], percent: int,
) -> list[tuple[int, int]]:
    """Links (probe, stored) that join classes which weren't one yet."""
    elements, n = ranked([*stored, *probes])
    first: dict[int, int] = {}
    start = [first.setdefault(c, i) for i, c in enumerate([*stored_classes, *probe_classes])]
    trie = Trie(elements, n, [*stored_sizes, *probe_sizes], Classes(start), percent)
    for i in range(len(stored)):
        trie.insert(i)
    k = len(stored)
    return [(i - k, j) for i in range(k, k + len(probes)) for j in trie.link(i)]
