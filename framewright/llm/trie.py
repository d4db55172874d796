"""Self-join of a sorted word list at edit distance one, by active nodes of its trie."""

from __future__ import annotations

import numpy as np


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``begin, begin + count``, and for each the number of its range."""
    owner = np.repeat(np.arange(len(begin)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


class Trie:
    """Nodes are spans of the sorted words that share a prefix; below a span of one word no nodes are made.

    Arrays by node: ``lo, hi`` (span), ``depth``, ``end`` (the prefix is a word,
    the first of the span), ``first, count`` (children, which are neighbours in
    number).  ``edge`` holds parent and letter of each node but the root as one
    number, rising with the node's number.
    """

    LETTER = 1 << 21

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lo, hi, edges, counts = [np.zeros(1, np.int64)], [np.array([len(words)])], [], []
        base, depth, depths = 0, 0, [np.zeros(1, np.int64)]
        while len(lo[-1]):
            ended = self.size[lo[-1]] == depth
            owner, word = _spread(lo[-1] + ended, np.where(hi[-1] - lo[-1] > 1, hi[-1] - lo[-1] - ended, 0))
            key = (base + owner) * self.LETTER + self.text[self.begin[word] + depth]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            counts.append(np.bincount(owner[new], minlength=len(lo[-1])))
            edges.append(key[new])
            base += len(lo[-1])
            depth += 1
            lo.append(word[new])
            hi.append(word[np.concatenate((new[1:], [len(word)])) - 1] + 1 if len(new) else new)
            depths.append(np.full(len(new), depth))
        self.lo, self.hi, self.depth, self.edge = map(np.concatenate, (lo, hi, depths, edges))
        self.count = np.concatenate(counts)
        self.first = 1 + np.cumsum(self.count) - self.count
        self.end = self.size[self.lo] == self.depth
        self.lone = self.hi - self.lo == 1

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node's child by a letter, or -1."""
        key = node * self.LETTER + letter
        at = np.searchsorted(self.edge, key)
        found = self.edge[np.minimum(at, len(self.edge) - 1)] == key if len(self.edge) else np.zeros(len(key), bool)
        return np.where(found, at + 1, -1)

    def letter(self, node: np.ndarray) -> np.ndarray:
        return self.edge[node - 1] % self.LETTER

    def rests_equal(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, from_y: np.ndarray) -> np.ndarray:
        """Whether word ``x`` from ``at`` on equals word ``y`` from ``from_y`` on."""
        same = self.size[x] - at == self.size[y] - from_y
        for last in (True, False):  # cheap tests of one letter each
            i = np.flatnonzero(same & (self.size[x] > at))
            of_x, of_y = (self.size[x[i]] - 1, self.size[y[i]] - 1) if last else (at[i], from_y[i])
            same[i] = self.text[self.begin[x[i]] + of_x] == self.text[self.begin[y[i]] + of_y]
        for i in np.flatnonzero(same).tolist():
            same[i] = self.words[x[i]][at[i] :] == self.words[y[i]][from_y[i] :]
        return same


def near_pairs(words: list[str]) -> np.ndarray:
    """Pairs (i < j) of words that one inserted, deleted or replaced character tells apart.

    ``words`` are distinct and sorted.  Level by level, each node ``u`` of the
    trie carries its active nodes at distance one (at distance zero it is alone).
    A child ``u c`` has, of its parent's, those ``v c``; besides, the parent
    itself, the other children of the parent, and its own children.  An active
    place below a span of one word is that node and a depth (``deep``).
    Where both sides are down to one word, their rests are compared; where only
    ``u`` is, the same pair is met from the other side.
    """
    if len(words) < 2:
        return np.zeros((0, 2), np.int64)
    t = Trie(words)
    v = np.arange(1, 1 + t.count[0])
    u, deep = np.zeros_like(v), np.ones_like(v)
    found, level, depth = [], np.flatnonzero(~t.lone & (t.depth == 0)), 0
    while len(level):
        x, y = t.lo[u], t.lo[v]
        ends = t.end[u] & np.where(t.lone[v], deep == t.size[y], t.end[v]) & ~t.lone[u]
        both = np.flatnonzero(t.lone[u] & t.lone[v] & (x != y))
        both = both[t.rests_equal(x[both], np.full(len(both), depth), y[both], deep[both])]
        met = np.concatenate((np.flatnonzero(ends), both))
        found.append(np.stack((x[met], y[met]), axis=1))
        live = ~t.lone[u]
        u, v, deep = u[live], v[live], deep[live]
        owner, child = _spread(t.first[level], t.count[level])
        parent = level[owner]
        of, other = _spread(t.first[parent], t.count[parent])
        of, other = of[child[of] != other], other[child[of] != other]
        under, grand = _spread(t.first[child], t.count[child])
        # active nodes of the parent, one letter on
        i = np.flatnonzero(t.lone[v] & (deep < t.size[t.lo[v]]))
        to = t.child(u[i], t.text[t.begin[t.lo[v[i]]] + deep[i]])
        ok = to >= 0
        one = to[ok], v[i][ok], deep[i][ok] + 1
        j = np.flatnonzero(~t.lone[v])
        at, to = _spread(t.first[u[j]], t.count[u[j]])
        on = t.child(v[j][at], t.letter(to))
        ok = on >= 0
        many = to[ok], on[ok], t.depth[on[ok]]
        u = np.concatenate((one[0], many[0], child, child[of], child[under]))
        v = np.concatenate((one[1], many[1], parent, other, grand))
        deep = np.concatenate((one[2], many[2], np.full(len(child), depth), np.full(len(other), depth + 1), np.full(len(grand), depth + 2)))
        level, depth = child, depth + 1
        key = np.unique((u * len(t.lo) + v) * 3 + deep - depth + 1)  # deep is within one of depth
        u, v, deep = key // 3 // len(t.lo), key // 3 % len(t.lo), key % 3 + depth - 1
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return np.unique(np.sort(pairs, axis=1), axis=0)
