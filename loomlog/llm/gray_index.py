"""Gray-order hierarchical index over fingerprints of one or more 64-bit words, for one block of the data.

Fingerprints are sorted by Gray rank, so that neighbours share many bits. Each leaf holds a run
of them; its mask keeps the bits on which all members agree and its pattern their values. Upper
nodes factor what their children share. Two nodes are at least
``popcount((pattern_a ^ pattern_b) & mask_a & mask_b)`` bits apart, over all words, and going down only adds
bits to that sum, so a pair of groups is dropped as soon as the sum passes the threshold.
Pairs of groups that are one component already are dropped as well: only links between
different components matter, which keeps dense clusters from being enumerated.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
FANOUT = 8


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence (prefix XOR of its bits)."""
    rank = fps.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(fps: np.ndarray) -> np.ndarray:
    """Places in order of Gray rank, by the first word first."""
    return np.lexsort([gray_rank(fps[:, w]) for w in reversed(range(fps.shape[1]))])


def bits_set(words: np.ndarray) -> np.ndarray:
    """Over the last axis, the words of a fingerprint."""
    if words.shape[-1] == 1:
        return np.bitwise_count(words[..., 0])
    return np.bitwise_count(words).sum(axis=-1, dtype=np.uint16)


class Forest:
    """Union-find over ``n`` items that remembers the edges that joined two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)
        self.edges: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                return
            hi, lo = np.maximum(la, lb), np.minimum(la, lb)
            # One edge for each tree that is hung below a smaller one; the others try again.
            roots, first = np.unique(hi, return_index=True)
            self.edges.append(np.stack([a[first], b[first]], axis=1))
            parent = np.arange(len(self.label), dtype=np.int64)
            parent[roots] = lo[first]
            while True:
                above = parent[parent]
                if np.array_equal(above, parent):
                    break
                parent = above
            self.label = parent[self.label]

    def spanning(self) -> np.ndarray:
        return np.concatenate(self.edges) if self.edges else np.empty((0, 2), dtype=np.int64)


class GrayIndex:
    """The index over ``fps`` (distinct, uint64, a column for each word if several); ``levels[0]`` are the leaves."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        fps = fps.reshape(len(fps), -1)
        self.order = gray_order(fps)
        self.fps = fps[self.order]
        self.leaf, self.fanout = leaf, fanout
        starts = np.arange(0, len(fps), leaf)
        mask = ~(np.bitwise_or.reduceat(self.fps, starts) ^ np.bitwise_and.reduceat(self.fps, starts))
        self.levels = [(mask, self.fps[starts] & mask)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(mask), fanout)
            agree = np.bitwise_and.reduceat(mask, starts)
            agree &= ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts))
            self.levels.append((agree, pattern[starts] & agree))

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the component of a node whose members all share one, else -1."""
        starts = np.arange(0, len(label), self.leaf)
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        out = [np.where(low == high, low, -1)]
        for _ in self.levels[1:]:
            starts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.levels[level][0])
        off = np.arange(self.fanout)
        ca = (a[:, None] * self.fanout + off)[:, :, None]
        cb = (b[:, None] * self.fanout + off)[:, None, :]
        ca, cb = np.broadcast_arrays(ca, cb)
        keep = (ca < n) & (cb < n) & (ca <= cb)
        return ca[keep], cb[keep]

    def link(self, distance: int, chunk: int = 1 << 15) -> np.ndarray:
        """Edges (positions in the given array) of a spanning forest of all links."""
        n = len(self.fps)
        forest = Forest(n)
        at = np.arange(n)
        for step in range(1, min(9, n)):
            near = bits_set(self.fps[step:] ^ self.fps[:-step]) <= distance
            forest.link(at[:-step][near], at[step:][near])
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        known, uniform = None, []
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            if known is not forest.label:
                known, uniform = forest.label, self._uniform(forest.label)
            mask, pattern = self.levels[level]
            keep = bits_set((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            keep &= (uniform[level][a] != uniform[level][b]) | (uniform[level][a] < 0)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level:
                stack.append((level - 1, *self._children(level - 1, a, b)))
                continue
            self._compare(a, b, distance, forest)
        return self.order[forest.spanning()]

    def _compare(self, a: np.ndarray, b: np.ndarray, distance: int, forest: Forest, block: int = 4096) -> None:
        n = len(self.fps)
        off = np.arange(self.leaf)
        block = max(1, block // self.fps.shape[1])
        for i in range(0, len(a), block):
            left = a[i : i + block, None] * self.leaf + off
            right = b[i : i + block, None] * self.leaf + off
            fl, fr = self.fps[np.minimum(left, n - 1)], self.fps[np.minimum(right, n - 1)]
            near = bits_set(fl[:, :, None] ^ fr[:, None, :]) <= distance
            near &= (left < n)[:, :, None] & (right < n)[:, None, :]
            near &= left[:, :, None] < right[:, None, :]
            k, x, y = np.nonzero(near)
            forest.link(left[k, x], right[k, y])


def small_groups(key: np.ndarray, fps: np.ndarray, distance: int, most: int) -> np.ndarray:
    """Links between rows of equal key, for keys of at most ``most`` rows each, all at once."""
    fps = fps.reshape(len(fps), -1)
    found = []
    at = np.arange(len(key))
    for step in range(1, min(most, len(key))):
        same = key[step:] == key[:-step]
        if not same.any():
            break
        near = same.copy()
        at_step = np.flatnonzero(same)
        near[at_step] = bits_set(fps[step:][at_step] ^ fps[:-step][at_step]) <= distance
        found.append(np.stack([at[:-step][near], at[step:][near]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
