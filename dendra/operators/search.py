"""Nearest points inside one task: numpy over blocks of points with boxes."""

from __future__ import annotations

import numpy as np

#: Points of a block, and points up to which a cloud is searched whole.
BLOCK = 64
WHOLE = 512
#: Distances computed at once.
AT_ONCE = 1 << 20


def squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, a row per query; axis by axis, so that equal points have equal distances everywhere."""
    d = q[:, None, 0] - x[None, :, 0]
    out = d * d
    for c in (1, 2):
        d = q[:, None, c] - x[None, :, c]
        out += d * d
    return out


def to_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes, a row per point; 0 inside."""
    out = np.zeros((len(q), len(low)))
    for c in range(3):
        d = np.maximum(np.maximum(low[None, :, c] - q[:, None, c], q[:, None, c] - high[None, :, c]), 0.0)
        out += d * d
    return out


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``x`` in parts of at most ``most``: halves along the widest axis, and so on."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(np.sort(rows))
            continue
        own = x[rows]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = np.argpartition(own[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class Cloud:
    """Points, in the order that settles ties, ready to be searched many times."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.blocks = halved(x, BLOCK) if len(x) > WHOLE else []
        if self.blocks:
            self.low = np.array([x[b].min(axis=0) for b in self.blocks])
            self.high = np.array([x[b].max(axis=0) for b in self.blocks])

    def nearest(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the cloud, squared distances) of each query's k nearest points, nearest first; ties go to the earlier row."""
        k = min(k, len(self.x))
        if not len(q) or not k:
            return np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
        step = max(1, AT_ONCE // (len(self.x) if not self.blocks else max(len(self.blocks), BLOCK * 4)))
        parts = [self._whole(q[a : a + step], k) if not self.blocks else self._by_blocks(q[a : a + step], k) for a in range(0, len(q), step)]
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _whole(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        d = squared(q, self.x)
        if k == 1:
            at = d.argmin(axis=1)[:, None]
            return at, np.take_along_axis(d, at, 1)
        return smallest(np.broadcast_to(np.arange(len(self.x)), d.shape), d, k)

    def _by_blocks(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The block nearest to a query gives a bound; other blocks are searched by the queries whose bound they may beat."""
        far = to_boxes(q, self.low, self.high)
        at, best = np.full((len(q), k), len(self.x), np.int64), np.full((len(q), k), np.inf)

        def look(rows: np.ndarray, block: int) -> None:
            own = self.blocks[block]
            d = squared(q[rows], self.x[own])
            if k == 1:
                i = d.argmin(axis=1)
                d, i = d[np.arange(len(rows)), i], own[i]
                better = (d < best[rows, 0]) | ((d == best[rows, 0]) & (i < at[rows, 0]))
                at[rows[better], 0], best[rows[better], 0] = i[better], d[better]
            else:
                i = np.broadcast_to(own, d.shape)
                at[rows], best[rows] = smallest(np.concatenate([at[rows], i], axis=1), np.concatenate([best[rows], d], axis=1), k)

        first = far.argmin(axis=1)
        order = np.argsort(first, kind="stable")
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        for rows in np.split(order, cuts):
            look(rows, int(first[rows[0]]))
        nearby = far <= best[:, -1:]
        nearby[np.arange(len(q)), first] = False
        for block in np.flatnonzero(nearby.any(axis=0)):
            rows = np.flatnonzero(nearby[:, block] & (far[:, block] <= best[:, -1]))
            if len(rows):
                look(rows, int(block))
        return at, best


def smallest(rows: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k entries of each line with the smallest (distance, row), in order."""
    if 4 * k < d.shape[1]:  # cut first; entries equal to the k-th must stay
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        width = int((d <= bound).sum(axis=1).max())
        keep = np.argsort(d > bound, axis=1, kind="stable")[:, :width]
        rows, d = np.take_along_axis(rows, keep, 1), np.take_along_axis(d, keep, 1)
    order = np.lexsort((rows, d), axis=-1)[:, :k]
    return np.take_along_axis(rows, order, 1), np.take_along_axis(d, order, 1)
