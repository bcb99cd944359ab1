"""The k nearest of some vectors among others that come block by block: cheap lower bounds first, exact distances of what they let through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ROWS, COLUMNS, FIRST, PAIRS = 512, 4096, 64, 1 << 15
NOBODY = np.iinfo(np.int64).max


def pair_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of q[i] and x[i], by direct differences."""
    if metric == "euclidean":
        d = q - x
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    if metric == "manhattan":
        return np.abs(q - x).sum(1)
    if metric == "hamming":
        return np.bitwise_count((q.astype(np.int64) ^ x.astype(np.int64)).view(np.uint64)).sum(1).astype(float)
    norms = np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", x, x))
    cos = np.divide(np.einsum("ij,ij->i", q, x), norms, out=np.zeros(len(q)), where=norms > 0)
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


class _Products:
    """Euclidean and cosine: one product in single precision, less a bound of its error. Both sides are centred and scaled first."""

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        size = x.shape[1]
        self.c, self.cosine, self.scale, self.lost = 2 * (size + 8) * 2.0**-24, metric == "cosine", 1.0, 0.0
        if self.cosine:
            q, x = (v / np.where(n > 0, n, 1) for v in (q, x) for n in (np.linalg.norm(v, axis=1, keepdims=True),))
            own, other, self.base = np.ones(len(q)), np.full(len(x), 2.0), np.zeros(len(q))
            length = np.ones(len(x))
        else:
            middle = x.mean(0)
            self.scale = float(np.abs(x - middle).max(initial=0.0)) or 1.0
            self.lost = 8 * 2.0**-52 * np.sqrt(size) * max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0)) / self.scale
            q, x = (q - middle) / self.scale, (x - middle) / self.scale
            self.base = np.einsum("ij,ij->i", q, q)
            other = np.einsum("ij,ij->i", x, x)
            own, length = np.sqrt(self.base), np.sqrt(other)
        one = np.ones((len(q), 1))
        self.q = np.hstack([-2 * q, one, -2 * self.c * own[:, None]]).astype(np.float32)
        self.x = np.hstack([x, (1 - self.c) * other[:, None], length[:, None]]).astype(np.float32)

    def may(self, r: slice, c: slice, most: np.ndarray) -> np.ndarray:
        """Positions, in order, of the pairs of rows r and columns c that may be as near as `most` of their row."""
        most = (most / self.scale + self.lost) ** 2
        limit = most - self.base[r] + 1e-6 * (most + self.base[r]) + 1e-30
        return np.flatnonzero(self.q[r] @ self.x[c].T <= limit.astype(np.float32)[:, None])


class _Sums:
    """Manhattan: elements are rounded to seven bits, whose absolute differences are summed up in bytes and then in 16 bits. What rounding took away is bounded by its own sums."""

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        low, high = min(q.min(initial=np.inf), x.min(initial=np.inf)), max(q.max(initial=-np.inf), x.max(initial=-np.inf))
        self.unit = (high - low) / 127 or 1.0
        cut = [np.rint((v - low) / self.unit) for v in (q, x)]
        lost = [np.abs((v - low) / self.unit - y).sum(1) for v, y in zip((q, x), cut)]
        self.lost = (lost[0] + lost[1].max(initial=0.0)) * (1 + 1e-6) + 1e-6
        self.q, self.x = (np.pad(y.astype(np.uint8), ((0, 0), (0, y.shape[1] % 2))) for y in cut)
        self.x = np.ascontiguousarray(self.x.T)
        self.kept: tuple = (None, None, None)

    def may(self, r: slice, c: slice, most: np.ndarray) -> np.ndarray:
        if self.kept[0] != (c.start, c.stop):  # the columns' first half in the low bytes, the second in the high ones
            x = np.pad(self.x[:, c], ((0, 0), (0, (c.stop - c.start) % 2)))
            x = np.ascontiguousarray(x.reshape(len(x), 2, -1).swapaxes(1, 2)).reshape(len(x), -1)
            self.kept = ((c.start, c.stop), x, (np.empty_like(x), np.empty_like(x)))
        _, x, (a, b) = self.kept
        n, half, middle, found = c.stop - c.start, len(x) // 2, x.shape[1] // 2, []
        limit = np.minimum(most * (1 + 1e-6) / self.unit + self.lost[r], 65535).astype(np.uint16)
        total = np.empty(x.shape[1], np.uint16)
        wide = np.empty((half, middle), np.uint16)
        for k, (row, least) in enumerate(zip(self.q[r], limit)):
            row = row[:, None]
            np.maximum(x, row, out=a)
            np.minimum(x, row, out=b)
            np.subtract(a, b, out=a)
            pairs = np.add(a[:half], a[half:], out=b[:half]).view(np.uint16)
            np.add.reduce(np.bitwise_and(pairs, 255, out=wide), axis=0, out=total[:middle])
            np.add.reduce(np.right_shift(pairs, 8, out=wide), axis=0, out=total[middle:])
            at = (total[:n] <= least).nonzero()[0]
            if len(at):
                found.append(k * n + at)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class _Plain:
    """Manhattan in so few or so many elements that bytes don't help."""

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        self.q, self.x = q, np.ascontiguousarray(x.T)

    def may(self, r: slice, c: slice, most: np.ndarray) -> np.ndarray:
        q, total = self.q[r], np.zeros((r.stop - r.start, c.stop - c.start))
        for k, x in enumerate(self.x[:, c]):
            total += np.abs(q[:, k, None] - x)
        return np.flatnonzero(total <= (most * (1 + 1e-9))[:, None])


class _Bits:
    """Hamming: those bits that differ anywhere, packed into words, are counted. The result is the distance itself."""

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        q, x = q.astype(np.int64), x.astype(np.int64)
        first = (q if len(q) else x)[:1]
        varies = np.bitwise_or.reduce(np.concatenate([q ^ first, x ^ first]), axis=0).view(np.uint64) if len(first) else np.zeros(q.shape[1], np.uint64)
        if np.bitwise_count(varies).sum() < 8 * len(varies):
            at = [(k, b) for k in np.flatnonzero(varies) for b in range(64) if int(varies[k]) >> b & 1]
            bits = lambda v: np.stack([(v[:, k] >> b & 1).astype(np.uint8) for k, b in at] or [np.zeros(len(v), np.uint8)], 1)
            q, x = (np.packbits(np.pad(y := bits(v), ((0, 0), (0, -y.shape[1] % 64))), axis=1) for v in (q, x))
        self.q, self.x = np.ascontiguousarray(q).view(np.uint64), np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint64).T)

    def may(self, r: slice, c: slice, most: np.ndarray) -> np.ndarray:
        n, found, words = c.stop - c.start, [], self.x[:, c]
        a, b = np.empty(n, np.uint64), np.empty(n, np.uint8)
        for k, (row, least) in enumerate(zip(self.q[r], np.minimum(most, 1 << 30).astype(np.int64))):
            total = np.bitwise_count(np.bitwise_xor(words[0], row[0], out=a), out=b)
            if len(words) > 1:
                total = total.astype(np.int32)
                for w, y in zip(words[1:], row[1:]):
                    total += np.bitwise_count(w ^ y)
            at = (total <= (np.uint8(min(least, 255)) if total is b else least)).nonzero()[0]
            if len(at):
                found.append(k * n + at)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _bound(q: np.ndarray, x: np.ndarray, metric: str):
    if metric == "manhattan":
        return (_Sums if 8 <= x.shape[1] <= 256 else _Plain)(q, x, metric)
    return (_Bits if metric == "hamming" else _Products)(q, x, metric)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Less than the distance of each row to any point of the box, by a little for rounding; 0 for metrics that boxes don't bound."""
    if metric not in ("euclidean", "manhattan"):
        return np.zeros(len(q))
    out = np.maximum(np.maximum(low - q, q - high), 0)
    return (np.sqrt((out * out).sum(1)) if metric == "euclidean" else out.sum(1)) * (1 - 1e-9)


class Nearest:
    """The k nearest of every row by (distance, id) among all that was added, itself excluded. Of no id more than once may be added."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        self.ids, self.x, self.k, self.metric = ids, x, k, metric
        self.dist, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), NOBODY)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        rows = np.flatnonzero(box_distance(self.x, x.min(0), x.max(0), self.metric) <= self.dist[:, -1])
        bound = _bound(self.x[rows], x, self.metric)
        for at in range(0, len(rows), ROWS):
            mine, r, start = rows[at : at + ROWS], slice(at, min(at + ROWS, len(rows))), 0
            step = COLUMNS if np.isfinite(self.dist[mine, -1]).all() else FIRST
            while start < len(ids):  # the columns looked at double as long as the bounds are young
                c = slice(start, min(start + step, len(ids)))
                flat = bound.may(r, c, self.dist[mine, -1])
                row, column = np.divmod(flat, c.stop - c.start)
                for p in range(0, len(flat), PAIRS):
                    self._take(mine[row[p : p + PAIRS]], ids, x, start + column[p : p + PAIRS])
                start, step = c.stop, min(COLUMNS, max(step, c.stop))

    def _take(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, column: np.ndarray) -> None:
        d, other = pair_distances(self.x[row], x[column], self.metric), ids[column]
        last, held = self.dist[row, -1], self.near[row, -1]
        ok = (other != self.ids[row]) & np.isfinite(d) & ((d < last) | ((d == last) & (other < held)))
        row, d, other = row[ok], d[ok], other[ok]
        if not len(row):
            return
        seen = np.unique(row)
        row, d, other = np.concatenate([np.repeat(seen, self.k), row]), np.concatenate([self.dist[seen].ravel(), d]), np.concatenate([self.near[seen].ravel(), other])
        order = np.lexsort((other, d, row))
        row = row[order]
        begin = np.searchsorted(row, seen)
        take = order[(begin[:, None] + np.arange(self.k)).ravel()]
        self.dist[seen], self.near[seen] = d[take].reshape(-1, self.k), other[take].reshape(-1, self.k)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(src, dst, rank, dist), some rows at a time."""
        for at in range(0, len(self.ids), max(1, 200_000 // self.k)):
            d, near = (y[at : at + max(1, 200_000 // self.k)] for y in (self.dist, self.near))
            ok = np.isfinite(d)
            rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), d.shape)
            yield np.repeat(self.ids[at : at + len(d)], self.k)[ok.ravel()], near[ok], rank[ok], d[ok]
