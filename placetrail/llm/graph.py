"""A robust-pruned directed graph over the vectors of one shard, built and searched for whole blocks of rows at once.

Vectors enter in growing batches. Each batch searches the graph of the vectors before it with a beam; what the beams
saw, and the nearest vectors of the batch itself, are pruned: a candidate is dropped when a kept neighbour is, by the
factor alpha, nearer to it than the vector is, so the edges kept point in different directions. Edges back are added
and pruned where a vector has too many.
"""

from __future__ import annotations

import numpy as np

BATCH = 512


class Graph:
    def __init__(
        self, x: np.ndarray, degree: int = 24, beam: int = 32, alpha: float = 1.05, refine: bool = False, entry_part: int = 8,
        seed: int = 5, reach: float = np.inf, patience: int = 8,
    ):
        self.x = np.ascontiguousarray(x, np.float32)
        self.reach2, self.patience = reach * reach, patience
        self.n, self.degree, self.beam, self.alpha2 = len(x), degree, beam, alpha * alpha
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.out = np.full((self.n, degree), -1, np.int32)
        self.entry = np.zeros(0, np.int32)
        order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        done = 0
        while done < self.n:
            size = min(BATCH, max(64, done), self.n - done)
            self._insert(order[done : done + size])
            done += size
            self.entry = order[: max(min(done, 48), done // entry_part)]
        if refine:
            for s in range(0, self.n, BATCH):
                self._insert(order[s : s + BATCH])

    def state(self) -> dict[str, bytes]:
        """What ``restored`` needs besides the settings."""
        return {"x": self.x.tobytes(), "out": self.out.tobytes(), "entry": self.entry.tobytes()}

    @classmethod
    def restored(cls, state: dict[str, bytes], width: int, **settings) -> Graph:
        g = cls(np.zeros((0, width), np.float32), **settings)
        g.x = np.frombuffer(state["x"], np.float32).reshape(-1, width)
        g.n, g.square = len(g.x), np.einsum("ij,ij->i", g.x, g.x)
        g.out, g.entry = np.frombuffer(state["out"], np.int32).reshape(g.n, -1), np.frombuffer(state["entry"], np.int32)
        return g

    def _dist(self, q: np.ndarray, q_square: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each row of q to its own list of ids (-1: infinite)."""
        d = q_square[:, None] + self.square[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]
        return np.where(ids < 0, np.inf, np.maximum(d, 0)).astype(np.float32)

    def search(self, q: np.ndarray, start: np.ndarray | None = None, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query: ids (-1 where there are fewer) and squared distances, the nearest first.

        After ``patience`` steps only vectors within ``reach`` of the query are still walked from.
        """
        width = width or self.beam
        q = np.ascontiguousarray(q, np.float32)
        qq = np.einsum("ij,ij->i", q, q)
        d = qq[:, None] + self.square[self.entry][None] - 2 * (q @ self.x[self.entry].T)
        first = np.argpartition(d, 2, axis=1)[:, :3] if d.shape[1] > 3 else np.argsort(d, axis=1)
        ids = np.full((len(q), width), -1, np.int32)
        ids[:, : first.shape[1]] = self.entry[first]
        if start is not None:
            ids[:, 3] = np.where((ids[:, :3] == start[:, None]).any(axis=1), -1, start)
        dist = self._dist(q, qq, ids)
        open_ = ids >= 0
        live, steps = np.arange(len(q)), 0
        while len(live):
            o = np.where(open_[live], dist[live], np.inf)
            if steps >= self.patience:
                o[o > self.reach2] = np.inf
            steps += 1
            pick = o.argmin(axis=1)
            go = np.isfinite(o[np.arange(len(live)), pick])
            live, pick = live[go], pick[go]
            if not len(live):
                break
            open_[live, pick] = False
            new = self.out[ids[live, pick]]
            new = np.where((new[:, :, None] == ids[live][:, None, :]).any(axis=2), -1, new)
            nd = self._dist(q[live], qq[live], new)
            worst = dist[live, -1]
            useful = (nd < worst[:, None]).any(axis=1)
            if not useful.any():
                continue
            rows = live[useful]
            all_ids = np.concatenate([ids[rows], new[useful]], axis=1)
            all_d = np.concatenate([dist[rows], nd[useful]], axis=1)
            all_open = np.concatenate([open_[rows], new[useful] >= 0], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids[rows] = np.take_along_axis(all_ids, best, axis=1)
            dist[rows] = np.take_along_axis(all_d, best, axis=1)
            open_[rows] = np.take_along_axis(all_open, best, axis=1) & np.isfinite(dist[rows])
        return ids, dist

    def _prune(self, ids: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The diverse neighbours among each row's candidates (-1 padded, no candidate twice)."""
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        v = self.x[ids]
        s = self.square[ids]
        between = s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(dist)
        rows = np.arange(len(ids))
        kept = np.full((len(ids), self.degree), -1, np.int32)
        for k in range(self.degree):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[:, k] = np.where(some, ids[rows, pick], -1)
            alive &= ~(self.alpha2 * np.maximum(between[rows, pick], 0) <= dist) | ~some[:, None]
            alive[rows, pick] = False
        return kept

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        near = self.square[new][:, None] + self.square[new][None] - 2 * (q @ q.T)
        np.fill_diagonal(near, np.inf)
        mates = min(8 if len(self.entry) else self.beam, len(new) - 1)
        if mates > 0:
            at = np.argpartition(near, mates - 1, axis=1)[:, :mates]
            ids, dist = new[at], np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float32)
        else:
            ids, dist = np.zeros((len(new), 0), np.int32), np.zeros((len(new), 0), np.float32)
        if len(self.entry):
            old = self.out[new] if (self.out[new, 0] >= 0).any() else None
            seen, seen_d = self.search(q, new if old is not None else None)
            for more in (seen, old) if old is not None else (seen,):
                more = np.where((more[:, :, None] == ids[:, None, :]).any(axis=2) | (more == new[:, None]), -1, more)
                ids = np.concatenate([ids, more], axis=1)
                dist = np.concatenate([dist, self._dist(q, self.square[new], more)], axis=1)
        if ids.shape[1] == 0:
            return
        self.out[new] = self._prune(ids, dist)
        to = self.out[new].ravel()
        source = np.repeat(new, self.degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        node, begin, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(begin, count)
        room = int(min(count.max(), 2 * self.degree)) if len(count) else 0
        back = np.full((len(node), room), -1, np.int32)
        fits = place < room
        back[np.repeat(np.arange(len(node)), count)[fits], place[fits]] = source[fits]
        own = self.out[node]
        back = np.where((back[:, :, None] == own[:, None, :]).any(axis=2), -1, back)
        both = np.concatenate([own, back], axis=1)
        full = (both >= 0).sum(axis=1) > self.degree
        easy = ~full
        if easy.any():
            packed = np.take_along_axis(both[easy], np.argsort(both[easy] < 0, axis=1, kind="stable"), axis=1)
            self.out[node[easy]] = packed[:, : self.degree]
        for s in range(0, int(full.sum()), 2048):
            at = np.flatnonzero(full)[s : s + 2048]
            d = self._dist(self.x[node[at]], self.square[node[at]], both[at])
            self.out[node[at]] = self._prune(both[at], d)
