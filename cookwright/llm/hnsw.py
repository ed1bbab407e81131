"""A hierarchical navigable small-world graph over unit vectors, kept in flat neighbour arrays.

Points are inserted and queries answered in batches: all queries of a batch take a step of their search at once, so
that the work is in array operations.
"""

from __future__ import annotations

import numpy as np


class Graph:
    """Neighbour arrays by level: row i of level 0 has the neighbours of point i, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, m: int = 10, ef: int = 32, seed: int = 5) -> None:
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.m, self.ef = m, ef
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(m)).astype(int), 6) if n else np.zeros(0, dtype=int)
        order = np.argsort(-level, kind="stable")  # the highest first: the entry point stays the same
        self.level, self.entry = level, int(order[0]) if n else -1
        top = int(level.max()) if n else 0
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(top + 1)]
        done = 0
        while done < n:
            size = min(256, max(1, done // 2), n - done)
            self._insert(order[done : done + size], done > 0)
            done += size

    def _insert(self, new: np.ndarray, some: bool) -> None:
        q = self.x[new]
        entry = np.full((len(new), 1), self.entry, dtype=np.int64)
        own = q @ q.T
        np.fill_diagonal(own, -2)
        for k in range(len(self.links) - 1, -1, -1):
            here = self.level[new] >= k
            if some:
                ids, sims = self._search_level(q, entry, k, self.ef if here.any() else 1)
                entry = ids[:, :1]
                if not here.any():
                    continue
            else:
                ids, sims = np.full((len(new), 1), -1, dtype=np.int64), np.full((len(new), 1), -2.0, dtype=np.float32)
            # points of the same batch are candidates too
            mates = np.where(here[None, :], own, -2)
            take = min(self.m, len(new))
            near = np.argpartition(-mates, take - 1, axis=1)[:, :take]
            ids = np.concatenate([np.where(sims > -2, ids, -1), np.where(np.take_along_axis(mates, near, 1) > -2, new[near], -1)], axis=1)[here]
            sims = np.concatenate([sims, np.take_along_axis(mates, near, 1).astype(np.float32)], axis=1)[here]
            at = np.argsort(-sims, axis=1, kind="stable")[:, : self.ef]
            self._link(new[here], np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1), k)

    def _choose(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Of each row's candidates, by similarity, up to m that are nearer to the point than to one another; then the nearest."""
        v = self.x[np.maximum(ids, 0)]
        among = np.matmul(v, v.transpose(0, 2, 1))
        b, c = ids.shape
        kept, closest, n = np.zeros((b, c), dtype=bool), np.full((b, c), -2.0, dtype=np.float32), np.zeros(b, dtype=int)
        for j in range(c):
            good = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (n < self.m)
            kept[:, j] = good
            n += good
            np.maximum(closest, np.where(good[:, None], among[:, j, :], -2), out=closest)
        for j in range(c):
            more = (ids[:, j] >= 0) & ~kept[:, j] & (n < self.m)
            kept[:, j] |= more
            n += more
        return kept

    def _link(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> None:
        links = self.links[k]
        kept = self._choose(ids, sims)
        i, j = np.nonzero(kept)
        src, dst, sim = points[i], ids[i, j], sims[i, j]
        # both directions, with what the points at the other end have already
        ends = np.unique(dst)
        old = links[ends]
        r, c = np.nonzero(old >= 0)
        a = np.concatenate([src, dst, ends[r]])
        b = np.concatenate([dst, src, old[r, c]])
        s = np.concatenate([sim, sim, np.einsum("ij,ij->i", self.x[ends[r]], self.x[old[r, c]])])
        _, first = np.unique(a.astype(np.int64) * len(self.x) + b, return_index=True)
        a, b, s = a[first], b[first], s[first]
        order = np.lexsort((-s, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        ok = rank < links.shape[1]
        touched = np.unique(a)
        links[touched] = -1
        links[a[ok], rank[ok]] = b[ok]

    def _search_level(self, q: np.ndarray, entry: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest points that a best-first walk over level k meets, the nearest first; -2 pads similarities."""
        links, n, b = self.links[k], len(self.x), len(q)
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True
        rows = np.arange(b)
        ids = np.full((b, ef), n, dtype=np.int64)
        sims = np.full((b, ef), -2.0, dtype=np.float32)
        open_ = np.zeros((b, ef), dtype=bool)
        e = entry[:, : min(ef, entry.shape[1])]
        ids[:, : e.shape[1]], open_[:, : e.shape[1]] = e, True
        sims[:, : e.shape[1]] = np.einsum("bmd,bd->bm", self.x[e], q)
        seen[rows[:, None], e] = True
        active = rows
        while len(active):
            frontier = np.where(open_[active], sims[active], -3)
            best = frontier.argmax(axis=1)
            going = frontier[np.arange(len(active)), best] > -2.5
            active, best = active[going], best[going]
            if not len(active):
                break
            open_[active, best] = False
            near = links[ids[active, best]].astype(np.int64)
            near[near < 0] = n
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            s = np.einsum("bmd,bd->bm", self.x[np.where(fresh, near, 0)], q[active])
            s[~fresh] = -2
            all_s = np.concatenate([sims[active], s], axis=1)
            all_i = np.concatenate([ids[active], near], axis=1)
            all_o = np.concatenate([open_[active], fresh], axis=1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[active] = np.take_along_axis(all_s, top, 1)
            ids[active] = np.take_along_axis(all_i, top, 1)
            open_[active] = np.take_along_axis(all_o, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(ids == n, 0, ids), sims

    def search(self, q: np.ndarray, k: int, ef: int | None = None, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """For each query the positions and similarities of its k nearest points found; -2 pads similarities."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        ef = max(k, ef or self.ef)
        out_i, out_s = np.zeros((len(q), k), dtype=np.int64), np.full((len(q), k), -2.0, dtype=np.float32)
        if not len(self.x):
            return out_i, out_s
        for at in range(0, len(q), batch):
            part = q[at : at + batch]
            entry = np.full((len(part), 1), self.entry, dtype=np.int64)
            for level in range(len(self.links) - 1, 0, -1):
                entry = self._search_level(part, entry, level, 1)[0][:, :1]
            ids, sims = self._search_level(part, entry, 0, ef)
            out_i[at : at + batch], out_s[at : at + batch] = ids[:, :k], sims[:, :k]
        return out_i, out_s
