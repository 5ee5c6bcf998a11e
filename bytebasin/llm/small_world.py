"""A hierarchical navigable small-world graph over unit vectors, built and searched many vectors at a time in NumPy.

Level 0 holds all vectors; a vector is on each further level with probability 1 / ``links``. A beam search keeps, for
each query, the best vectors seen; it follows the links of the best ones not yet followed, until those of the whole beam
have been.
"""

from __future__ import annotations

import numpy as np

#: Links of a vector on an upper level; twice as many on level 0.
LINKS = 24
#: Width of the beam that looks for a new vector's links.
BUILD_BEAM = 64
#: Vectors inserted, or sought, at a time, and numbers in all of them; vectors of many dimensions go fewer at a time.
BATCH, NUMBERS = 256, 1 << 14
#: Vectors in the beams of a search at a time.
WIDE = 1 << 21
#: Beam vectors whose links are followed at a time.
FOLLOW = 2


class SmallWorld:
    def __init__(self, vectors: np.ndarray, links: int = LINKS, seed: int = 7):
        self.vectors, self.links = np.ascontiguousarray(vectors, np.float32), links
        self.batch = max(8, min(BATCH, NUMBERS // max(1, vectors.shape[1])))
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.height = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(links)).astype(np.int64), 6)
        self.graph = [np.full((n, 2 * links if level == 0 else links), -1, np.int32) for level in range(int(self.height.max(initial=0)) + 1)]
        self.entries = [np.zeros(0, np.int32) for _ in self.graph]

    @classmethod
    def built(cls, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7) -> SmallWorld:
        world = cls(vectors, links, seed)
        done = 0
        while done < len(vectors):
            size = min(world.batch, max(64, done), len(vectors) - done)
            world._insert(np.arange(done, done + size), beam)
            done += size
        return world

    @classmethod
    def restored(cls, vectors: np.ndarray, graph: list[np.ndarray], entries: list[np.ndarray], links: int) -> SmallWorld:
        world = cls.__new__(cls)
        world.vectors, world.graph, world.entries, world.links = np.ascontiguousarray(vectors, np.float32), graph, entries, links
        world.batch = max(8, min(BATCH, NUMBERS // max(1, vectors.shape[1])))
        return world

    def _insert(self, new: np.ndarray, beam: int) -> None:
        queries = self.vectors[new]
        among = queries @ queries.T
        np.fill_diagonal(among, -2)
        start = np.zeros((len(new), 0), np.int32)
        for level in range(len(self.graph) - 1, -1, -1):
            if len(self.entries[level]):
                ids, sims = self._beam(level, queries, self._with_entries(level, start), beam)
                start = ids[:, :8]
            else:
                ids, sims = np.zeros((len(new), 0), np.int32), np.zeros((len(new), 0), np.float32)
            mine = np.flatnonzero(self.height[new] >= level)
            if not len(mine):
                continue
            # of the vectors inserted together those on this level are known to one another
            near = np.argsort(-among[mine][:, mine], axis=1)[:, :beam]
            ids = np.hstack([ids[mine], new[mine][near].astype(np.int32)])
            sims = np.hstack([sims[mine], np.take_along_axis(among[mine][:, mine], near, axis=1)])
            self._connect(level, new[mine], ids, sims)
            if len(self.entries[level]) < 4:
                self.entries[level] = np.concatenate([self.entries[level], new[mine].astype(np.int32)])[:4]

    def _with_entries(self, level: int, start: np.ndarray) -> np.ndarray:
        return np.hstack([start, np.broadcast_to(self.entries[level], (len(start), len(self.entries[level])))])

    def _spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row up to ``most`` of its candidates: those nearer to the vector than to any that it already has,
        then the nearest of the rest."""
        order = np.argsort(-np.where(ids < 0, -3, sims), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        rows, width = ids.shape
        there = self.vectors[np.maximum(ids, 0)]
        between = there @ there.transpose(0, 2, 1)
        chosen = np.zeros((rows, width), bool)
        nearest = np.full((rows, width), -3, np.float32)  # similarity of each candidate to the nearest chosen one
        count = np.zeros(rows, np.int64)
        for j in range(width):
            take = (ids[:, j] >= 0) & (nearest[:, j] < sims[:, j]) & (count < most)
            chosen[:, j] = take
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
        rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, rank, axis=1)

    def _connect(self, level: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        table = self.graph[level]
        ids = np.where(sims <= -1.5, -1, ids)
        picked = self._spread(ids, sims, self.links)
        table[new, : picked.shape[1]] = picked
        # links back; a vector with too many keeps those that spread best
        source, target = np.repeat(new, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        held, first, times = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, times)
        width = table.shape[1]
        more = np.full((len(held), int(times.max(initial=0))), -1, np.int32)
        more[np.repeat(np.arange(len(held)), times), place] = source
        both = np.hstack([table[held], more])
        # a link that is there from either side counts once
        order = np.argsort(both, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(both, order, axis=1)
        sorted_ids[:, 1:][sorted_ids[:, 1:] == sorted_ids[:, :-1]] = -1
        full = (sorted_ids >= 0).sum(axis=1) > width
        packed = -np.sort(-sorted_ids, axis=1)
        table[held[~full]] = np.pad(packed[~full], ((0, 0), (0, max(0, width - packed.shape[1]))), constant_values=-1)[:, :width]
        crowded = np.flatnonzero(full)
        for lo in range(0, len(crowded), self.batch):
            at = crowded[lo : lo + self.batch]
            cand = packed[at]
            near = np.einsum("rd,rcd->rc", self.vectors[held[at]], self.vectors[np.maximum(cand, 0)])
            table[held[at]] = self._spread(cand, near, width)

    def _beam(self, level: int, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` vectors that each query meets on a level, best first; -1 and -2 where there are fewer."""
        table, n = self.graph[level], len(queries)
        seen = np.zeros((n, len(self.vectors) + 1), bool)
        seen[:, -1] = True
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        followed = np.ones((n, beam), bool)
        fresh, live = start, np.arange(n)
        while len(live):
            fresh = np.where(seen[live[:, None], fresh], -1, fresh)
            # an id that came twice counts once
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[live[:, None], fresh] = True
            near = np.matmul(self.vectors[fresh], queries[live][:, :, None])[:, :, 0]
            near[fresh < 0] = -2
            all_ids, all_sims = np.hstack([ids[live], fresh]), np.hstack([sims[live], near])
            all_followed = np.hstack([followed[live], fresh < 0])
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_sims, best, axis=1)
            followed[live] = np.take_along_axis(all_followed, best, axis=1)
            live = live[~followed[live].all(axis=1)]
            if not len(live):
                break
            # the best that are not yet followed, a few at a time
            at = np.argsort(followed[live], axis=1, kind="stable")[:, :FOLLOW]
            open_ = ~np.take_along_axis(followed[live], at, axis=1)
            followed[live[:, None], at] = True
            nodes = np.take_along_axis(ids[live], at, axis=1)
            fresh = np.where(open_[:, :, None], table[nodes], -1).reshape(len(live), -1)
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the best ``beam`` vectors found for each query, best first."""
        queries = np.ascontiguousarray(queries, np.float32)
        found = []
        size = max(8, min(self.batch, WIDE // max(1, beam)))
        for lo in range(0, len(queries), size):
            part = queries[lo : lo + size]
            start = np.zeros((len(part), 0), np.int32)
            for level in range(len(self.graph) - 1, 0, -1):
                if len(self.entries[level]):
                    start = self._beam(level, part, self._with_entries(level, start), 8)[0]
            found.append(self._beam(0, part, self._with_entries(0, start), beam))
        return np.vstack([i for i, _ in found]), np.vstack([s for _, s in found])
