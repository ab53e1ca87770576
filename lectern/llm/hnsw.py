"""A hierarchical navigable small-world graph over unit vectors, built and searched in whole arrays."""

from __future__ import annotations

import numpy as np

#: Neighbours of a node above the ground layer (twice as many on it), beam while building, searches at a time.
NEIGHBOURS, BUILD_BEAM, AT_ONCE = 16, 64, 256
#: Nodes of a beam that a step expands together.
EXPAND = 4


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those that are closer to the row's node than to any chosen one,
    then the best of the others, up to ``most``; -1 for none."""
    rows, n = ids.shape
    some = vectors[ids]
    between = some @ some.transpose(0, 2, 1)
    chosen = np.zeros((rows, n), bool)
    closest = np.full((rows, n), -np.inf, np.float32)
    for k in range(n):
        take = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (chosen.sum(axis=1) < most)
        chosen[:, k] = take
        np.maximum(closest, between[:, k, :], out=closest, where=take[:, None])
    order = np.argsort(np.where(chosen, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


class Graph:
    """Layers share one numbering: a layer's nodes are the first of it, as nodes of higher layers come first."""

    def __init__(self, vectors: np.ndarray, seed: int = 42):
        n = len(vectors)
        levels = np.floor(np.random.default_rng(seed).exponential(1 / np.log(NEIGHBOURS), n)).astype(int)
        self.order = np.argsort(-levels, kind="stable")
        self.vectors = np.ascontiguousarray(vectors[self.order], np.float32)
        self.sizes = [int((levels >= level).sum()) for level in range(levels.max(initial=0) + 1)]
        self.layers: list[np.ndarray] = [None] * len(self.sizes)
        for level in reversed(range(len(self.sizes))):
            self._build(level)

    def _build(self, level: int) -> None:
        size, most = self.sizes[level], NEIGHBOURS * (2 if level == 0 else 1)
        links = self.layers[level] = np.full((size, most), -1, np.int32)
        above = self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
        at = 0
        while at < size:
            wave = np.arange(at, min(size, at + max(32, min(AT_ONCE, at // 2))))
            own = self.vectors[wave]
            peers = own @ own.T
            np.fill_diagonal(peers, -np.inf)
            ids, sims = np.broadcast_to(wave, peers.shape).astype(np.int32), peers
            if at:
                entry = self._descend(own, level + 1) if above and at >= above else np.zeros((len(wave), 1), np.int32)
                found, found_sims = self._beam(links, at, own, entry, BUILD_BEAM)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, found_sims], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            picked = _diverse(self.vectors, ids, sims, most)
            links[wave] = picked
            self._back(links, wave, picked)
            at += len(wave)

    def _back(self, links: np.ndarray, wave: np.ndarray, picked: np.ndarray) -> None:
        """Enter the new nodes as neighbours of the nodes they have picked."""
        most = links.shape[1]
        new, old = np.repeat(wave, picked.shape[1]), picked.ravel()
        new, old = new[old >= 0], old[old >= 0]
        already = (links[old] == new[:, None]).any(axis=1)
        new, old = new[~already], old[~already]
        sims = np.einsum("ij,ij->i", self.vectors[new], self.vectors[old])
        order = np.lexsort((-sims, old))
        new, old = new[order], old[order]
        touched, first, count = np.unique(old, return_index=True, return_counts=True)
        rank = np.arange(len(old)) - np.repeat(first, count)
        extra = np.full((len(touched), most), -1, np.int32)
        keep = rank < most
        extra[np.repeat(np.arange(len(touched)), count)[keep], rank[keep]] = new[keep]
        for low in range(0, len(touched), AT_ONCE):
            nodes = touched[low : low + AT_ONCE]
            ids = np.concatenate([links[nodes], extra[low : low + AT_ONCE]], axis=1)
            sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", self.vectors[ids], self.vectors[nodes]), -np.inf).astype(np.float32)
            best = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
            full = (ids >= 0).sum(axis=1) > most
            links[nodes[~full]] = ids[~full, :most]
            if full.any():
                links[nodes[full]] = _diverse(self.vectors, ids[full], sims[full], most)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entry points for the layer under ``to``: the best nodes found from the top layer down to ``to``."""
        entry = np.zeros((len(queries), 1), np.int32)
        for level in reversed(range(to, len(self.sizes))):
            entry = self._beam(self.layers[level], self.sizes[level], queries, entry, 4)[0]
        return entry

    def _beam(self, links: np.ndarray, size: int, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes that each query reaches (best first, -1 for none) and their similarities."""
        rows = len(queries)
        ids = np.full((rows, beam), -1, np.int32)
        sims = np.full((rows, beam), -np.inf, np.float32)
        open_ = np.zeros((rows, beam), bool)
        seen = np.zeros(rows * size, bool)
        q, new = np.repeat(np.arange(rows), entry.shape[1]), entry.ravel()
        while True:
            code = np.unique(q[new >= 0] * size + new[new >= 0])
            code = code[~seen[code]]
            if len(code):
                seen[code] = True
                q, new = code // size, (code % size).astype(np.int32)
                fresh = np.einsum("ij,ij->i", self.vectors[new], queries[q])
                who, first, count = np.unique(q, return_index=True, return_counts=True)
                place = np.arange(len(q)) - np.repeat(first, count)
                row = np.repeat(np.arange(len(who)), count)
                width = int(count.max())
                more_ids = np.full((len(who), width), -1, np.int32)
                more_sims = np.full((len(who), width), -np.inf, np.float32)
                more_ids[row, place], more_sims[row, place] = new, fresh
                all_ids = np.concatenate([ids[who], more_ids], axis=1)
                all_sims = np.concatenate([sims[who], more_sims], axis=1)
                all_open = np.concatenate([open_[who], more_ids >= 0], axis=1)
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[who], sims[who] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_sims, best, axis=1)
                open_[who] = np.take_along_axis(all_open, best, axis=1)
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return ids, sims
            turn = open_[active] & (np.cumsum(open_[active], axis=1) <= EXPAND)
            at, slot = np.nonzero(turn)
            q = active[at]
            nodes = ids[q, slot]
            open_[q, slot] = False
            q, new = np.repeat(q, links.shape[1]), links[nodes].ravel()

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes of each query, as positions in the vectors given (-1 for none), and their similarities."""
        at_once = max(16, min(AT_ONCE, (1 << 25) // max(1, len(self.vectors))))
        ids, sims = [], []
        for low in range(0, len(queries), at_once):
            some = np.ascontiguousarray(queries[low : low + at_once], np.float32)
            i, s = self._beam(self.layers[0], self.sizes[0], some, self._descend(some, 1), beam)
            ids.append(np.where(i >= 0, self.order[i], -1))
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)
