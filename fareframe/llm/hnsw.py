"""Hierarchical navigable small-world graphs in numpy: built and searched many queries at a time."""

from __future__ import annotations

import numpy as np

DEGREE = 16  # links a node chooses; the base layer keeps twice as many
BUILD_BEAM = 64
EXPAND = 4  # nodes a query opens per step
QUERIES = 256  # searched in step
PIECE_BYTES = 1 << 20  # of vectors gathered at a time


def _dots(x: np.ndarray, a: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows ``a`` of ``x`` with the rows ``b`` of ``q``, gathered in pieces of bounded bytes."""
    out = np.empty(len(a), np.float32)
    step = max(1, PIECE_BYTES // (x.shape[1] * 4))
    for lo in range(0, len(a), step):
        np.einsum("ij,ij->i", x.take(a[lo : lo + step], axis=0), q.take(b[lo : lo + step], axis=0), out=out[lo : lo + step])
    return out


def search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for each query, best first, and their similarities; node len(x) - 1 is padding.

    ``x`` ends with a row of zeros, to which missing links point. Each query opens its best unopened nodes until all
    in its beam are open. Queries that are done drop out of the step.
    """
    pad = len(x) - 1
    seen = np.zeros(len(q) * len(x), bool)  # a run of len(x) for each query
    seen[pad :: len(x)] = True
    ids = np.full((len(q), beam), pad)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    opened = np.ones((len(q), beam), bool)
    nodes = entry
    live = np.arange(len(q))
    while len(live):
        nodes = np.sort(nodes, axis=1)
        place = nodes + (live * len(x))[:, None]
        new = ~seen.take(place)
        new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        at = np.flatnonzero(new)
        seen[place.take(at)] = True
        s = np.full(nodes.size, -np.inf, np.float32)
        s[at] = _dots(x, nodes.take(at), q, live.take(at // nodes.shape[1]))
        s = s.reshape(nodes.shape)
        all_s = np.concatenate([sims[live], s], axis=1)
        all_i = np.concatenate([ids[live], nodes], axis=1)
        all_o = np.concatenate([opened[live], ~new], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live] = np.take_along_axis(all_s, top, axis=1)
        ids[live] = np.take_along_axis(all_i, top, axis=1)
        opened[live] = np.take_along_axis(all_o, top, axis=1)
        waiting = np.where(opened[live], -np.inf, sims[live])
        k = min(EXPAND, beam)
        pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
        good = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        some = good.any(axis=1)
        live, pick, good = live[some], pick[some], good[some]
        opened[live[:, None], pick] = True
        nodes = links[np.where(good, np.take_along_axis(ids[live], pick, axis=1), pad)].reshape(len(live), k * links.shape[1])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def _choose(x: np.ndarray, node: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each node's candidates (rows of ids, padded): first those that are nearer to the node than to
    any chosen so far, so that links lead into all directions, then the nearest others."""
    step = max(1, 8 * PIECE_BYTES // (cand.shape[1] * x.shape[1] * 4))  # the candidates' vectors are gathered
    return np.concatenate([_chosen(x, node[lo : lo + step], cand[lo : lo + step], keep) for lo in range(0, max(1, len(node)), step)])


def _chosen(x: np.ndarray, node: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    pad = len(x) - 1
    sims = np.einsum("bd,bcd->bc", x[node], x[cand])
    sims[(cand == pad) | (cand == node[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sims, order, axis=1)
    twice = np.zeros(cand.shape, bool)
    twice[:, 1:] = (cand[:, 1:] == cand[:, :-1]) & (sims[:, 1:] > -np.inf)
    sims[twice] = -np.inf
    vectors = x[cand]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    usable = sims > -np.inf
    first = np.zeros(cand.shape, bool)
    nearest = np.full(cand.shape, -np.inf, np.float32)  # similarity to the nearest chosen
    for c in range(cand.shape[1]):
        take = usable[:, c] & (sims[:, c] > nearest[:, c]) & (first.sum(axis=1) < keep)
        first[:, c] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, c]), nearest)
    rank = np.argsort(np.where(first, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.where(np.take_along_axis(usable, rank, axis=1), np.take_along_axis(cand, rank, axis=1), pad)
    if out.shape[1] < keep:
        out = np.concatenate([out, np.full((len(out), keep - out.shape[1]), pad)], axis=1)
    return out


class Graph:
    """Layers of links over unit vectors. Node heights come from the vectors' order, which must be random."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.n = len(vectors)
        self.x = np.concatenate([vectors.astype(np.float32), np.zeros((1, vectors.shape[1]), np.float32)])
        self.layers, self.entry = layers or [], entry
        if layers is None:
            self._build()

    def _build(self) -> None:
        rng = np.random.default_rng(self.n)
        height = np.minimum((-np.log(1 - rng.random(self.n)) / np.log(DEGREE)).astype(int), 6)
        pad = self.n
        self.layers = [np.full((self.n + 1, DEGREE * (1 if k else 2)), pad, np.int32) for k in range(int(height.max(initial=0)) + 1)]
        top = int(height[0]) if self.n else 0
        done = 1
        while done < self.n:
            size = min(QUERIES, max(1, done // 2), self.n - done)
            batch = np.arange(done, done + size)
            enter = np.full((size, 1), self.entry)
            for k in range(top, -1, -1):
                here = np.flatnonzero(height[batch] >= k)
                ids, _ = search(self.x, self.layers[k], self.x[batch], enter, BUILD_BEAM if len(here) else 4)
                if len(here):
                    fellows = np.full((len(here), 8), pad)
                    if len(here) > 1:
                        near = self.x[batch[here]] @ self.x[batch[here]].T
                        np.fill_diagonal(near, -np.inf)
                        best = np.argsort(-near, axis=1)[:, :8]
                        fellows[:, : best.shape[1]] = batch[here][best]
                        fellows[fellows == batch[here][:, None]] = pad
                    self._link(self.layers[k], batch[here], np.concatenate([ids[here], fellows], axis=1))
                enter = ids[:, :4]
            for i in batch:
                if height[i] > top:
                    top, self.entry = int(height[i]), int(i)
            done += size

    def _link(self, links: np.ndarray, node: np.ndarray, cand: np.ndarray) -> None:
        pad, room = self.n, links.shape[1]
        chosen = _choose(self.x, node, cand, DEGREE)
        links[node, :DEGREE] = chosen
        a, b = np.repeat(node, DEGREE), chosen.ravel()
        a, b = a[b != pad], b[b != pad]
        order = np.argsort(b, kind="stable")  # back links: b gets a
        a, b = a[order], b[order]
        target, start, count = np.unique(b, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        for lo in range(0, len(target), 512):
            t, s, c = target[lo : lo + 512], start[lo : lo + 512], np.minimum(count[lo : lo + 512], 64)
            extra = np.full((len(t), min(most, 64)), pad)
            column = np.arange(extra.shape[1])
            mask = column[None, :] < c[:, None]
            extra[mask] = a[(s[:, None] + column[None, :])[mask]]
            both = np.concatenate([links[t], extra], axis=1)
            full = (both != pad).sum(axis=1) > room
            if (~full).any():
                packed = np.sort(both[~full], axis=1)[:, :room]  # padding has the largest id
                links[t[~full]] = packed
            if full.any():
                links[t[full]] = _choose(self.x, t[full], both[full], room)

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, best first, and their similarities; padding is node n."""
        out_i, out_s = [], []
        for lo in range(0, len(q), QUERIES):
            part = q[lo : lo + QUERIES].astype(np.float32)
            enter = np.full((len(part), 1), self.entry)
            for links in self.layers[:0:-1]:
                enter = search(self.x, links, part, enter, 8)[0][:, :8]
            ids, sims = search(self.x, self.layers[0], part, enter, beam)
            out_i.append(ids)
            out_s.append(sims)
        return np.concatenate(out_i), np.concatenate(out_s)

    def dump(self) -> tuple[bytes, list[int]]:
        """The links of all layers; upper layers hold the linked nodes only."""
        parts, sizes = [], [self.entry, len(self.layers)]
        for links in self.layers:
            node = np.flatnonzero((links[: self.n] != self.n).any(axis=1)).astype(np.int32)
            sizes.append(len(node))
            parts += [node.tobytes(), links[node].tobytes()]
        return b"".join(parts), sizes

    @classmethod
    def load(cls, vectors: np.ndarray, data: bytes, sizes: list[int]) -> Graph:
        n, layers, at = len(vectors), [], 0
        for k, size in enumerate(sizes[2:]):
            width = DEGREE * (1 if k else 2)
            node = np.frombuffer(data, np.int32, size, at)
            at += 4 * size
            links = np.full((n + 1, width), n, np.int32)
            links[node] = np.frombuffer(data, np.int32, size * width, at).reshape(size, width)
            at += 4 * size * width
            layers.append(links)
        return cls(vectors, layers, sizes[0])
