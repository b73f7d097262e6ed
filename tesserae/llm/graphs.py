"""A robust-pruned directed graph over the unit vectors of one shard, and beam search in it, by numpy for many at once.

Searches run in lockstep: each step expands the nearest open nodes of every query's beam, gathers their neighbours and keeps the
nearest ``beam`` of all. Building inserts nodes in batches: a greedy search from the entry proposes neighbours, robust
pruning keeps a candidate unless a kept one is nearer to it than the node itself is, in a second turn by the factor
``relax``; and the kept ones get edges back, pruned where they become too many.
"""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, RELAX, BATCH, EXPAND = 32, 64, 1.2, 256, 4


def distances(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``q`` to the rows of ``x`` that its row of ``at`` names; -1 is infinitely far."""
    d = 2 - 2 * np.matmul(x[at], q[:, :, None])[:, :, 0]  # of unit vectors
    d[at < 0] = np.inf
    return d


def search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each row of ``q`` and their distances, nearest first (-1 where there are
    fewer); and the nodes expanded on the way."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes what -1 marks
    seen[:, entry] = True
    ids, open_ = np.full((n, beam), -1, np.int32), np.zeros((n, beam), bool)
    far = np.full((n, beam), np.inf, np.float32)
    ids[:, 0], open_[:, 0] = entry, True
    far[:, :1] = distances(x, q, ids[:, :1])
    trail = []
    while True:
        rank = np.where(open_, far, np.inf)
        pick = np.argpartition(rank, min(expand, beam) - 1, axis=1)[:, :expand]
        live = np.isfinite(rank[rows, pick])
        if not live.any():
            break
        now = np.where(live, ids[rows, pick], -1)
        open_[rows, pick] = False
        trail.append(now)
        near = np.where(now[:, :, None] >= 0, edges[now], -1).reshape(n, -1)
        near[seen[rows, near]] = -1
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[rows, near] = True
        seen[:, -1] = False
        width = int((near >= 0).sum(1).max())
        if not width:
            continue
        near = np.sort(near, axis=1)[:, -width:]
        both, all_ids = np.concatenate([far, distances(x, q, near)], 1), np.concatenate([ids, near], 1)
        best = np.argpartition(both, beam - 1, axis=1)[:, :beam]
        far, ids = both[rows, best], all_ids[rows, best]
        open_ = np.concatenate([open_, near >= 0], 1)[rows, best]
    order = np.argsort(far, axis=1, kind="stable")
    return ids[rows, order], far[rows, order], np.concatenate(trail, 1)


def prune(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """For each of ``nodes`` at most ``degree`` of its candidates ``near`` (-1: none), by robust pruning: first those to which
    no kept one is nearer, then, while there is room, those to which none is nearer by the factor ``relax``. Without the
    first the nearest ones fill the room, and a cluster of more than ``degree`` is an island."""
    near = np.sort(np.where(near == nodes[:, None], -1, near), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    d = distances(x, x[nodes], near)
    order = np.argsort(d, axis=1, kind="stable")
    near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
    width = max(1, int(np.isfinite(d).sum(1).max()))
    near, d = near[:, :width], d[:, :width]
    v = x[near]
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    shade, out, rows = np.where(np.isfinite(d), 0.0, np.inf), np.full((len(nodes), degree), -1, np.int32), np.arange(len(nodes))
    held = np.zeros(len(nodes), int)
    for factor in (1.0, relax):
        while True:
            lit = shade < factor * factor
            first = lit.argmax(1)
            has = lit[rows, first] & (held < degree)
            if not has.any():
                break
            out[rows[has], held[has]] = near[rows, first][has]
            held += has
            by = d / np.maximum(between[rows, first], 1e-12)
            shade = np.maximum(shade, np.where(has[:, None], by, 0.0))
            shade[rows[has], first[has]] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (at most ``degree`` a node, -1 where there are fewer) and the entry node for unit vectors ``x``."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int((x @ x.mean(0)).argmax())
    edges = np.full((n + 1, degree), -1, np.int32)  # the last row belongs to -1
    if n > 1:
        k = min(degree, n - 1)
        edges[:n, :k] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, k))) % n  # random, never a loop
    for alpha in (1.0, relax):  # the first round is for the second's searches
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            nodes = order[at : at + BATCH]
            _, _, trail = search(x, edges, entry, x[nodes], beam)
            edges[nodes] = prune(x, nodes, np.concatenate([trail, edges[nodes]], 1), alpha, degree)
            _back(x, edges, nodes, alpha)
    return edges[:n], entry


def _back(x: np.ndarray, edges: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Edges back to ``nodes`` from those they point to."""
    degree = edges.shape[1]
    to, of = edges[nodes].ravel(), np.repeat(nodes, degree)
    to, of = to[to >= 0], of[to >= 0]
    known = (edges[to] == of[:, None]).any(1)
    to, of = to[~known], of[~known]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, counts)
    held = (edges[targets] >= 0).sum(1)
    order = np.argsort(held + counts, kind="stable")  # of like width together
    for at in range(0, len(order), BATCH):
        part = np.sort(order[at : at + BATCH])
        mine = np.isin(np.repeat(np.arange(len(targets)), counts), part)
        row = np.searchsorted(part, np.repeat(np.arange(len(targets)), counts)[mine])
        more = np.full((len(part), int(counts[part].max())), -1, np.int32)
        more[row, place[mine]] = of[mine]
        wide = np.sort(np.concatenate([edges[targets[part]], more], 1), axis=1)
        full = (wide >= 0).sum(1) > degree
        slim = wide[:, -degree:] if wide.shape[1] >= degree else wide
        edges[targets[part[~full]]] = slim[~full]
        if full.any():
            edges[targets[part[full]]] = prune(x, targets[part[full]], wide[full], alpha, degree)
