"""Proximity graphs inside one segment: construction and best-first search, in NumPy.

Both are sequential by nature, so they run inside a task on one segment of
bounded size; segments and blocks of queries run in parallel.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass

import numpy as np

from .knn import brute_graph

#: Vectors of the largest segment whose distances (to a query, or of all pairs in construction) are worked out at once.
WHOLE = 1024


@dataclass(frozen=True)
class BuildConfig:
    """How to build a segment's graph. builder: "auto" (brute up to ``brute_limit`` vectors), "brute" or "vamana"."""

    degree: int = 32
    builder: str = "auto"
    beam: int = 64
    alpha: float = 1.2
    max_visits: int = 5000
    prune: str = "sparse"  # "sparse": larger alpha keeps fewer edges; "standard": the published rule
    entry: str = "medoid"  # or "zero"
    seed: int = 42
    brute_limit: int = 10_000


@dataclass(frozen=True)
class SearchConfig:
    """beam 0: an unlimited frontier. dedupe: a node takes one place in the frontier at most."""

    top_k: int = 10
    beam: int = 8
    max_visits: int = 1000
    dedupe: bool = True


def _to(x: np.ndarray, rows, q: np.ndarray) -> np.ndarray:
    return ((x[rows] - q) ** 2).sum(-1)


def greedy_search(x: np.ndarray, graph: list[np.ndarray], entry: int, q: np.ndarray, beam: int, max_visits: int) -> list[tuple[float, int]]:
    """The ``beam`` closest of the nodes that a best-first walk expands, as (distance, node)."""
    seen = {entry}
    heap = [(float(_to(x, entry, q)), entry)]
    expanded: list[tuple[float, int]] = []
    while heap and len(expanded) < max_visits:
        at = heapq.heappop(heap)
        expanded.append(at)
        new = [v for v in graph[at[1]].tolist() if v not in seen]
        if new:
            seen.update(new)
            for d, v in zip(_to(x, new, q).tolist(), new):
                heapq.heappush(heap, (d, v))
    return sorted(expanded)[:beam]


def robust_prune(x: np.ndarray, node: int, candidates, degree: int, alpha: float, rule: str = "sparse") -> list[int]:
    """Neighbours of a node: candidates by (distance, id), without those that a kept one occludes.

    "sparse": u occludes v if alpha * d(node, v) > d(v, u), so larger alpha keeps
    fewer. "standard": if alpha * d(u, v) <= d(node, v), so larger alpha keeps more.
    """
    ids = np.array(sorted({int(c) for c in candidates} - {node}), np.int64)
    if not len(ids):
        return []
    d = _to(x, ids, x[node])
    order = np.lexsort((ids, d))
    ids, d = ids[order], d[order]
    alive = np.ones(len(ids), bool)
    kept: list[int] = []
    for i in range(len(ids)):
        if not alive[i]:
            continue
        kept.append(int(ids[i]))
        if len(kept) == degree:
            break
        between = _to(x, ids[i + 1 :], x[ids[i]])
        alive[i + 1 :] &= ~(alpha * d[i + 1 :] > between if rule == "sparse" else alpha * between <= d[i + 1 :])
    return kept


def sampled_medoid(x: np.ndarray, rng: np.random.Generator, most: int = 100) -> int:
    n = min(most, len(x))
    c, s = rng.choice(len(x), n, replace=False), rng.choice(len(x), n, replace=False)
    mean = ((x[c][:, None, :] - x[s][None, :, :]) ** 2).sum(-1).mean(1)
    return int(c[np.lexsort((c, mean))[0]])


def vamana_graph(x: np.ndarray, config: BuildConfig) -> tuple[list[np.ndarray], int]:
    """(neighbours of each row, entry): one pass over the rows from random neighbours."""
    n, degree = len(x), config.degree
    rng = np.random.default_rng(config.seed)
    graph = []
    for i in range(n):
        others = rng.choice(n - 1, min(degree, n - 1), replace=False) if n > 1 else np.zeros(0, np.int64)
        graph.append(others + (others >= i))
    entry = sampled_medoid(x, rng)
    if n <= WHOLE:
        return _vamana_of_table(x, graph, entry, config), entry
    for i in range(n):
        found = greedy_search(x, graph, entry, x[i], config.beam, config.max_visits)
        graph[i] = np.array(robust_prune(x, i, [v for _, v in found], degree, config.alpha, config.prune), np.int64)
        for u in graph[i].tolist():
            if i not in graph[u]:
                more = np.append(graph[u], i)
                graph[u] = more if len(more) <= degree else np.array(robust_prune(x, u, more, degree, config.alpha, config.prune), np.int64)
    return graph, entry


def _vamana_of_table(x: np.ndarray, graph: list[np.ndarray], entry: int, config: BuildConfig) -> list[np.ndarray]:
    """The same pass with all distances of a small segment worked out once."""
    n, degree, alpha, sparse = len(x), config.degree, config.alpha, config.prune == "sparse"
    table = [_to(x, slice(None), q).tolist() for q in x]
    lists = [g.tolist() for g in graph]

    def prune(node: int, candidates: list[int]) -> list[int]:
        own, kept = table[node], []
        rest = sorted((own[c], c) for c in set(candidates) if c != node)
        while rest and len(kept) < degree:
            u = rest[0][1]
            kept.append(u)
            between = table[u]
            rest = [at for at in rest[1:] if not (alpha * at[0] > between[at[1]] if sparse else alpha * between[at[1]] <= at[0])]
        return kept

    def walk(q: int) -> list[int]:
        own, seen, expanded = table[q], bytearray(n), []
        seen[entry] = True
        heap = [(own[entry], entry)]
        while heap and len(expanded) < config.max_visits:
            at = heapq.heappop(heap)
            expanded.append(at)
            for v in lists[at[1]]:
                if not seen[v]:
                    seen[v] = True
                    heapq.heappush(heap, (own[v], v))
        return [v for _, v in sorted(expanded)[: config.beam]]

    for i in range(n):
        lists[i] = prune(i, walk(i))
        for u in lists[i]:
            if i not in lists[u]:
                more = [*lists[u], i]
                lists[u] = more if len(more) <= degree else prune(u, more)
    return [np.array(g, np.int64) for g in lists]


def build(x: np.ndarray, config: BuildConfig) -> tuple[np.ndarray, int]:
    """(neighbours [row, degree], padded with the own row; entry)."""
    n = len(x)
    if config.builder not in ("auto", "brute", "vamana"):
        raise ValueError(f"unknown builder {config.builder!r}")
    if config.degree < 1 or not n:
        raise ValueError("a graph needs a degree of at least 1 and a vector")
    brute = config.builder == "brute" or config.builder == "auto" and n <= config.brute_limit
    if brute:
        out = brute_graph(x, np.arange(n), config.degree)
        entry = sampled_medoid(x, np.random.default_rng(config.seed))
    else:
        graph, entry = vamana_graph(x, config)
        out = np.repeat(np.arange(n)[:, None], config.degree, axis=1)
        for i, g in enumerate(graph):
            g = g[: config.degree]
            out[i, : len(g)] = g
    return out, 0 if config.entry == "zero" else entry


def beam_search(x: np.ndarray, neighbors: np.ndarray, entry: int, q: np.ndarray, config: SearchConfig, adc: tuple[np.ndarray, np.ndarray] | None = None, wanted: set[int] | None = None):
    """(rows, distances, visited, pq distances) of a best-first search.

    The frontier is ordered by (distance, row): exact distances, or those of the
    table ``adc`` = (table [m, k], codes [row, m]). Visited rows are ranked by
    exact distance. The search ends with the frontier or at ``max_visits``, or
    when it has visited all of ``wanted``, the only rows that matter to the caller.
    """
    n, beam = len(x), config.beam
    exact = _to(x, slice(None), q) if n <= WHOLE else None
    parts = None if adc is None else np.arange(len(adc[0]))
    near = exact if adc is None else adc[0][parts[None, :], adc[1]].sum(1) if n <= WHOLE else None
    near = None if near is None else near.tolist()
    visited, waiting = bytearray(n), bytearray(n)
    frontier = [(float(_to(x, entry, q)), int(entry))]
    left = None if wanted is None else set(wanted)
    order: list[int] = []
    pq = 0
    while frontier and len(order) < config.max_visits:
        d, v = frontier.pop(0)
        if not 0 <= v < n or visited[v]:
            continue
        visited[v] = True
        order.append(v)
        if left is not None:
            left.discard(v)
            if not left:
                break
        new = neighbors[v].tolist()
        new = [u for u in (set(new) if config.dedupe else new) if 0 <= u < n and not visited[u] and not waiting[u]]
        if new:
            if near is not None:
                dist = [near[u] for u in new]
            elif adc is None:
                dist = _to(x, new, q).tolist()
            else:
                dist = adc[0][parts[None, :], adc[1][new]].sum(1).tolist()
            pq += 0 if adc is None else len(new)
            for at in zip(dist, new):
                if beam and len(frontier) >= beam and at > frontier[beam - 1]:
                    continue  # would be cut off below
                bisect.insort(frontier, at)
                waiting[at[1]] = config.dedupe
        if beam and len(frontier) > beam:
            for _, u in frontier[beam:]:
                waiting[u] = False
            del frontier[beam:]
    rows = np.array(order, np.int64)
    dist = (_to(x, rows, q) if exact is None else exact[rows]) if len(rows) else np.zeros(0)
    best = np.lexsort((rows, dist))[: config.top_k]
    return rows[best], dist[best], len(order), pq
