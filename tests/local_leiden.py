"""A Leiden kernel for one small graph, in plain Python: the yardstick of the distributed one. And agreement of two labellings."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd


def _strengths(adj: list[dict[int, float]]) -> list[float]:
    return [sum(w * (2 if v == u else 1) for v, w in a.items()) for u, a in enumerate(adj)]


def _move(adj, strength, gamma, total, label, rng, inside=None) -> bool:
    """Queue-driven local moves to the best neighbouring community; inside: a partition that moves must respect."""
    weight = defaultdict(float)
    for u, c in enumerate(label):
        weight[c] += strength[u]
    queue = list(range(len(adj)))
    rng.shuffle(queue)
    waiting, moved = set(queue), False
    while queue:
        u = queue.pop()
        waiting.discard(u)
        links = defaultdict(float)
        for v, w in adj[u].items():
            if v != u and (inside is None or inside[v] == inside[u]):
                links[label[v]] += w
        weight[label[u]] -= strength[u]
        best, gain = label[u], links[label[u]] - gamma * strength[u] * weight[label[u]] / (2 * total)
        for c in sorted(links):
            g = links[c] - gamma * strength[u] * weight[c] / (2 * total)
            if g > gain + 1e-12:
                best, gain = c, g
        if best != label[u]:
            label[u], moved = best, True
            for v in adj[u]:
                if v != u and label[v] != best and v not in waiting:
                    waiting.add(v)
                    queue.insert(0, v)
        weight[label[u]] += strength[u]
    return moved


def leiden(n: int, edges: list[tuple[int, int, float]], gamma: float, seed: int) -> list[int]:
    """Labels of n vertices: local moves, refinement inside communities, aggregation, until nothing moves."""
    rng = random.Random(seed)
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    total = sum(w for _, _, w in edges)
    if not total:
        return list(range(n))
    member = list(range(n))  # node of the present level of each vertex
    label = list(range(n))
    while True:
        strength = _strengths(adj)
        moved = _move(adj, strength, gamma, total, label, rng)
        if not moved or len(set(label)) == len(adj):
            return canonical([label[m] for m in member])
        fine = list(range(len(adj)))
        _move(adj, strength, gamma, total, fine, rng, inside=label)
        names = {c: i for i, c in enumerate(sorted(set(fine)))}
        nxt: list[dict[int, float]] = [{} for _ in names]
        for u, a in enumerate(adj):
            for v, w in a.items():
                p, q = names[fine[u]], names[fine[v]]
                if p != q or u == v:
                    nxt[p][q] = nxt[p].get(q, 0.0) + w
                elif u < v:
                    nxt[p][p] = nxt[p].get(p, 0.0) + w
        coarse = [0] * len(names)
        for u, c in enumerate(fine):
            coarse[names[c]] = label[u]
        member = [names[fine[m]] for m in member]
        if len(names) == len(adj):
            return canonical([label[m] for m in member])
        first: dict[int, int] = {}
        label = [first.setdefault(c, i) for i, c in enumerate(coarse)]
        adj = nxt


def canonical(labels: list[int]) -> list[int]:
    """Labels renumbered by first appearance."""
    seen: dict[int, int] = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


def agreement(a: list[int], b: list[int]) -> tuple[float, float]:
    """Adjusted Rand index and normalised mutual information of two labellings."""
    table = pd.crosstab(np.array(a), np.array(b)).to_numpy().astype(float)
    n = table.sum()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    index, rows, cols = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected, most = rows * cols / max(n * (n - 1) / 2, 1), (rows + cols) / 2
    ari = 1.0 if most == expected else (index - expected) / (most - expected)
    p = table / n
    px, py = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    on = p > 0
    mi = float((p[on] * np.log((p / (px * py))[on])).sum())
    h = lambda q: float(-(q[q > 0] * np.log(q[q > 0])).sum())
    top = (h(px) + h(py)) / 2
    return float(ari), 1.0 if top == 0 else mi / top
