"""Sequential versions of the community algorithms, on adjacency dictionaries: what the DataFrame rounds are held against."""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush


def greedy_merge(adjacency: dict, nodes: list) -> dict:
    """Merge the two communities whose union gains most modularity until none gains; ties: smallest members first.

    Gains wait in a heap; an entry counts only if it is the pair's latest, as a merge changes the gains of one community's pairs alone.
    """
    total = sum(sum(x.values()) for x in adjacency.values()) / 2
    label = {n: n for n in nodes}
    if total <= 0:
        return label
    links = {n: {m: w for m, w in adjacency.get(n, {}).items() if m != n} for n in nodes}
    degree = {n: sum(adjacency.get(n, {}).values()) for n in nodes}
    held = {n: [n] for n in nodes}
    gain = lambda a, b: links[a][b] / total - degree[a] * degree[b] / (2 * total * total)
    latest = {(a, b): gain(a, b) for a in links for b in links[a] if a < b}
    heap = [(-g, a, b) for (a, b), g in latest.items() if g > 1e-12]
    heapify(heap)
    while heap:
        g, a, b = heappop(heap)
        if latest.get((a, b)) != -g:
            continue
        for c, w in links.pop(b).items():
            del links[c][b]
            latest.pop((min(b, c), max(b, c)), None)
            if c != a:
                links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
        degree[a] += degree.pop(b)
        held[a] += held.pop(b)
        for c in links[a]:
            pair = (min(a, c), max(a, c))
            latest[pair] = gain(*pair)
            if latest[pair] > 1e-12:
                heappush(heap, (-latest[pair], *pair))
    return {n: a for a, own in held.items() for n in own}


def _move(graph: dict, degree: dict, total: float, part: dict) -> bool:
    """Move nodes, in order, to the neighbouring community of greatest modularity gain until none moves; whether any did."""
    weight: dict = defaultdict(float)
    for n in graph:
        weight[part[n]] += degree[n]
    moved_any = False
    while True:
        moved = False
        for n in sorted(graph):
            near: dict = defaultdict(float)
            for m, w in graph[n].items():
                near[part[m]] += w
            own = part[n]
            weight[own] -= degree[n]
            best = (near.get(own, 0.0) - weight[own] * degree[n] / total, own)
            for c in sorted(near):
                value = near[c] - weight[c] * degree[n] / total
                if value > best[0] + 1e-12:
                    best = (value, c)
            weight[best[1]] += degree[n]
            if best[1] != own:
                part[n], moved, moved_any = best[1], True, True
        if not moved:
            return moved_any


def _merge(graph: dict, loops: dict, part: dict) -> tuple[dict, dict, dict]:
    """The graph with each community of part as one node, named by its smallest; its loops; and the name of every old node."""
    names: dict = {}
    for n in sorted(graph):
        names.setdefault(part[n], n)
    of = {n: names[part[n]] for n in graph}
    merged: dict = {c: defaultdict(float) for c in names.values()}
    inner: dict = defaultdict(float)
    for n in graph:
        inner[of[n]] += loops.get(n, 0.0)
        for m, w in graph[n].items():
            if of[n] == of[m]:
                inner[of[n]] += w
            else:
                merged[of[n]][of[m]] += w
    return {c: dict(x) for c, x in merged.items()}, inner, of


def _plain(adjacency: dict, nodes: list) -> tuple[dict, dict, float]:
    graph = {n: {m: w for m, w in adjacency.get(n, {}).items() if m != n} for n in nodes}
    return graph, {n: adjacency.get(n, {}).get(n, 0.0) for n in nodes}, sum(sum(x.values()) for x in adjacency.values())


def local_moving(adjacency: dict, nodes: list) -> dict:
    """Louvain: move nodes, merge communities to nodes, and repeat until no node moves."""
    graph, loops, total = _plain(adjacency, nodes)
    group = {n: n for n in nodes}
    while total > 0:
        part = {n: n for n in graph}
        degree = {n: sum(graph[n].values()) + loops.get(n, 0.0) for n in graph}
        if not _move(graph, degree, total, part):
            break
        graph, loops, of = _merge(graph, loops, part)
        group = {n: of[c] for n, c in group.items()}
    return group


def grow(candidates, links, size):
    """The cohesive rule, one community at a time. candidates: (community, id, year, sap); links: pairs of ids."""
    near = defaultdict(set)
    of = {i: c for c, i, _, _ in candidates}
    rank = {i: (y or 0, s, i) for _, i, y, s in candidates}
    for a, b in links:
        if a != b and a in of and of.get(b) == of[a]:
            near[a].add(b)
            near[b].add(a)
    out = set()
    for c in {c for c, *_ in candidates}:
        left, best = {i for i in of if of[i] == c}, None
        while left:
            part, stack = set(), [next(iter(left))]
            while stack:
                n = stack.pop()
                if n not in part:
                    part.add(n)
                    stack.extend(near[n])
            left -= part
            chosen = [max(part, key=rank.get)]
            while len(chosen) < size and (rim := set().union(*(near[n] for n in chosen)) - set(chosen)):
                chosen.append(max(rim, key=rank.get))
            value = (len(chosen), sum(rank[n][0] for n in chosen), sum(rank[n][1] for n in chosen), max(rank[n] for n in chosen))
            if best is None or value > best[0]:
                best = (value, chosen)
        out |= {(c, n, k) for k, n in enumerate(best[1], 1)}
    return out
