"""Graph partitioning: kernels on one component's edges, run per connected component or block."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graphs import contract
from tesserae.plans.fixpoint import components, cut


class Forest:
    """Union-find with path halving; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a > b:
            a, b = b, a
        self.up[b] = a
        return a

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def greedy_additive(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, stop: float = 0.0, linkage: str = "sum", size: np.ndarray | None = None, n_stop: int = 1, key: Callable[[float, float, float], float] | None = None, node_size: np.ndarray | None = None) -> np.ndarray:
    """Contracts the edge of highest priority while it exceeds ``stop`` and more than ``n_stop`` clusters remain.

    Parallel edges merge by sum, mean (weighted by size), max, min or absolute maximum.
    """
    f = Forest(n)
    size = np.ones(len(u)) if size is None else size
    nodes = np.ones(n) if node_size is None else node_size.astype(float).copy()
    merge = {"sum": lambda a, b: (a[0] + b[0], a[1] + b[1]), "mean": lambda a, b: ((a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]), "max": lambda a, b: (max(a[0], b[0]), a[1] + b[1]), "min": lambda a, b: (min(a[0], b[0]), a[1] + b[1]), "abs_max": lambda a, b: (a[0] if abs(a[0]) >= abs(b[0]) else b[0], a[1] + b[1])}[linkage]
    near: list[dict[int, tuple[float, float]]] = [{} for _ in range(n)]
    ids = list(range(n))
    for k in range(0, len(u), 1 << 16):  # in parts, so that no lists of all edges are held
        same: dict[tuple[float, float], tuple[float, float]] = {}
        for a, b, x, s in zip(*(c[k : k + (1 << 16)].tolist() for c in (u, v, w, size)), strict=True):
            if a != b:
                e = same.setdefault((x, s), (x, s))
                e = merge(near[a][b], e) if b in near[a] else e
                near[a][ids[b]] = near[b][ids[a]] = e
    if key:
        return _by_best(f, near, merge, key, nodes, stop, n_stop).labels()
    heap = [(-e[0], a, b, e) for a in range(n) for b, e in near[a].items() if a < b]
    heapq.heapify(heap)
    left = n
    while heap and left > n_stop:
        p, a, b, e = heapq.heappop(heap)
        if f.up[a] != a or f.up[b] != b or near[a].get(b) != e:
            continue
        if -p <= stop:
            break
        root, joined, renamed = _merge(f, near, merge, a, b)
        for c in near[root] if renamed else joined:  # all edges whose weight or name is another now
            x = near[root][c]
            heapq.heappush(heap, (-x[0], min(root, c), max(root, c), x))
        left -= 1
    return f.labels()


def _merge(f: Forest, near: list[dict], merge: Callable, a: int, b: int) -> tuple[int, dict, bool]:
    """Makes one cluster of two neighbours: its name, the neighbours of the one with fewer, and whether that of the other has another name now."""
    if len(near[a]) < len(near[b]):
        a, b = b, a
    root = f.join(a, b)
    other = a + b - root
    del near[a][b], near[b][a]
    for c, x in near[b].items():
        new = merge(near[a][c], x) if c in near[a] else x
        near[a][c] = near[c][a] = new
        del near[c][b]
    joined = near[b]
    near[root], near[other] = near[a], {}
    if root != a:
        for c, x in near[root].items():
            del near[c][a]
            near[c][root] = x
    return root, joined, root != a


def _by_best(f: Forest, near: list[dict], merge: Callable, key: Callable[[float, float, float], float], nodes: np.ndarray, stop: float, n_stop: int) -> Forest:
    """Contraction where priorities depend on the clusters' sizes, so that all edges of a grown cluster have another one.

    The heap holds one edge of each cluster, its best when it last changed. An edge only changes with one of its ends,
    whose entry is then new; an entry that holds no longer gives way to its cluster's best at that time.
    """
    size, live = nodes.tolist(), {}

    def offer(a: int) -> None:
        if near[a]:
            live[a] = top = min((-key(e[0], size[min(a, c)], size[max(a, c)]), min(a, c), max(a, c), a) for c, e in near[a].items())
            heapq.heappush(heap, top)
        else:
            live.pop(a, None)

    heap: list[tuple[float, int, int, int]] = []
    for a in range(len(near)):
        offer(a)
    left = len(near)
    while heap and left > n_stop:
        p, a, b, owner = top = heapq.heappop(heap)
        if live.get(owner) is not top:
            continue
        if b not in near[a] or -key(near[a][b][0], size[a], size[b]) != p:
            offer(owner)
            continue
        if -p <= stop:
            break
        root, _, _ = _merge(f, near, merge, a, b)
        size[root] += size[a + b - root]
        live.pop(a + b - root, None)
        offer(root)
        left -= 1
    return f


def adjacency(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """(first, neighbour, weight): the edges of node i in both directions lie from first[i] to first[i + 1]; numbers are shared objects, which keeps the lists small."""
    keep = u != v
    a, b, x = np.concatenate([u[keep], v[keep]]), np.concatenate([v[keep], u[keep]]), np.concatenate([w[keep], w[keep]])
    order = np.argsort(a, kind="stable")
    ids, (values, code) = list(range(n)), np.unique(x[order], return_inverse=True)
    values = values.tolist()
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist(), [ids[i] for i in b[order].tolist()], [values[i] for i in code.ravel().tolist()]


def _exchange(near: tuple[list[int], list[int], list[float]], lab: list[int], start: list[int], a: int, b: int, patience: float = np.inf) -> tuple[list[int], float]:
    """(nodes that changed sides, gain): nodes of the clusters a and b change sides one by one, best gain first, from ``start`` on and along edges; the best prefix of the moves stays.

    The search ends when no node is left or ``patience`` moves in a row have found nothing better.
    """
    first, to, cost = near
    gain: dict[int, float | None] = {}
    for i in start:
        mine, g = lab[i], 0.0
        for j, x in zip(to[first[i] : first[i + 1]], cost[first[i] : first[i + 1]], strict=True):
            c = lab[j]
            if c == mine:
                g -= x
            elif c == a or c == b:
                g += x
        gain[i] = g
    heap = [(-x, i) for i, x in gain.items()]
    heapq.heapify(heap)
    total, best, keep, moves = 0.0, 1e-9, 0, []
    while heap:
        x, i = heapq.heappop(heap)
        g = gain[i]
        if g != -x:
            if g is not None and g < -x:  # fell since; a node that rose has a newer entry
                heapq.heappush(heap, (-g, i))
            continue
        total -= x
        gain[i], old = None, lab[i]
        lab[i] = new = b if old == a else a
        moves.append(i)
        for j, x in zip(to[first[i] : first[i + 1]], cost[first[i] : first[i + 1]], strict=True):
            c = lab[j]
            if c != old and c != new:
                continue
            g = gain.get(j, 0)
            if g is None:
                continue
            if j in gain:
                y = -2 * x if c == new else 2 * x
                gain[j] = g = g + y
                if y > 0:
                    heapq.heappush(heap, (-g, j))
                continue
            g = 0.0
            for k, y in zip(to[first[j] : first[j + 1]], cost[first[j] : first[j + 1]], strict=True):
                d = lab[k]
                if d == c:
                    g -= y
                elif d == old or d == new:
                    g += y
            gain[j] = g
            heapq.heappush(heap, (-g, j))
        if total > best:
            best, keep = total, len(moves)
        elif len(moves) - keep > patience:
            break
    for i in moves[keep:]:
        lab[i] = b if lab[i] == a else a
    return moves[:keep], best if keep else 0.0


def _border(near: tuple[list[int], list[int], list[float]], lab: list[int], members: set[int], other: int) -> list[int]:
    """The members that touch cluster ``other`` and the nodes of it that they touch."""
    first, to, _ = near
    out = set()
    for i in members:
        across = [j for j in to[first[i] : first[i + 1]] if lab[j] == other]
        if across:
            out.add(i)
            out.update(across)
    return sorted(out)


def one_cluster(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.zeros(n, np.int64)


#: Where Kernighan-Lin searches start; of equal energies the first one's counts.
STARTS = (greedy_additive, one_cluster)
#: Components of so many edges are searched from each start in a task of its own.
APART = 1 << 13


def kernighan_lin(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, labels: np.ndarray | None = None, rounds: int = 20) -> np.ndarray:
    """While the energy falls: sequences of moves between two clusters or into a new one, moves of single nodes, and joins of clusters.

    A sequence between two clusters starts at their common border, so that its cost follows the smaller of them.
    """
    if labels is None:  # the best of the searches from all starts counts
        found = [kernighan_lin(n, u, v, w, start(n, u, v, w), rounds) for start in STARTS]
        return min(found, key=lambda x: float(w[x[u] != x[v]].sum()))
    lab = np.unique(labels, return_inverse=True)[1].ravel().tolist()
    near = adjacency(n, u, v, w)
    first, to, cost = near
    ends, others, costs = np.repeat(np.arange(n), np.diff(first)), np.array(to, np.int64), np.array(cost, float)
    groups: dict[int, set[int]] = defaultdict(set)
    for i, c in enumerate(lab):
        groups[c].add(i)
    state: dict[int, int] = defaultdict(int)  # how often a cluster has changed
    settled: dict[tuple[int, int], tuple[int, int]] = {}  # pairs that were searched in vain, with the state of both; they are skipped while it lasts
    fresh = max(lab, default=0) + 1

    def place(nodes: list[int], old: list[int]) -> None:
        for i, c in zip(nodes, old, strict=True):
            groups[c].discard(i)
            groups[lab[i]].add(i)
        for c in {*old, *(lab[i] for i in nodes)}:
            state[c] += 1

    for _ in range(rounds):
        moved = False
        at = np.array(lab, np.int64)
        p, q = at[u], at[v]
        p, q = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
        pairs = np.unique(p * fresh + q)
        for a, b in zip((pairs // max(fresh, 1)).tolist(), (pairs % max(fresh, 1)).tolist(), strict=True):
            if settled.get((a, b)) == (state[a], state[b]) or not groups[a] or not groups[b] or len(groups[a]) + len(groups[b]) < 2:
                continue
            small, large = (a, b) if len(groups[a]) <= len(groups[b]) else (b, a)
            shifted, _ = _exchange(near, lab, _border(near, lab, groups[small], large), a, b, 32 + 2 * len(groups[small]))
            if shifted:
                moved = True
                place(shifted, [a if lab[i] == b else b for i in shifted])
            else:
                settled[a, b] = state[a], state[b]
        for c in [c for c, members in groups.items() if len(members) > 1]:
            if settled.get((c, -1)) == (state[c], 0):
                continue
            shifted, _ = _exchange(near, lab, sorted(groups[c]), c, fresh)
            if shifted:
                moved = True
                place(shifted, [c] * len(shifted))
                fresh += 1
            else:
                settled[c, -1] = state[c], 0
        while True:  # single nodes, as long as some gain by a move
            at = np.array(lab, np.int64)
            code, number = np.unique(ends * fresh + at[others], return_inverse=True)
            pull, node, side = np.bincount(number.ravel(), costs, len(code)), code // max(fresh, 1), code % max(fresh, 1)
            own, best = np.zeros(n), np.zeros(n)
            mine = side == at[node]
            own[node[mine]] = pull[mine]
            np.maximum.at(best, node[~mine], pull[~mine])
            changed, old = [], []
            for i in np.flatnonzero(best - own > 1e-9).tolist():
                sums: dict[int, float] = {}
                for j, x in zip(to[first[i] : first[i + 1]], cost[first[i] : first[i + 1]], strict=True):
                    sums[lab[j]] = sums.get(lab[j], 0.0) + x
                kept = sums.pop(lab[i], 0.0)
                goal, top = fresh, 0.0
                for c, x in sorted(sums.items()):
                    if x > top + 1e-12:
                        goal, top = c, x
                if top - kept > 1e-9:
                    changed.append(i)
                    old.append(lab[i])
                    lab[i] = goal
                    fresh += goal == fresh
            if not changed:
                break
            moved = True
            place(changed, old)
        names, at = np.unique(lab, return_inverse=True)
        at = at.ravel()
        a, b = at[u], at[v]
        code, number = np.unique((np.minimum(a, b) * len(names) + np.maximum(a, b))[a != b], return_inverse=True)
        between = np.bincount(number.ravel(), w[a != b], len(code))
        if (between > 1e-9).any():  # clusters that attract each other join, greatest attraction first
            moved = True
            joint = greedy_additive(len(names), code // len(names), code % len(names), between, 1e-9)
            for k in np.flatnonzero(joint != np.arange(len(names))).tolist():
                c, goal = int(names[k]), int(names[joint[k]])
                members = sorted(groups[c])
                for i in members:
                    lab[i] = goal
                place(members, [c] * len(members))
        if not moved:
            break
    return np.unique(lab, return_inverse=True)[1].ravel()


def greedy_fixation(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Edges by absolute cost: attractive ones join clusters, repulsive ones forbid a join."""
    f, forbidden = Forest(n), [set() for _ in range(n)]
    for k in np.lexsort((v, u, -np.abs(w))):
        a, b = f.find(int(u[k])), f.find(int(v[k]))
        if a == b or b in forbidden[a]:
            continue
        if w[k] > 0:
            r = f.join(a, b)
            o = a + b - r
            for c in forbidden[o]:
                forbidden[c].discard(o)
                forbidden[c].add(r)
            forbidden[r] |= forbidden[o]
        else:
            forbidden[a].add(b)
            forbidden[b].add(a)
    return f.labels()


def mutex_watershed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, mutex: np.ndarray) -> np.ndarray:
    """Edges by weight: attractive ones join clusters unless a stronger mutex edge forbids it."""
    return greedy_fixation(n, u, v, np.where(mutex, -np.abs(w), np.abs(w)))


#: Proposals of fusion moves, and the deviation and the seed of what perturbs their costs.
PROPOSALS, SIGMA, SEED = 10, 1.0, 0


def proposal(k: int, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, sigma: float = SIGMA, seed: int = SEED) -> np.ndarray:
    """The greedy solution of the costs perturbed for the k-th time, whatever the others are."""
    random = np.random.default_rng(seed)
    for _ in range(k):
        random.normal(0, sigma, len(w))
    return greedy_additive(n, u, v, w + random.normal(0, sigma, len(w)))


def fusion_moves(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, rounds: int = PROPOSALS, sigma: float = SIGMA, seed: int = SEED, tried: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Proposals from perturbed costs, fused with the best solution by a search from it on the graph contracted by both.

    ``tried`` holds what the searches from ``STARTS`` and the proposals are, where they were made before.
    """
    starts = None if tried is None else tried[: len(STARTS)]
    best = kernighan_lin(n, u, v, w) if starts is None else min(starts, key=lambda x: float(w[x[u] != x[v]].sum()))
    for k in range(rounds):
        other = proposal(k, n, u, v, w, sigma, seed) if tried is None else tried[len(STARTS) + k]
        joint = np.unique(best.astype(np.int64) * n + other, return_inverse=True)[1].ravel()
        a, b, start = joint[u], joint[v], np.zeros(int(joint.max()) + 1, np.int64)
        keep, start[joint] = a != b, best
        pair, number = np.unique((np.minimum(a, b) * len(start) + np.maximum(a, b))[keep], return_inverse=True)
        fused = kernighan_lin(len(start), pair // len(start), pair % len(start), np.bincount(number.ravel(), w[keep], len(pair)), start)[joint]
        if w[fused[u] != fused[v]].sum() < w[best[u] != best[v]].sum():
            best = fused
    return best


def lifted_multicut(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, lu: np.ndarray, lv: np.ndarray, lw: np.ndarray) -> np.ndarray:
    """Greedy contraction along base edges with summed base and lifted costs."""
    f, base, cost = Forest(n), [set() for _ in range(n)], [defaultdict(float) for _ in range(n)]
    for a, b, x, local in [*zip(u.tolist(), v.tolist(), w.tolist(), [True] * len(u), strict=True), *zip(lu.tolist(), lv.tolist(), lw.tolist(), [False] * len(lu), strict=True)]:
        cost[a][b] += x
        cost[b][a] += x
        if local:
            base[a].add(b)
            base[b].add(a)
    heap = [(-cost[a][b], a, b) for a in range(n) for b in base[a] if a < b]
    heapq.heapify(heap)
    while heap and heap[0][0] < 0:
        p, a, b = heapq.heappop(heap)
        if f.up[a] != a or f.up[b] != b or b not in base[a] or cost[a][b] != -p:
            continue  # an edge of an earlier state
        f.join(a, b)
        for c, x in list(cost[b].items()):
            if c != a:
                cost[a][c] += x
                cost[c][a] += x
            cost[c].pop(b, None)
        for c in base[b]:
            base[c].discard(b)
            if c != a:
                base[a].add(c)
                base[c].add(a)
        for c in cost[b]:
            if c in base[a]:
                heapq.heappush(heap, (-cost[a][c], min(a, c), max(a, c)))
        cost[b], base[b] = defaultdict(float), set()
    return f.labels()


def seeded_mutex_watershed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, mutex: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A mutex watershed in which nodes of one non-zero seed are together from the start and different seeds never join."""
    f, forbidden, seed = Forest(n), [set() for _ in range(n)], seeds.tolist()
    first: dict[int, int] = {}
    for i, s in enumerate(seed):
        if s:
            r = f.join(first.setdefault(s, i), i)
            seed[r] = s
    for k in np.lexsort((v, u, -np.abs(w))):
        a, b = f.find(int(u[k])), f.find(int(v[k]))
        if a == b or b in forbidden[a] or (seed[a] and seed[b]):
            continue
        if mutex[k]:
            forbidden[a].add(b)
            forbidden[b].add(a)
            continue
        r = f.join(a, b)
        o = a + b - r
        seed[r] = seed[r] or seed[o]
        for c in forbidden[o]:
            forbidden[c].discard(o)
            forbidden[c].add(r)
        forbidden[r] |= forbidden[o]
    return f.labels()


def semantic_mutex_watershed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, mutex: np.ndarray, node: np.ndarray, kind: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, class of each node or -1): edges and votes (node, kind, strength) in one order; a vote names its cluster's class if it has none, and clusters of different classes never join."""
    f, forbidden, of = Forest(n), [set() for _ in range(n)], [-1] * n
    a_, b_ = np.concatenate([u, node]), np.concatenate([v, np.full(len(node), -1)])
    x_, kind_ = np.concatenate([np.abs(w), strength]), np.concatenate([np.full(len(u), -1), kind])
    mutex_ = np.concatenate([mutex.astype(bool), np.zeros(len(node), bool)])
    for k in np.lexsort((b_, a_, -x_)):
        a = f.find(int(a_[k]))
        if b_[k] < 0:
            of[a] = int(kind_[k]) if of[a] < 0 else of[a]
            continue
        b = f.find(int(b_[k]))
        if a == b or b in forbidden[a]:
            continue
        if mutex_[k]:
            forbidden[a].add(b)
            forbidden[b].add(a)
            continue
        if of[a] >= 0 and of[b] >= 0 and of[a] != of[b]:
            continue
        r = f.join(a, b)
        o = a + b - r
        of[r] = max(of[r], of[o])
        for c in forbidden[o]:
            forbidden[c].discard(o)
            forbidden[c].add(r)
        forbidden[r] |= forbidden[o]
    lab = f.labels()
    return lab, np.array([of[i] for i in lab.tolist()], np.int64)


def graph_watershed(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Seeds grow along edges of least weight."""
    first, to, cost = adjacency(n, u, v, w)
    out = seeds.tolist()
    heap = [(x, j, i) for i in np.flatnonzero(seeds).tolist() for j, x in zip(to[first[i] : first[i + 1]], cost[first[i] : first[i + 1]], strict=True) if out[j] == 0]
    heapq.heapify(heap)
    while heap:
        _, i, source = heapq.heappop(heap)
        if out[i] == 0:
            out[i] = out[source]
            for j, x in zip(to[first[i] : first[i + 1]], cost[first[i] : first[i + 1]], strict=True):
                if out[j] == 0:
                    heapq.heappush(heap, (x, j, i))
    return np.array(out, seeds.dtype)


SOLVERS: dict[str, Callable] = {"greedy-additive": greedy_additive, "kernighan-lin": kernighan_lin, "greedy-fixation": greedy_fixation, "decomposition": kernighan_lin, "fusion-moves": fusion_moves}
UNAVAILABLE = ("cut-glue-cut", "ilp", "rama")
LINKAGES = {"mean": "mean", "average": "mean", "avg": "mean", "max": "max", "single_linkage": "max", "min": "min", "complete_linkage": "min", "sum": "sum", "abs_max": "abs_max", "mutex_watershed": "abs_max"}


def get_solver(name: str) -> Callable:
    if name in UNAVAILABLE:
        raise RuntimeError(f"{name} needs a solver that is not installed")
    return SOLVERS[name]


def per_component(edges: DataFrame, kernel: Callable, columns: tuple[str, ...] = ("w",), nodes: DataFrame | None = None, group: DataFrame | None = None) -> DataFrame:
    """(node, label): the kernel on the edges of each component; labels are the smallest node of each cluster.

    ``group`` (node, component) is given where the components are known already; edges must lie inside them.
    """
    if group is None:
        edges = cut(edges.select("u", "v", *columns))
        group = cut(components(edges.select("u", "v"), nodes))

    def numbered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(nodes, u, v, further columns), the ends as places among the nodes, in one order of the edges."""
        # Columns by themselves and in Arrow: a connected graph comes whole, and copies of the table would be held beside the kernel's.
        u, v = group["u"].to_numpy(), group["v"].to_numpy()
        order, ids = np.lexsort((v, u)), np.unique(np.concatenate([np.unique(u), np.unique(v)]))
        return ids, np.searchsorted(ids, u[order]), np.searchsorted(ids, v[order]), [group[c].to_numpy()[order] for c in columns]

    def solved(group: pa.Table, kernel: Callable) -> tuple[np.ndarray, np.ndarray, float]:
        """(nodes, label of each one, weight of the edges between clusters)."""
        ids, u, v, rest = numbered(group)
        del group
        lab = np.asarray(kernel(len(ids), u, v, *rest))
        _, code = np.unique(lab, return_inverse=True)
        low = np.full(code.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, code, ids)
        return ids, low[code.ravel()], float(rest[0][lab[u] != lab[v]].sum()) if apart else 0.0

    def run(group: pa.Table) -> pa.Table:
        ids, label, _ = solved(group, kernel)
        return pa.table({"node": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int64())})

    def run_start(key: tuple, group: pa.Table) -> pa.Table:
        component, start = (x.as_py() for x in key)
        ids, label, energy = solved(group, lambda n, u, v, w: kernighan_lin(n, u, v, w, STARTS[start](n, u, v, w)))
        return pa.table({"component": pa.array([component] * len(ids), pa.int64()), "rank": pa.array([{"energy": energy, "start": start}] * len(ids)), "node": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int64())})

    def run_part(key: tuple, group: pa.Table) -> pa.Table:
        """One search or proposal of fusion moves: labels are places among the component's nodes."""
        component, k = (x.as_py() for x in key)
        ids, u, v, (w,) = numbered(group)
        del group
        n, at = len(ids), k - len(STARTS)
        lab = kernighan_lin(n, u, v, w, STARTS[k](n, u, v, w)) if at < 0 else proposal(at, n, u, v, w)
        return pa.table({"component": pa.array([component], pa.int64()), "start": pa.array([k], pa.int32()), "labels": pa.array([lab.astype(np.int32).tobytes()], pa.binary())})

    def run_fusion(group: pa.Table, tried: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.int32) for x in tried.sort_by("start")["labels"].to_pylist()]
        ids, label, _ = solved(group, lambda n, u, v, w: fusion_moves(n, u, v, w, tried=found))
        return pa.table({"node": pa.array(ids, pa.int64()), "label": pa.array(label, pa.int64())})

    apart = kernel in (kernighan_lin, fusion_moves)
    lines = edges.join(group, F.col("u") == F.col("node")).select("u", "v", *columns, F.col("component").cast("long").alias("component"))
    found = None
    if apart:
        lines = cut(lines)
        large = cut(lines.groupBy("component").count().where(F.col("count") >= APART).select("component"))
        many = large.count()
        if many:
            # A number of partitions that is named isn't made smaller, so that starts hardly ever share a task.
            each = lines.join(F.broadcast(large) if many < 1 << 10 else large, "component").withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(len(STARTS) + (PROPOSALS if kernel is fusion_moves else 0))])))
            each = each.repartition(64 + 4 * min(many, 1 << 10), "component", "start").groupBy("component", "start")
            if kernel is fusion_moves:
                tried = cut(each.applyInArrow(run_part, "component long, start int, labels binary"))
                found = lines.join(large, "component", "left_semi").groupBy("component").cogroup(tried.groupBy("component")).applyInArrow(run_fusion, "node long, label long")
            else:
                tried = cut(each.applyInArrow(run_start, "component long, rank struct<energy: double, start: long>, node long, label long"))
                best = tried.groupBy("component").agg(F.min("rank").alias("rank"))
                found = tried.join(best, ["component", "rank"], "left_semi").select("node", "label")
            lines = lines.join(large, "component", "left_anti")
    rest = lines.groupBy("component").applyInArrow(run, "node long, label long")
    found = rest if found is None else found.unionByName(rest)
    return group.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def multicut(edges: DataFrame, solver: str = "kernighan-lin", nodes: DataFrame | None = None) -> DataFrame:
    """(node, label) of a multicut. Repulsive edges alone never join, so components over attractive ones are solved apart."""
    kernel = get_solver(solver)
    edges = cut(edges.select("u", "v", "w"))
    attractive = edges.where("w > 0")
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    group = cut(components(attractive.select("u", "v"), ends if nodes is None else ends.unionByName(nodes.select("node"))))
    at = lambda s: group.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    inner = edges.join(at("u"), "u").join(at("v"), "v").where("cu = cv").select("u", "v", "w")
    return per_component(inner, kernel, group=group)


def mws(edges: DataFrame) -> DataFrame:
    """(node, label) of the mutex watershed of (u, v, w, mutex)."""
    return per_component(edges, mutex_watershed, ("w", "mutex"))


def gasp(edges: DataFrame, linkage: str = "mean") -> DataFrame:
    """(node, label) of signed agglomeration; with max linkage the components over non-negative edges."""
    if linkage not in LINKAGES:
        raise NotImplementedError(linkage)
    kind = LINKAGES[linkage]
    if kind == "max":
        ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
        return components(edges.where("w >= 0").select("u", "v"), ends).withColumnRenamed("component", "label")
    if kind == "abs_max":
        return per_component(edges, greedy_fixation)
    return per_component(edges, lambda n, u, v, w: greedy_additive(n, u, v, w, linkage=kind))


def agglomerative(edges: DataFrame, n_stop: int, size_regularizer: float = 0.5) -> DataFrame:
    """(node, label) with n_stop clusters per component; weights (u, v, w, size) are costs of joining, times the harmonic mean size to the regulariser."""
    key = lambda w, a, b: -w * (2 / (1 / a + 1 / b)) ** size_regularizer
    return per_component(edges, lambda n, u, v, w, s: greedy_additive(n, u, v, w, -np.inf, "mean", s, n_stop, key), ("w", "size"))


def mala(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(node, label): mean linkage until the least mean weight reaches the threshold."""
    return per_component(edges, lambda n, u, v, w, s: greedy_additive(n, u, v, -w, -threshold, "mean", s), ("w", "size"))


def lifted(edges: DataFrame, lifted_edges: DataFrame) -> DataFrame:
    """(node, label) of a lifted multicut over base edges and lifted edges (u, v, w)."""
    both = edges.select("u", "v", "w", F.lit(True).alias("base")).unionByName(lifted_edges.select("u", "v", "w", F.lit(False).alias("base")))
    return per_component(both, lambda n, u, v, w, b: lifted_multicut(n, u[b], v[b], w[b], u[~b], v[~b], w[~b]), ("w", "base"))


def blockwise_multicut(edges: DataFrame, blocks: DataFrame, solver: str = "kernighan-lin") -> DataFrame:
    """(node, label): blocks (node, block) are solved apart, what they join is contracted, the rest is solved as a whole."""
    at = lambda s: blocks.select(F.col("node").alias(s), F.col("block").alias(f"b{s}"))
    kernel = get_solver(solver)
    edges, blocks = cut(edges.select("u", "v", "w")), cut(blocks.select("node", "block"))
    inner = edges.join(at("u"), "u").join(at("v"), "v").where("bu = bv")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        ids, inverse = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        a = inverse.reshape(-1, 2)
        lab = np.asarray(kernel(len(ids), a[:, 0], a[:, 1], pdf["w"].to_numpy()))
        _, code = np.unique(lab, return_inverse=True)
        low = np.full(code.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, code, ids)
        return pd.DataFrame({"node": ids, "label": low[code]})

    local = inner.groupBy("bu").applyInPandas(run, "node long, label long")
    first = cut(blocks.select("node").join(local, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    reduced = contract(edges, first)
    final = multicut(reduced, solver, first.select(F.col("label").alias("node")).distinct())
    return first.join(final.select(F.col("node").alias("label"), F.col("label").alias("final")), "label").select("node", F.col("final").alias("label"))


def watershed_on_graph(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, label): seeds (node, seed) grown over each component."""
    edges = cut(edges.select("u", "v", "w"))
    both = edges.join(seeds.select(F.col("node").alias("u"), F.col("seed").alias("su")), "u", "left").join(seeds.select(F.col("node").alias("v"), F.col("seed").alias("sv")), "v", "left").fillna(0, ["su", "sv"])
    group = components(edges.select("u", "v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        ids, inverse = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        a = inverse.reshape(-1, 2)
        s = np.zeros(len(ids), np.int64)
        s[a[:, 0]], s[a[:, 1]] = np.maximum(s[a[:, 0]], pdf["su"]), np.maximum(s[a[:, 1]], pdf["sv"])
        return pd.DataFrame({"node": ids, "label": graph_watershed(len(ids), a[:, 0], a[:, 1], pdf["w"].to_numpy(), s)})

    return both.join(group, F.col("u") == F.col("node")).groupBy("component").applyInPandas(run, "node long, label long")


def seeded_mws(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, label) of the mutex watershed of (u, v, w, mutex) with seeds (node, seed); a seed's nodes end together, different seeds apart."""
    at = lambda s: seeds.select(F.col("node").alias(s), F.col("seed").cast("long").alias(f"s{s}"))
    both = edges.join(at("u"), "u", "left").join(at("v"), "v", "left").fillna(0, ["su", "sv"])
    anchors = seeds.where("seed <> 0").groupBy("seed").agg(F.min("node").alias("u"))
    tied = seeds.where("seed <> 0").join(anchors, "seed").select("u", F.col("node").alias("v"))
    group = components(edges.select("u", "v").unionByName(tied))

    def kernel(n, u, v, w, mutex, su, sv):
        s = np.zeros(n, np.int64)
        s[u], s[v] = su, np.maximum(s[v], sv)
        s[u] = np.maximum(s[u], su)
        return seeded_mutex_watershed(n, u, v, w, mutex, s)

    return per_component(both, kernel, ("w", "mutex", "su", "sv"), group=group)


def semantic_mws(edges: DataFrame, votes: DataFrame) -> DataFrame:
    """(node, label, kind) of the mutex watershed of (u, v, w, mutex) with votes (node, kind, strength) for classes from 0 up; -1 is no class."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).unionByName(votes.select("node")).distinct()
    group = components(edges.select("u", "v"), ends)
    lines = edges.join(group, F.col("u") == F.col("node")).select("component", "u", "v", F.col("w").cast("double"), "mutex", F.lit(-1).cast("long").alias("kind"))
    said = votes.join(group, "node").select("component", F.col("node").alias("u"), F.col("node").alias("v"), F.col("strength").cast("double").alias("w"), F.lit(False).alias("mutex"), F.col("kind").cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v", "kind"])
        ids, at = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        at, vote = at.reshape(-1, 2), pdf["kind"].to_numpy() >= 0
        w, mutex, kind = pdf["w"].to_numpy(), pdf["mutex"].to_numpy(), pdf["kind"].to_numpy()
        lab, of = semantic_mutex_watershed(len(ids), at[~vote, 0], at[~vote, 1], w[~vote], mutex[~vote], at[vote, 0], kind[vote], w[vote])
        return pd.DataFrame({"node": ids, "label": ids[lab], "kind": of})

    return lines.unionByName(said).groupBy("component").applyInPandas(run, "node long, label long, kind long")


def blockwise_mws(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(node, label): the mutex watershed of each block (node, block), then of the clusters, joined by the strongest edge of either kind between two."""
    at = lambda s: blocks.select(F.col("node").alias(s), F.col("block").alias(f"b{s}"))
    inner = edges.join(at("u"), "u").join(at("v"), "v").where("bu = bv").select("u", "v", "w", "mutex")
    local = mws(inner)
    first = blocks.select("node").join(local, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    to = lambda s: first.select(F.col("node").alias(s), F.col("label").alias(f"l{s}"))
    between = edges.join(to("u"), "u").join(to("v"), "v").where("lu <> lv").groupBy(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"), "mutex").agg(F.max(F.abs("w")).alias("w"))
    final = mws(between)
    return first.join(final.select(F.col("node").alias("label"), F.col("label").alias("final")), "label", "left").select("node", F.coalesce("final", "label").alias("label"))


def graph_size_filter(edges: DataFrame, sizes: DataFrame, min_size: int, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): nodes (node, size) that are too small join the others by a watershed on the edges' weights.

    With ``labels`` (node, label), ``sizes`` are of labels (label, size) and small labels give way. What no seed reaches keeps its own.
    """
    if labels is None:
        kept = sizes.where(F.col("size") >= min_size).select("node", F.col("node").alias("label"))
        every = sizes.select("node", F.col("node").alias("label"))
    else:
        kept = labels.join(sizes.where(F.col("size") >= min_size).select("label"), "label", "left_semi").select("node", "label")
        every = labels.select("node", "label")
    grown = watershed_on_graph(edges, kept.select("node", (F.col("label") + 1).alias("seed"))).where("label > 0")
    return every.join(grown.select("node", (F.col("label") - 1).alias("grown")), "node", "left").select("node", F.coalesce("grown", "label").alias("label"))


def cluster_segmentation(x: DataFrame, n_stop: float, size_regularizer: float = 1.0, on: tuple[str, ...] = ("y", "x"), label: str = "seg", value: str = "raw") -> DataFrame:
    """``x`` with ``cluster``: segments merged by boundary means, cheapest first, until n_stop (below 1: that share of them) clusters of each connected part remain."""
    from tesserae.operators.regions import mean_and_length, project_node_labels

    sizes = x.groupBy(F.col(label).alias("node")).agg(F.count("*").alias("n"))
    stop = max(1, int(n_stop * sizes.count())) if n_stop < 1 else int(n_stop)
    at = lambda s: sizes.select(F.col("node").alias(s), F.col("n").cast("double").alias(f"n{s}"))
    edges = mean_and_length(x, on, label, value).select("u", "v", F.col("mean").alias("w"), F.col("size").cast("double").alias("size")).join(at("u"), "u").join(at("v"), "v")
    key = lambda w, a, b: -w * (2 / (1 / a + 1 / b)) ** size_regularizer

    def kernel(n, u, v, w, size, nu, nv):
        nodes = np.ones(n)
        nodes[u], nodes[v] = nu, nv
        return greedy_additive(n, u, v, w, -np.inf, "mean", size, stop, key, nodes)

    found = per_component(edges, kernel, ("w", "size", "nu", "nv"), nodes=sizes)
    return project_node_labels(x, found.withColumnRenamed("label", "cluster"), label)
