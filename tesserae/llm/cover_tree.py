"""Exact cosine pairs over a threshold by dual traversal of cover trees.

Unit vectors at cosine c have distance sqrt(2 - 2c), so the join is a distance join at radius T. Equal
vectors are one, with their number. A bounded sample gives the centres of the trees' top nodes; every
vector goes to its nearest centre, and the covering radius of a node is the largest distance of its
vectors. A pair of top nodes is pruned when its centres are further apart than T and both covering
radii; a vector meets another node only if its own distance allows. Nodes of many vectors are dealt in
parts. Inside a task both sides get nested levels whose radii halve; the dual traversal keeps the node
pairs that d(p, q) <= T + radius(p) + radius(q) leaves, level by level, and tests what remains at the
leaves: in single precision with a margin that covers its rounding, then in double precision. Levels
that would hold nearly every vector alone are left implicit, as in the explicit form of a cover tree.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing and forms its own component; vectors of unequal lengths never link; ties and equal vectors
link; of rows with one id each counts as a vector, and they share a component; an empty table gives an
empty result; further columns are ignored. Vectors of a length that the sample misses have a single top node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import mix
from tesserae.llm.graph import components
from tesserae.llm.session import cut

#: Vectors that a top node holds on average, and that a sample of centres is chosen from at most.
NODE, SAMPLE = 4096, 16_384
#: Bundles that a table is dealt in at least, where it has as many parts, and bytes of one at most.
BUNDLES, BUNDLE_BYTES = 8, 1 << 24
#: Rows that are dealt and cosines that are held at once, at most (a vector or row of the other side more).
ROWS, CELLS = 1 << 14, 1 << 22
#: Slack for rounding in bounds: sqrt(2 - 2c) near 0 is off by up to 2e-8. The leaves decide exactly.
EPS = 1e-7


def usable(vector: str = "embedding") -> str:
    """SQL: whether the vector can link at all."""
    return f"coalesce(size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('Infinity')) AND exists({vector}, x -> x <> 0), false)"


def unit(rows: np.ndarray) -> np.ndarray:
    # The largest component is divided out first, so that no square over- or underflows.
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (indices) further than ``radius`` apart that cover all points, and each point's centre number."""
    owner = np.full(len(points), -1, np.int64)
    centres: list[int] = []
    limit = 1.0 - radius * radius / 2.0
    for i in range(len(points)):
        if owner[i] < 0:
            mine = (points @ points[i] >= limit) & (owner < 0)
            owner[mine] = len(centres)
            owner[i] = len(centres)
            centres.append(i)
    return np.array(centres, np.int64), owner


class Level:
    """One level: centre vectors, their covering radii and the parent of each in the level above."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, parent: np.ndarray):
        self.centres, self.radius, self.parent = centres, radius, parent


def tree(points: np.ndarray, limit: float) -> list[Level]:
    """Levels from one root, the point nearest to the mean, down to the points themselves, radii halving until below ``limit``."""
    root = points[[int(np.argmax(points @ points.mean(axis=0)))]]
    levels = [Level(root, distances(points, root).max(axis=0) + EPS, np.zeros(1, np.int64))]
    members, radius = np.zeros(len(points), np.int64), float(levels[0].radius[0])
    while radius > limit / 4 and len(points) > 1:
        radius /= 2
        # If few of some points have others that near, a net would keep nearly all.
        some = points[:: max(1, len(points) // 256)]
        if ((some @ points.T >= 1.0 - radius * radius / 2.0).sum(axis=1) > 1).mean() < 0.1:
            break
        centres, owner = net(points, radius)
        if len(centres) > 0.9 * len(points):
            break
        if len(centres) > 2 * len(levels[-1].centres):
            # A centre can have points of several nodes above: it is listed under each, so levels stay nested.
            joint, number = np.unique(members * len(centres) + owner, return_inverse=True)
            parent, own = joint // len(centres), points[centres[joint % len(centres)]]
            cover = np.zeros(len(joint))
            np.maximum.at(cover, number, np.sqrt(np.maximum(2.0 - 2.0 * (points * own[number]).sum(axis=1), 0.0)))
            levels.append(Level(own, cover + EPS, parent))
            members = number
    levels.append(Level(points, np.zeros(len(points)), members))
    return levels


def margin(width: int) -> float:
    """What the cosine of two vectors of this length may change by as they are packed and multiplied in single precision."""
    return float(np.sqrt(width)) / 32767 * 1.01 + 2e-7 * width + 1e-6


def packed(v: np.ndarray) -> np.ndarray:
    """Unit vectors in 16 bits a component; each is scaled by its largest one."""
    return np.rint(v * (32767 / np.abs(v).max(axis=1, keepdims=True))).astype(np.int16)


def dual(a: list[Level], b: list[Level], cosine: float, more: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, whether the cosine reaches ``more``): the pairs of leaves whose cosine reaches the threshold, some rows at a time."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    depth = max(len(a), len(b))
    a = a[:-1] + [None] * (depth - len(a)) + a[-1:]  # type: ignore[list-item]
    b = b[:-1] + [None] * (depth - len(b)) + b[-1:]  # type: ignore[list-item]
    alive, last_a, last_b = None, a[0], b[0]
    for x, y in zip(a, b, strict=True):
        rows = x.parent if x is not None and alive is not None else np.arange(len(last_a.centres))
        cols = y.parent if y is not None and alive is not None else np.arange(len(last_b.centres))
        x, y = x if x is not None else last_a, y if y is not None else last_b
        above_a, above_b, last_a, last_b = last_a, last_b, x, y
        if alive is None:
            alive = distances(x.centres, y.centres) <= reach + x.radius[:, None] + y.radius[None, :] + EPS
            continue
        # Parts of either side without any surviving partner are not compared at all.
        use_r, use_c = np.flatnonzero(alive.any(axis=1)[rows]), np.flatnonzero(alive.any(axis=0)[cols])
        if x is a[-1] and y is b[-1]:
            # Nor are points that are too far from the only node of the other side.
            if len(above_b.centres) == 1:
                use_r = use_r[distances(x.centres[use_r], above_b.centres)[:, 0] <= reach + above_b.radius[0] + EPS]
            if len(above_a.centres) == 1:
                use_c = use_c[distances(y.centres[use_c], above_a.centres)[:, 0] <= reach + above_a.radius[0] + EPS]
            left, right = x.centres[use_r].astype(np.float32), y.centres[use_c].astype(np.float32)
            whole, step = bool(alive.all()), max(1, CELLS // max(1, len(use_c)))
            for k in range(0, len(use_r) if len(use_c) else 0, step):
                dots = (left[k : k + step] @ right.T).ravel()
                at = np.flatnonzero(dots >= np.float32(cosine))
                r, c = k + at // len(use_c), at % len(use_c)
                sure = dots[at] >= np.float32(more)
                if not whole:
                    held = alive[rows[use_r[r]], cols[use_c[c]]]
                    r, c, sure = r[held], c[held], sure[held]
                yield use_r[r], use_c[c], sure
            return
        wide = np.zeros((len(x.centres), len(y.centres)), bool)
        if len(use_c):
            step = max(1, CELLS // len(use_c))
            for k in range(0, len(use_r), step):
                some = use_r[k : k + step]
                bound = np.minimum(reach + x.radius[some][:, None] + y.radius[use_c][None, :] + EPS, 2.0)
                r, c = np.nonzero(x.centres[some] @ y.centres[use_c].T >= 1.0 - bound * bound / 2.0)
                held = alive[rows[some[r]], cols[use_c[c]]]
                wide[some[r[held]], use_c[c[held]]] = True
        alive = wide


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` spread-out centres of the sample, the farthest from the chosen ones each time."""
    chosen = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        i = int(np.argmax(far))
        if far[i] <= 0:
            break
        chosen.append(i)
        far = np.minimum(far, distances(sample, sample[i : i + 1])[:, 0])
    # Each is followed by the nearest one left, so that neighbours in this order share bundles.
    left, order = sample[chosen], [0]
    open_ = np.ones(len(left), bool)
    while len(order) < len(left):
        open_[order[-1]] = False
        order.append(int(np.argmax(np.where(open_, left @ left[order[-1]], -2.0))))
    return left[order]


def node_pairs(vectors: DataFrame, cosine: float, embedding: str) -> DataFrame:
    """(w, lo, hi, part, side, id, weight, v) of the distinct vectors (id, weight, v) that can link: bundles of the parts of top nodes, two by two."""
    count = vectors.count()
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    taken = vectors.select(embedding).where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // (SAMPLE // 2)))) == 0).limit(SAMPLE).collect()
    samples: dict[int, list] = {}
    for r in taken:
        samples.setdefault(len(r[0]), []).append(r[0])
    # At most SAMPLE / 4 centres, whatever the table's size.
    plans = {w: centres_of(unit(np.array(x, float)), int(min(max(1, count * len(x) // (len(taken) * NODE)), SAMPLE // 4))) for w, x in samples.items()}
    broadcast = vectors.sparkSession.sparkContext.broadcast(plans)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1 << 10):
                batch = whole.slice(k, 1 << 10)
                sizes = batch.column(2).value_lengths().to_numpy()
                for w in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == w))
                    v = unit(part.column(2).flatten().to_numpy().reshape(part.num_rows, int(w)))
                    centres = broadcast.value.get(int(w))
                    own, far = np.zeros(len(v), np.int64), np.full(len(v), 2.0)
                    if centres is not None:
                        d = distances(v, centres)
                        own = np.argmin(d, axis=1)
                        far = d[np.arange(len(v)), own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), w, np.int32)), pa.array(own.astype(np.int32)), pa.array(far), part.column(0), part.column(1), pa.array([x.tobytes() for x in packed(v)], pa.binary())], ["w", "node", "d", "id", "weight", "v"])

    nodes = cut(vectors.select("id", "weight", embedding).mapInArrow(assign, "w int, node int, d double, id long, weight long, v binary"))
    # Covering radius and size of each top node: as many rows as there are centres, and one for each length without.
    tops: dict[int, dict[int, tuple[float, int]]] = {}
    for r in nodes.groupBy("w", "node").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect():
        tops.setdefault(r["w"], {})[r["node"]] = (r["r"], r["n"])
    # For each length: radii, numbers of parts and first part of the nodes, the bundle of each part, and which nodes have parts in which bundles.
    layout = {}
    for w, found in tops.items():
        k = len(plans[w]) if w in plans else 1
        radius, n = (np.array([found.get(i, (-4.0, 0))[j] for i in range(k)]) for j in (0, 1))
        parts = -(-n // NODE)
        node = np.repeat(np.arange(k), parts)
        full = max(NODE, min(int(n.sum()) // BUNDLES, BUNDLE_BYTES // (2 * w)))
        bundle, held, number = np.zeros(len(node), np.int64), 0.0, 0
        for i, size in enumerate((n / np.maximum(parts, 1))[node].tolist()):
            if held and held + size > 1.1 * full:
                held, number = 0.0, number + 1
            held += size
            bundle[i] = number
        holds = np.zeros((k, number + 1), np.float32)
        holds[node, bundle] = 1
        layout[w] = radius, parts, np.cumsum(parts) - parts, bundle, holds
    shared = vectors.sparkSession.sparkContext.broadcast(layout)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            widths_of = whole.column(0).to_numpy()
            for w in np.unique(widths_of).tolist():
                every = whole.filter(pa.array(widths_of == w))
                centres, (radius, parts, first, bundle, holds) = broadcast.value.get(w), shared.value[w]
                between = None if centres is None else distances(centres, centres) <= reach + radius[None, :] + radius[:, None] + EPS
                step = max(1, min(1 << 10, ROWS // holds.shape[1]))
                for k in range(0, every.num_rows, step):
                    part = every.slice(k, step)
                    own = part.column(1).to_numpy()
                    meets = np.ones((len(own), len(parts)), bool)
                    if centres is not None:
                        # A vector meets another node if that node's ball around its centre comes within reach.
                        v = unit(np.frombuffer(b"".join(part.column(5).to_pylist()), np.int16).reshape(-1, w).astype(float))
                        slack = float(np.sqrt(2 * margin(w)))
                        meets = (distances(v, centres) <= reach + radius[None, :] + EPS + slack) & between[own]
                        meets[np.arange(len(own)), own] = True
                    mine = first[own] + (mix(part.column(3).to_numpy().view(np.uint64)) % parts[own].astype(np.uint64)).astype(np.int64)
                    at, other = np.nonzero(meets.astype(np.float32) @ holds > 0)
                    home = bundle[mine][at]
                    lo, hi = np.minimum(home, other), np.maximum(home, other)
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w, np.int32)), pa.array(lo), pa.array(hi), pa.array(mine[at].astype(np.int32)), pa.array((home != lo).astype(np.int32)), part.column(3).take(rows), part.column(4).take(rows), part.column(5).take(rows)], ["w", "lo", "hi", "part", "side", "id", "weight", "v"])

    return nodes.mapInArrow(deal, "w int, lo long, hi long, part int, side int, id long, weight long, v binary").repartition("w", "lo", "hi")


def distinct_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, weight, embedding): the smallest id and the number of rows of each vector that can link."""
    good = vectors.where(usable(f"`{embedding}`")).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias(embedding))
    return cut(good.groupBy(embedding).agg(F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "weight", embedding))


def joined(group: pa.Table, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, sure): pairs of rows of two bundles that link for sure or may; their parts are cut into pieces of at most 2 * NODE, so memory stays bounded."""
    w = group["w"][0].as_py()
    packs = group["v"].combine_chunks()
    packs = packs.combine_chunks() if isinstance(packs, pa.ChunkedArray) else packs
    part, side, near = group["part"].to_numpy(), group["side"].to_numpy(), margin(w)
    single = group["lo"][0].as_py() == group["hi"][0].as_py()

    def pieces(of: int) -> list[tuple[np.ndarray, list[Level]]]:
        out = []
        for p in np.unique(part[side == of]).tolist():
            every = np.flatnonzero((side == of) & (part == p))
            for k in range(0, len(every), 2 * NODE):
                at = every[k : k + 2 * NODE]
                v = np.frombuffer(b"".join(packs.take(pa.array(at)).to_pylist()), np.int16).reshape(-1, w)
                out.append((at, tree(unit(v.astype(float)), float(np.sqrt(2 - 2 * cosine)))))
        return out

    left = pieces(0)
    right = left if single else pieces(1)
    for i, (x, t) in enumerate(left):
        for y, u in right[i if single else 0 :]:
            for r, c, sure in dual(t, u, cosine - near, cosine + near):
                if y is x:
                    r, c, sure = r[r < c], c[r < c], sure[r < c]
                yield x[r], y[c], sure


def confirmed(open_: DataFrame, distinct: DataFrame, cosine: float, embedding: str) -> DataFrame:
    """(a, b, m, n): the pairs (a, b) whose cosine in double precision reaches the threshold, with the weights of a and b."""
    at = lambda s, n: distinct.select(F.col("id").alias(s), F.col("weight").alias(n), F.col(embedding).alias(f"v{s}"))
    both = open_.join(at("a", "m"), "a").join(at("b", "n"), "b").select("a", "b", "m", "n", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1 << 10):
                batch = whole.slice(k, 1 << 10)
                widths_of = batch.column(4).value_lengths().to_numpy()
                for w in np.unique(widths_of).tolist():
                    some = batch.filter(pa.array(widths_of == w))
                    x, y = (unit(some.column(c).flatten().to_numpy().reshape(-1, w)) for c in (4, 5))
                    yield some.select([0, 1, 2, 3]).filter(pa.array((x * y).sum(axis=1) >= cosine))

    return both.mapInArrow(run, "a long, b long, m long, n long")


def pairs(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b) with a < b of every pair of distinct vectors, named by their smallest ids, whose cosine reaches the threshold."""
    distinct = distinct_vectors(vectors, vec_id, embedding)

    def run(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        found = [np.zeros((0, 3), np.int64)] + [np.column_stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), sure]) for i, j, sure in joined(group, cosine)]
        both = np.concatenate(found)
        return pa.table({"a": both[:, 0], "b": both[:, 1], "sure": both[:, 2] > 0})

    found = cut(node_pairs(distinct, cosine, embedding).groupBy("w", "lo", "hi").applyInArrow(run, "a long, b long, sure boolean"))
    return found.where("sure").select("a", "b").unionByName(confirmed(found.where("NOT sure").select("a", "b"), distinct, cosine, embedding).select("a", "b"))


def clusters(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector; tasks return counts, spanning links and the pairs that are open, not all pairs."""
    vectors = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    distinct = distinct_vectors(vectors, "vec_id", "embedding")

    def run(group: pa.Table) -> pa.Table:
        ids, weight = group["id"].to_numpy(), group["weight"].to_numpy()
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        open_ = [np.zeros((0, 2), np.int64)]
        for i, j, sure in joined(group, cosine):
            open_.append(np.column_stack([ids[i[~sure]], ids[j[~sure]]]))
            i, j = i[sure], j[sure]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            while len(i):  # hook larger roots to smaller ones and shorten, until all links are inside trees
                p, q = root[i], root[j]
                apart = p != q
                i, j, p, q = i[apart], j[apart], p[apart], q[apart]
                if not len(i):
                    break
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while (root[root] != root).any():
                    root = root[root]
        hit, maybe = count > 0, np.concatenate(open_)
        return pa.table({"a": np.append(ids[hit], maybe[:, 0]), "b": np.append(ids[root[hit]], maybe[:, 1]), "n": np.append(count[hit], np.full(len(maybe), -1))})

    found = cut(node_pairs(distinct, cosine, "embedding").groupBy("w", "lo", "hi").applyInArrow(run, "a long, b long, n long"))
    late = cut(confirmed(found.where("n < 0").select("a", "b"), distinct, cosine, "embedding"))
    sure = found.where("n > 0").unionByName(late.select("a", "b", "n")).unionByName(late.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n")))
    counts = sure.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    # Rows of one id are in one component, as are equal vectors.
    named = vectors.join(distinct, "embedding", "left").select("vec_id", "id", "weight")
    named = cut(named)
    labels = components(sure.select("a", "b").unionByName(named.where("id IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    out = named.join(counts, "id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    top = F.coalesce("component", "vec_id")
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"), top.alias("component_id"), (top == F.col("vec_id")).alias("kept"))
