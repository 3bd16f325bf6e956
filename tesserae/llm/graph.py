"""Connected components and the search for links among rows that share keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import groups, ranges
from tesserae.llm.session import cut


#: Runs up to this size are searched for a possible pair before they are passed on.
SMALL_RUN = 64
#: Edges that one task joins up at most.
FEW = 1 << 14


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) for the edges of one task."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        p, q = up[a], up[b]
        apart = p != q
        if not apart.any():
            return ids, ids[up]
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]


def spanned(edges: DataFrame, batch: int = 1 << 16) -> DataFrame:
    """Edges (u, v), v <= u, with the components and nodes of ``edges``; batch by batch a star for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            size += x.num_rows
            if size >= batch:
                nodes, root = roots(np.concatenate([p for p, _ in held]), np.concatenate([q for _, q in held]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["u", "v"])
                held, size = [], 0
        if size:
            nodes, root = roots(np.concatenate([p for p, _ in held]), np.concatenate([q for _, q in held]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for all nodes of ``edges``; the component is its smallest node.

    Batches of edges become stars where they are read; what is small then is joined up in one task of at
    most ``FEW`` edges. Else large-star and small-star rounds alternate: edges are pointed at the smallest known node until every node points at its component's smallest one.
    Each round is two aggregations with partial sums and two joins on evenly spread node ids; nothing but
    two totals reaches the driver. Empty input gives an empty result, self-loops give their own node.
    """
    pairs = cut(spanned(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null")).distinct())
    if pairs.count() <= few:
        return spanned(pairs.coalesce(1), few).select(F.col("u").alias("node"), F.col("v").alias("component"))
    state, seen = pairs.where("u <> v"), None
    for _ in range(max_rounds):
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        state = cut(small)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def runs_of_keys(keys: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(run, hub, id, load, direct): the rows of ``keys`` that share a key with another id.

    hub is the run's smallest id; direct says whether ``near`` holds for the loads of the row and of its hub.

    ``keys`` has a bucket and a blob of 24-byte entries (key, id, load); equal keys meet in one bucket.
    """

    def find(group: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in group["blob"].to_pylist()])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]  # an id may come more than once
        starts, ends = groups(rows[:, 0])
        first = np.repeat(starts, ends - starts)
        shared = np.repeat(rows[ends - 1, 1] != rows[starts, 1], ends - starts)
        rows, hub = rows[shared], rows[first[shared]]
        direct = near(hub[:, 2], rows[:, 2]) & (hub[:, 1] != rows[:, 1])
        # Rows that no row of their run can be linked with only share the key by chance; runs too long to test keep all.
        starts, ends = groups(rows[:, 0])
        size = np.repeat(ends - starts, ends - starts)
        keep = np.logical_or.reduceat(direct, starts)[np.repeat(np.arange(len(starts)), ends - starts)] if len(starts) else direct
        keep |= size > SMALL_RUN
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            if 2 < j - i <= SMALL_RUN and not keep[i]:
                load, ids = rows[i:j, 2], rows[i:j, 1]
                left, right = np.triu_indices(j - i, 1)
                keep[i:j] = (near(load[left], load[right]) & (ids[left] != ids[right])).any()
        rows, hub, direct = rows[keep], hub[keep], direct[keep]
        return pa.table({"run": rows[:, 0], "hub": hub[:, 1], "id": rows[:, 1], "load": rows[:, 2], "direct": direct})

    return keys.groupBy("bucket").applyInArrow(find, "run long, hub long, id long, load long, direct boolean")


def pack(key: np.ndarray, ids: np.ndarray, load: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One blob of (key, id, load) for each bucket, as ``runs_of_keys`` reads them."""
    bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    rows = np.empty((len(order), 3), "<i8")
    rows[:, 0], rows[:, 1], rows[:, 2] = key[order].view(np.int64), ids[order], load[order]
    starts, ends = groups(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([rows[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "blob"])


def links(runs: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 2048, sketches: DataFrame | None = None, enough: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Verified links (a, b) that connect all rows which some run brings together and ``verify`` accepts.

    First every row is compared with the hubs of its runs. Rows then known to be connected need no
    further test; all other pairs of a run are tested directly, in blocks of ``block`` rows, so that
    no pair that could join two components is skipped and no group of copies is spelt out pairwise.
    ``near`` is a cheap vectorised test of two loads, ``verify`` maps pairs (a, b) to those that hold.

    ``sketches`` (id, codes) holds the 16-bit codes of each row's elements. With it a block passes on only
    the pairs for which ``enough(load, loads, shared)`` holds; equal elements have equal codes, so that
    ``shared`` is never below the true number and no pair that ``verify`` would accept is missed.
    """
    first = cut(runs.where("direct").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    held = cut(verify(first))
    known = components(held)
    tagged = runs.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = tagged.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi AND n > 2")  # a run of two has no pair but its hub's
    open_ = tagged.join(mixed, "run").withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    if sketches is not None:
        open_ = open_.join(sketches, "id")
    else:
        open_ = open_.withColumn("codes", F.lit(None).cast("binary"))
    placed = open_.select("run", "id", "load", "component", "codes", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other")).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    sketched = sketches is not None

    def cross(group: pa.Table) -> pa.Table:
        ids, load, comp, part, lo, hi = (group[c].to_numpy() for c in ("id", "load", "component", "part", "lo", "hi"))
        left, right = np.flatnonzero(part == lo[0]), np.flatnonzero(part == hi[0])
        found = [np.zeros((0, 2), np.int64)]
        blobs = group["codes"].to_pylist() if sketched else []
        codes = np.frombuffer(b"".join(blobs), "<u2")
        counts = np.array([len(x) // 2 for x in blobs], np.int64)
        begin, marked = np.cumsum(counts) - counts, np.zeros(1 << 16, bool)
        for i in left:
            js = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (lo[0] != hi[0]))]
            js = js[near(np.full(len(js), load[i]), load[js])]
            if sketched and len(js):
                own = codes[begin[i] : begin[i] + counts[i]]
                marked[own] = True
                shared = np.add.reduceat(marked[codes[ranges(begin[js], counts[js])]], np.cumsum(counts[js]) - counts[js], dtype=np.int64)
                marked[own] = False
                js = js[enough(load[i], load[js], shared)]
            found.append(np.column_stack([np.minimum(ids[i], ids[js]), np.maximum(ids[i], ids[js])]))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rest = placed.groupBy("run", "lo", "hi").applyInArrow(cross, "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    return held.unionByName(cut(verify(cut(rest))))
