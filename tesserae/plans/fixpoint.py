"""Iterations to a fixed point with lineage cuts, and neighbour joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task joins up at most: two arrays of 8 MB.
ONE_TASK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a checkpoint, what is read back has the size of its files as statistics. A checkpointed plan keeps
    the estimate of the plan it replaces; in a loop with joins that estimate is squared every round.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


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


def spanned(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v the smaller one, with the components of ``edges`` but at most one edge per node and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u, v = roots(np.append(u, batch.column(0).to_numpy()), np.append(v, batch.column(1).to_numpy()))
            u, v = u[u != v], v[u != v]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, nodes: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node that is reachable over ``edges`` (u, v); ``nodes`` adds isolated ones.

    Each partition first leaves a spanning forest of its edges; forests are merged while that makes them fewer, in
    tasks of bounded size. Up to ``one_task`` edges are then joined up in one task. While there are more, a coin is
    thrown for every node, nodes of one side become one with a neighbour of the other, and only edges between
    different ones stay: at least a quarter of the nodes goes each round on average, however long the paths are.
    """
    kind = edges.schema["u"].dataType
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(F.col("node").cast(kind)))
    ends = ends.distinct()
    pairs = cut(spanned(edges))
    left, hooks = pairs.count(), []
    while left > one_task > 0:
        merged = cut(spanned(pairs.repartition(-(-left // one_task))))
        was, left, pairs = left, merged.count(), merged
        if left > 0.9 * was:
            break
    while left > one_task:
        side = lambda c: F.xxhash64(c, F.lit(len(hooks))).bitwiseAND(1)
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        hook = cut(both.where((side("u") == 0) & (side("v") == 1)).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up")))
        at = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: B023, E731
        pairs = cut(spanned(pairs.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("up_u", "u").alias("u"), F.coalesce("up_v", "v").alias("v"))))
        hooks.append(hook)
        left = pairs.count()
    found = spanned(pairs.coalesce(1)).withColumnsRenamed({"u": "node", "v": "component"})
    if not hooks:
        return ends.join(found, "node", "left").select("node", F.coalesce("component", "node").cast(kind).alias("component"))
    # Back from the last round: a node has the component of what it became one with; names are the smallest nodes in the end.
    found = cut(found)
    for hook in reversed(hooks):
        mine = hook.join(found.withColumnRenamed("node", "up"), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
        found = cut(found.unionByName(mine))
    state = cut(ends.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("k")))
    low = state.groupBy("k").agg(F.min("node").alias("component"))
    return state.join(low, "k").select("node", F.col("component").cast(kind).alias("component"))


def neighbours(cells: DataFrame, offsets: Sequence[Sequence[int]], on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows (on, offset number, value_a, value_b) of every cell and the cell at each offset from it; one equi-join per offset."""
    parts = []
    for k, offset in enumerate(offsets):
        other = cells.select(*[(F.col(c) - int(d)).alias(c) for c, d in zip(on, offset, strict=True)], *[F.col(v).alias(f"{v}_b") for v in values])
        parts.append(cells.select(*on, *[F.col(v).alias(f"{v}_a") for v in values]).join(other, list(on)).withColumn("offset", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def unit_offsets(ndim: int) -> list[list[int]]:
    return [[int(i == d) for i in range(ndim)] for d in range(ndim)]
