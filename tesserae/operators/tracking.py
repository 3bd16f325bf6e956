"""Tracking across frames: candidate edges, relabelling, lineage and track graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.plans.fixpoint import components


def overlap_edges(seg: DataFrame, t: str = "z", on: Sequence[str] = ("y", "x"), label: str = "label") -> DataFrame:
    """(t, source, target, score): overlap of objects in neighbouring frames over the source's size."""
    size = seg.where(F.col(label) != 0).groupBy(t, label).agg(F.count("*").alias("n"))
    nxt = seg.where(F.col(label) != 0).select((F.col(t) - 1).alias(t), *on, F.col(label).alias("target"))
    both = seg.where(F.col(label) != 0).join(nxt, [t, *on]).groupBy(t, label, "target").agg(F.count("*").alias("o"))
    return both.join(size, [t, label]).select(F.col(t).alias("t"), F.col(label).alias("source"), "target", (F.col("o") / F.col("n")).alias("score"))


def centroids(seg: DataFrame, t: str = "z", on: Sequence[str] = ("y", "x"), label: str = "label") -> DataFrame:
    return seg.where(F.col(label) != 0).groupBy(F.col(t).alias("t"), F.col(label).alias("label")).agg(*[F.avg(c).alias(c) for c in on])


def centroid_edges(seg: DataFrame, max_distance: float, normalize: bool = True, t: str = "z", on: Sequence[str] = ("y", "x"), label: str = "label") -> DataFrame:
    """(t, source, target, score) of objects in neighbouring frames whose centroids are near.

    Centroids are binned into cells of the maximal distance, so only neighbouring cells are compared.
    """
    c = centroids(seg, t, on, label)
    cell = lambda k: F.floor(F.col(k) / F.lit(float(max_distance))).cast("long")
    a = c.select("t", F.col("label").alias("source"), *[F.col(k).alias(f"a{k}") for k in on], *[cell(k).alias(f"_{k}") for k in on])
    for k in on:
        a = a.withColumn(f"_{k}", F.explode(F.array(*[F.col(f"_{k}") + d for d in (-1, 0, 1)])))
    b = c.select((F.col("t") - 1).alias("t"), F.col("label").alias("target"), *[F.col(k).alias(f"b{k}") for k in on], *[cell(k).alias(f"_{k}") for k in on])
    d = F.sqrt(sum((F.pow(F.col(f"a{k}") - F.col(f"b{k}"), 2) for k in on), F.lit(0.0)))
    e = a.join(b, ["t", *[f"_{k}" for k in on]]).withColumn("d", d).where(F.col("d") <= max_distance)
    if not normalize:
        return e.select("t", "source", "target", F.col("d").alias("score"))
    return e.crossJoin(F.broadcast(e.agg(F.max("d").alias("m")))).select("t", "source", "target", (1 - F.col("d") / F.col("m")).alias("score"))


def node_costs(x: DataFrame, prob: str = "raw", label: str = "label") -> DataFrame:
    return x.where(F.col(label) != 0).groupBy(F.col(label).alias("node")).agg(F.avg(prob).alias("cost"))


def relabel_across_time(seg: DataFrame, t: str = "z", label: str = "label") -> DataFrame:
    """Labels consecutive per frame, on top of the frame before's largest; a frame without objects restarts at 0.

    Only the table of distinct (frame, label) pairs is ranked, one window per frame.
    """
    pairs = seg.where(F.col(label) != 0).select(t, label).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(t).orderBy(label)))
    frames = seg.select(t).distinct().join(pairs.groupBy(t).agg(F.max("_r").alias("n")), t, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy(t)
    runs = frames.withColumn("_g", F.sum((F.col("n") == 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = runs.withColumn("_o", F.coalesce(F.sum("n").over(Window.partitionBy("_g").orderBy(t).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(t, "_o")
    mapping = pairs.join(starts, t).select(t, label, (F.col("_r") + F.col("_o")).cast("long").alias("new"))
    return seg.join(mapping, [t, label], "left").withColumn("new", F.coalesce("new", F.lit(0)))


def lineage_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the selected edges (source, target)."""
    return components(edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")))


def track_edges(edges: DataFrame) -> DataFrame:
    """Edges whose source has one target: those inside tracks."""
    one = edges.groupBy("source").agg(F.count("*").alias("n")).where("n = 1").select("source")
    return edges.join(one, "source", "left_semi")


def tracks(edges: DataFrame) -> DataFrame:
    """(node, track): tracks end where an object divides."""
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    e = track_edges(edges).select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))
    return components(e, nodes).withColumnRenamed("component", "track")


def parents(edges: DataFrame) -> DataFrame:
    """(track, parent): the tracks that begin at a division and the track that divided."""
    split = edges.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source")
    t = tracks(edges)
    e = edges.join(split, "source", "left_semi")
    return e.join(t.select(F.col("node").alias("source"), F.col("track").alias("parent")), "source").join(t.select(F.col("node").alias("target"), "track"), "target").select("track", "parent").distinct()


def recolor(seg: DataFrame, nodes: DataFrame, label: str = "label") -> DataFrame:
    """Voxels with their object's (node, track) number, 0 where there is none."""
    return seg.join(nodes.select(F.col("node").alias(label), "track"), label, "left").withColumn("track", F.coalesce("track", F.lit(0)))


def track_layer(seg: DataFrame, t: str = "z", on: Sequence[str] = ("y", "x"), label: str = "label") -> DataFrame:
    return centroids(seg, t, on, label).select(F.col("label").alias("track_id"), "t", *on)


def select_edges(edges: DataFrame, min_score: float = 0.5, max_parents: int = 1, max_children: int = 2) -> DataFrame:
    """Greedy selection of candidate edges by score within the limits on parents and children.

    An approximation of the optimal selection: of each target its best sources, then of each source its best targets.
    """
    best = edges.where(F.col("score") > min_score)
    best = best.withColumn("_p", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "source"))).where(F.col("_p") <= max_parents)
    return best.withColumn("_c", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target"))).where(F.col("_c") <= max_children).drop("_p", "_c")
