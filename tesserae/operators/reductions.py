"""Reductions over voxel tables and label images; partial and final aggregation throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stats(x: DataFrame, value: str = "v", include_mask: Column | None = None) -> DataFrame:
    """Mean, population standard deviation, minimum, maximum and count of the (included) voxels."""
    x = x.where(include_mask) if include_mask is not None else x
    return x.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def unique(x: DataFrame, value: str = "label", include_mask: Column | None = None) -> DataFrame:
    """Distinct values and counts; if the mask leaves nothing, one row (0, number of voxels)."""
    kept = (x.where(include_mask) if include_mask is not None else x).groupBy(value).agg(F.count("*").alias("count"))
    if include_mask is None:
        return kept
    none = x.agg(F.count("*").alias("count"), F.sum(include_mask.cast("long")).alias("_m")).where("coalesce(_m, 0) = 0 AND count > 0")
    return kept.unionByName(none.select(F.lit(0).cast(dict(x.dtypes)[value]).alias(value), "count"))


def ranked(values: DataFrame, value: str, start: int = 0) -> DataFrame:
    """(value, new) for a table of distinct values, numbered in order.

    Range partitions are counted first, so rows are numbered inside partitions and not in one task.
    """
    placed = values.select(value).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(value)))
    return inside.join(F.broadcast(before), "_p").select(value, (F.col("_start") + F.col("_r") - 1 + start).cast("long").alias("new"))


def relabel_consecutive(seg: DataFrame, value: str = "label", start_label: int = 0, keep_zeros: bool = True) -> DataFrame:
    """``seg`` with consecutive labels in ``new``: the i-th sorted label becomes start_label + i, 0 stays 0 if zeros are kept."""
    mapping = ranked(seg.select(value).distinct(), value, start_label)
    if keep_zeros:
        mapping = mapping.withColumn("new", F.when(F.col(value) == 0, F.lit(0)).otherwise(F.col("new")))
    return seg.join(mapping, value)


def size_filter(seg: DataFrame, min_size: int | None = None, max_size: int | None = None, value: str = "label", relabel: bool = True) -> DataFrame:
    """Labels outside the size bounds become 0; then labels are made consecutive."""
    if min_size is None and max_size is None:
        raise ValueError("min_size or max_size is needed")
    counts = seg.groupBy(value).agg(F.count("*").alias("_n"))
    bad = F.lit(False)
    if min_size is not None:
        bad = bad | (F.col("_n") < min_size)
    if max_size is not None:
        bad = bad | (F.col("_n") > max_size)
    kept = seg.join(counts, value).withColumn(value, F.when(bad, F.lit(0)).otherwise(F.col(value)).cast("long")).drop("_n")
    return relabel_consecutive(kept, value) if relabel else kept


def size_histogram(seg: DataFrame, bins: int = 10, value: str = "label", ignore_zero: bool = True) -> DataFrame:
    """(bin, edge, n) over the sizes of the labels; edge is the bin's lower end."""
    sizes = (seg.where(F.col(value) != 0) if ignore_zero else seg).groupBy(value).agg(F.count("*").cast("double").alias("s"))
    span = sizes.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    b = F.least(F.floor((F.col("s") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))), F.lit(bins - 1)).cast("long")
    return sizes.crossJoin(F.broadcast(span)).withColumn("bin", b).groupBy("bin", "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("edge"), "n")


def analyse_multicut_problem(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row about a signed graph: nodes, edges, cost statistics, components over attractive edges and the largest one's share."""
    from tesserae.plans.fixpoint import components

    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    sizes = components(edges.where(F.col("w") > threshold), nodes).groupBy("component").agg(F.count("*").alias("s"))
    top = sizes.agg(F.count("*").alias("n_components"), (F.max("s") / F.sum("s")).alias("largest_share"), F.sum("s").alias("n_nodes"))
    return edges.agg(F.count("*").alias("n_edges"), F.max("w").alias("max_cost"), F.min("w").alias("min_cost"), F.avg("w").alias("mean_cost"), F.stddev_pop("w").alias("std_cost")).crossJoin(top)


def parse_visitor_output(lines: DataFrame, value: str = "value") -> DataFrame:
    """(energy, solver_s, total_s) from the log lines that begin with E:."""
    f = F.split(F.trim(value), r"\s+")
    return lines.where(F.col(value).startswith("E:")).select(*[f[k].cast("double").alias(n) for k, n in ((1, "energy"), (3, "solver_s"), (5, "total_s"))])
