"""Element-wise operators, lazy views and masks over voxel tables (one row per coordinate)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide_(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is a signed infinity, 0/0 is not a number."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(b) | F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))


def _nan(a: Column, b: Column, value: Column) -> Column:
    bad = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
    return F.when(bad, F.lit(NAN)).otherwise(value.cast("double"))


OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide_,
    "greater": lambda a, b: (a > b).cast("int"),
    "greater_equal": lambda a, b: (a >= b).cast("int"),
    "less": lambda a, b: (a < b).cast("int"),
    "less_equal": lambda a, b: (a <= b).cast("int"),
    "minimum": lambda a, b: _nan(a, b, F.least(a, b)),
    "maximum": lambda a, b: _nan(a, b, F.greatest(a, b)),
}


def apply_operation(x: DataFrame, y: DataFrame | float, operation: str | Callable[[Column, Column], Column], on: Sequence[str] = ("z", "y", "x"), value: str = "v", broadcast_on: Sequence[str] | None = None, include_mask: str | None = None) -> DataFrame:
    """``x`` combined with a scalar or with ``y``; ``broadcast_on`` names the coordinates in which ``y`` is not of size one."""
    if broadcast_on is not None and include_mask:
        raise NotImplementedError("a mask can't be combined with a broadcast operand")
    f = OPERATIONS[operation] if isinstance(operation, str) else operation
    if isinstance(y, DataFrame):
        keys = list(broadcast_on if broadcast_on is not None else on)
        joined = x.join(y.select(*keys, F.col(value).alias("_other")), keys)
        new = f(F.col(value), F.col("_other"))
    else:
        joined, new = x, f(F.col(value), F.lit(y))
    if include_mask:
        new = F.when(F.col(include_mask), new).otherwise(F.col(value))
    return joined.withColumn(value, new).drop("_other")


def apply_operation_single(x: DataFrame, operation: Callable[[Column], Column], on: Sequence[str] = ("z", "y", "x"), value: str = "v", axis: str | None = None, exclude_mask: str | None = None) -> DataFrame:
    """A unary operation, or with ``axis`` a reduction over that coordinate; masked voxels become 0."""
    if axis is not None:
        return x.groupBy(*[c for c in on if c != axis]).agg(operation(F.col(value)).alias(value))
    new = operation(F.col(value))
    return x.withColumn(value, F.when(F.col(exclude_mask), F.lit(0)).otherwise(new) if exclude_mask else new)


def isin(x: DataFrame, values: DataFrame | Sequence, value: str = "v") -> DataFrame:
    """Whether each value is among ``values``, a list or a one-column table."""
    if not isinstance(values, DataFrame):
        return x.withColumn("isin", F.col(value).isin(list(values)))
    known = values.select(F.col(values.columns[0]).alias(value)).distinct().withColumn("_hit", F.lit(True))
    return x.join(known, value, "left").withColumn("isin", F.coalesce("_hit", F.lit(False))).drop("_hit")


def normalize(x: DataFrame, value: str = "v", eps: float = 1e-7) -> DataFrame:
    """(v - min) / (max - min + eps) over the rows given."""
    bounds = x.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return x.crossJoin(F.broadcast(bounds)).withColumn(value, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps))).drop("_lo", "_hi")


def sharpen_edges(x: DataFrame, percentile: float = 95, clip: bool = True, value: str = "v") -> DataFrame:
    """Values over their percentile, clipped to 0..1."""
    scale = x.agg(F.percentile(value, F.lit(percentile / 100)).alias("_p"))
    new = F.col(value) / F.col("_p")
    return x.crossJoin(F.broadcast(scale)).withColumn(value, F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0)) if clip else new).drop("_p")


def map_background_to_zero(seg: DataFrame, value: str = "label", background: int | None = None) -> DataFrame:
    """Swaps the background (by default the most frequent label, ties: smallest) with 0."""
    if background is None:
        top = seg.groupBy(F.col(value).alias("_bg")).count().orderBy(F.desc("count"), "_bg").limit(1).select("_bg")
    else:
        top = seg.sparkSession.range(1).select(F.lit(background).alias("_bg"))
    new = F.when(F.col(value) == F.col("_bg"), F.lit(0)).when(F.col(value) == 0, F.col("_bg")).otherwise(F.col(value))
    return seg.crossJoin(F.broadcast(top)).withColumn(value, new.cast("long")).drop("_bg")


def discriminative_loss_weight(dist: Column, delta: float) -> Column:
    return 1 - F.pow(F.greatest((2 * delta - dist) / (2 * delta), F.lit(0.0)), F.lit(2))


def threshold(x: DataFrame, t: float, operator: str = ">", value: str = "v") -> DataFrame:
    c = F.col(value)
    return x.withColumn(value, {">": c > t, ">=": c >= t, "<": c < t, "<=": c <= t}[operator])


def roi(x: DataFrame, begin: dict[str, int], end: dict[str, int], rebase: bool = True, squeeze: bool = False) -> DataFrame:
    """Sub-volume; the comparison reaches the scan as a pushed filter."""
    for c in begin:
        x = x.where((F.col(c) >= begin[c]) & (F.col(c) < end[c]))
    if rebase:
        x = x.withColumns({c: F.col(c) - begin[c] for c in begin})
    return x.drop(*[c for c in begin if end[c] - begin[c] == 1]) if squeeze else x


def write_roi(x: DataFrame, patch: DataFrame, begin: dict[str, int], on: Sequence[str]) -> DataFrame:
    """``x`` with the re-based ``patch`` written over it."""
    moved = patch.withColumns({c: F.col(c) + begin[c] for c in begin})
    return x.join(moved, list(on), "left_anti").unionByName(moved)


def pad(x: DataFrame, shape: dict[str, int], width: dict[str, int], value: str = "v", mode: str = "constant", fill: float = 0) -> DataFrame:
    """Padding to the right by a constant or by the edge value."""
    grid = x.sparkSession.range(1)
    for c, n in shape.items():
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n + width.get(c, 0) - 1).cast("long"))))
    grid = grid.drop("id")
    if mode == "edge":
        src = grid.withColumns({f"_{c}": F.least(F.col(c), F.lit(n - 1)) for c, n in shape.items()})
        return src.join(x.select(*[F.col(c).alias(f"_{c}") for c in shape], value), [f"_{c}" for c in shape]).select(*shape, value)
    if mode != "constant":
        raise NotImplementedError(mode)
    return grid.join(x.select(*shape, value), list(shape), "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def multi_transform(f: Callable[..., Column], *volumes: DataFrame, on: Sequence[str], value: str = "v") -> DataFrame:
    """f over several volumes with equal coordinates."""
    joined = volumes[0].select(*on, F.col(value).alias("_v0"))
    for k, v in enumerate(volumes[1:], 1):
        joined = joined.join(v.select(*on, F.col(value).alias(f"_v{k}")), list(on))
    return joined.select(*on, f(*[F.col(f"_v{k}") for k in range(len(volumes))]).alias(value))


def segmentation_filter(seg: DataFrame, f: Callable, block: Sequence[int], on: Sequence[str] = ("y", "x"), label: str = "label") -> DataFrame:
    """A callable on the (pandas) rows of each block that returns them with labels set to 0 where filtered."""
    keyed = seg.withColumn("_block", F.concat_ws("_", *[F.floor(F.col(c) / b) for c, b in zip(on, block, strict=True)]))
    kept = seg.schema
    return keyed.groupBy("_block").applyInPandas(lambda pdf: f(pdf.drop(columns="_block")), kept)


def copy(x: DataFrame, shift: dict[str, int] | None = None, exclude_mask: str | None = None, value: str = "v") -> DataFrame:
    out = x.withColumns({c: F.col(c) + d for c, d in (shift or {}).items()})
    return out.withColumn(value, F.when(F.col(exclude_mask), F.lit(0)).otherwise(F.col(value))) if exclude_mask else out


def downscale(x: DataFrame, scale: dict[str, int], how: str = "mean", value: str = "v") -> DataFrame:
    """Block reduction; nearest takes each block's first voxel."""
    keys = [F.floor(F.col(c) / s).cast("long").alias(c) for c, s in scale.items()]
    if how == "nearest":
        first = x
        for c, s in scale.items():
            first = first.where(F.col(c) % s == 0)
        return first.select(*keys, value)
    f = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    return x.select(*keys, value).groupBy(*scale).agg(f(value).alias(value))


def random_colors(n: int, seed: int = 0) -> np.ndarray:
    """n random RGB colours; the first, the background, is black."""
    out = np.random.default_rng(seed).random((n, 3))
    out[:1] = 0
    return out
