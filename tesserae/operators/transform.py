"""Affine matrices on the driver, and resampling of voxel tables by them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_2d(scale: Sequence[float] | None = None, rotation: float | None = None, shear: float | None = None, translation: Sequence[float] | None = None, degrees: bool = True) -> np.ndarray:
    sy, sx = scale or (1.0, 1.0)
    r, h = (np.deg2rad(a or 0.0) if degrees else (a or 0.0) for a in (rotation, shear))
    m = np.eye(3)
    m[0, :2] = sy * np.cos(r), -sx * np.sin(r + h)
    m[1, :2] = sy * np.sin(r), sx * np.cos(r + h)
    m[:2, 2] = translation or (0.0, 0.0)
    return m


def apply_matrix(coords: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.asarray(coords, float) @ m[:-1, :-1].T + m[:-1, -1]


def roi_of(start: Sequence[float], stop: Sequence[float], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounding box of the transformed corners."""
    corners = apply_matrix(np.array(list(itertools.product(*zip(start, stop, strict=True)))), m)
    return corners.min(axis=0), corners.max(axis=0)


def translation_of(m: np.ndarray) -> np.ndarray:
    return m[:-1, -1].copy()


def scale_of(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m[:-1, :-1] ** 2).sum(axis=0))


def parameters(m: np.ndarray) -> list[float]:
    """The first rows of the matrix as a flat vector (6 or 12 numbers)."""
    return m[:-1].ravel().tolist()


def from_parameters(p: Sequence[float]) -> np.ndarray:
    n = {6: 2, 12: 3}[len(p)]
    return np.vstack([np.reshape(p, (n, n + 1)), np.eye(n + 1)[-1]])


def reversed_axes(m: np.ndarray) -> np.ndarray:
    """The matrix for coordinates in the opposite axis order (z,y,x and x,y,z)."""
    n = len(m) - 1
    p = np.eye(n + 1)
    p[:n, :n] = p[:n, :n][::-1]
    return p @ m @ p


def to_physical(m: np.ndarray, resolution: Sequence[float]) -> np.ndarray:
    """A voxel-space matrix in physical units."""
    s = np.diag([*resolution, 1.0])
    return s @ m @ np.linalg.inv(s)


def to_voxel(m: np.ndarray, resolution: Sequence[float]) -> np.ndarray:
    s = np.diag([*resolution, 1.0])
    return np.linalg.inv(s) @ m @ s


def from_ngff(multiscales: dict, level: int = 0, axes: Sequence[str] = ("z", "y", "x")) -> np.ndarray:
    """Matrix of the scale and translation of a multiscale entry (version 0.4)."""
    names = [a["name"] if isinstance(a, dict) else a for a in multiscales["axes"]]
    m = np.eye(len(axes) + 1)
    for t in [*multiscales["datasets"][level].get("coordinateTransformations", []), *multiscales.get("coordinateTransformations", [])]:
        v = [t[t["type"]][names.index(a)] for a in axes] if t["type"] in ("scale", "translation") else None
        if v is not None:
            step = np.diag([*v, 1.0]) if t["type"] == "scale" else np.eye(len(axes) + 1)
            if t["type"] == "translation":
                step[:-1, -1] = v
            m = step @ m
    return m


def to_ngff(m: np.ndarray) -> list[dict]:
    return [{"type": "scale", "scale": scale_of(m).tolist()}, {"type": "translation", "translation": translation_of(m).tolist()}]


def affine(x: DataFrame, m: np.ndarray, shape: dict[str, int], source_shape: dict[str, int], order: int = 0, fill: float = 0.0, value: str = "v") -> DataFrame:
    """``x`` resampled on a grid of ``shape``; each output voxel looks up matrix * coordinate.

    Order 0 joins the rounded coordinate, order 1 the corners around it with their weights. A source
    coordinate outside [0, n - 1] gives ``fill``. Only the source region that the grid maps to is read.
    """
    axes = list(shape)
    lo, hi = roi_of([0] * len(axes), [n - 1 for n in shape.values()], m)
    for c, a, b in zip(axes, lo, hi, strict=True):
        x = x.where(F.col(c).between(int(np.floor(a)) - 1, int(np.ceil(b)) + 1))
    grid = x.sparkSession.range(1)
    for c, n in shape.items():
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    src = [sum((F.lit(float(m[i, j])) * F.col(a) for j, a in enumerate(axes)), F.lit(float(m[i, -1]))) for i in range(len(axes))]
    placed = grid.drop("id").withColumns({f"_s{i}": F.round(e, 9) for i, e in enumerate(src)})
    inside = F.lit(True)
    for i, c in enumerate(axes):
        inside = inside & F.col(f"_s{i}").between(0, source_shape[c] - 1)
    values = x.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(axes)], F.col(value).cast("double").alias("_v"))
    keys = [f"_t{i}" for i in range(len(axes))]
    if order == 0:
        near = placed.withColumns({f"_t{i}": F.floor(F.col(f"_s{i}") + 0.5).cast("long") for i in range(len(axes))})
        return near.join(values, keys, "left").select(*axes, F.when(inside, F.coalesce("_v", F.lit(fill))).otherwise(fill).alias(value))
    if order != 1:
        raise NotImplementedError("orders above 1")
    corners = placed.where(inside).withColumn("_w", F.lit(1.0))
    for i in range(len(axes)):
        f = F.col(f"_s{i}") - F.floor(f"_s{i}")
        both = F.array(F.struct(F.floor(f"_s{i}").cast("long").alias("t"), (1 - f).alias("w")), F.struct((F.floor(f"_s{i}") + 1).cast("long").alias("t"), f.alias("w")))
        corners = corners.withColumn("_c", F.explode(F.filter(both, lambda c: c.w > 0))).withColumn(f"_t{i}", F.col("_c.t")).withColumn("_w", F.col("_w") * F.col("_c.w"))
    sums = corners.join(values, keys).groupBy(*axes).agg(F.sum(F.col("_w") * F.col("_v")).alias(value))
    return placed.select(*axes).join(sums, axes, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def resize(x: DataFrame, shape: dict[str, int], source_shape: dict[str, int], order: int = 0, value: str = "v") -> DataFrame:
    return affine(x, np.diag([*[source_shape[c] / n for c, n in shape.items()], 1.0]), shape, source_shape, order, value=value)
