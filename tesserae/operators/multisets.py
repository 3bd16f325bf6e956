"""Label multisets: per-pixel histograms of labels."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def create(labels: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "label") -> DataFrame:
    return labels.select(*on, F.array(F.struct(F.col(label).cast("long").alias("id"), F.lit(1).alias("count"))).alias("multiset"), F.col(label).cast("long").alias("argmax"))


def entries(ms: DataFrame, on: Sequence[str] = ("y", "x")) -> DataFrame:
    return ms.select(*on, F.explode("multiset").alias("e")).select(*on, "e.id", "e.count")


def downsample(ms: DataFrame, scale: Sequence[int], on: Sequence[str] = ("y", "x"), restrict: int = -1) -> DataFrame:
    """Histograms summed per block; the most frequent ``restrict`` entries stay, ties go to the smallest id."""
    keys = [F.floor(F.col(c) / s).cast("long").alias(c) for c, s in zip(on, scale, strict=True)]
    sums = entries(ms, on).select(*keys, "id", "count").groupBy(*on, "id").agg(F.sum("count").cast("int").alias("count"))
    rank = sums.withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("count"), "id")))
    kept = rank.where(F.col("_r") <= restrict) if restrict > 0 else rank
    return kept.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("multiset"), F.min_by("id", "_r").alias("argmax"))


def merge(parts: Sequence[DataFrame], positions: Sequence[Sequence[int]], chunk: Sequence[int], on: Sequence[str] = ("y", "x")) -> DataFrame:
    out = None
    for ms, p in zip(parts, positions, strict=True):
        moved = ms.withColumns({c: F.col(c) + int(k) * int(n) for c, k, n in zip(on, p, chunk, strict=True)})
        out = moved if out is None else out.unionByName(moved)
    return out


def histogram(ms: DataFrame, on: Sequence[str] = ("y", "x")) -> DataFrame:
    """Summed histogram (id, count) of the rows given."""
    return entries(ms, on).groupBy("id").agg(F.sum("count").alias("count"))


def serialize(argmax: Sequence[int], sets: Sequence[Sequence[tuple[int, int]]]) -> bytes:
    """Big-endian size, argmax and byte offsets of the entries, then little-endian entry lists; equal lists are stored once."""
    lists, at, offsets = b"", {}, []
    for s in sets:
        key = tuple(s)
        if key not in at:
            at[key] = len(lists)
            lists += struct.pack("<i", len(key)) + b"".join(struct.pack("<qi", i, n) for i, n in key)
        offsets.append(at[key])
    return struct.pack(f">i{len(argmax)}q", len(argmax), *argmax) + struct.pack(f">{len(offsets)}i", *offsets) + lists


def deserialize(data: bytes) -> tuple[list[int], list[list[tuple[int, int]]]]:
    (size,) = struct.unpack_from(">i", data)
    argmax = list(struct.unpack_from(f">{size}q", data, 4))
    base = 4 + 12 * size
    out = []
    for o in struct.unpack_from(f">{size}i", data, 4 + 8 * size):
        (n,) = struct.unpack_from("<i", data, base + o)
        out.append([struct.unpack_from("<qi", data, base + o + 4 + 12 * k) for k in range(n)])
    return argmax, out
