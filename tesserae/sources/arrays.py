"""Chunked arrays and image files as voxel tables: one partition's work per chunk or file."""

from __future__ import annotations

import gzip
import json
import math
import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READERS: dict[str, Callable[..., DataFrame]] = {}
AXES = ("z", "y", "x")


def register_filetype(reader: Callable[..., DataFrame], extensions: Sequence[str], overwrite: bool = False) -> None:
    """The first reader registered for an extension stays unless overwritten."""
    for e in extensions:
        if overwrite or e.lower() not in _READERS:
            _READERS[e.lower()] = reader


def supported_extensions() -> list[str]:
    return sorted(_READERS)


def open_file(spark: SparkSession, path: str, ext: str | None = None, **options) -> DataFrame:
    """A voxel table by URI scheme, double suffix or last suffix."""
    if ext is None:
        if "://" in path and path.split("://")[0] + "://" in _READERS:
            ext = path.split("://")[0] + "://"
        else:
            name = os.path.basename(path.rstrip("/")).lower()
            ext = ".nii.gz" if name.endswith(".nii.gz") else os.path.splitext(name)[1]
    reader = _READERS.get(ext.lower())
    if reader is None:
        raise ValueError(f"no reader for {ext!r}; supported: {', '.join(supported_extensions())}")
    return reader(spark, path, **options)


def axes_of(ndim: int) -> list[str]:
    return list(AXES[-ndim:]) if ndim <= 3 else [f"d{k}" for k in range(ndim - 3)] + list(AXES)


def _frame(a: np.ndarray, begin: Sequence[int], names: Sequence[str], roi: dict[str, tuple[int, int]]) -> pd.DataFrame:
    at = np.indices(a.shape).reshape(a.ndim, -1)
    out = pd.DataFrame({c: at[k] + begin[k] for k, c in enumerate(names)} | {"v": a.ravel().astype(float)})
    for c, (lo, hi) in roi.items():
        out = out[(out[c] >= lo) & (out[c] < hi)]
    return out


def _meta(spark: SparkSession, path: str, name: str) -> dict | None:
    """A JSON file of a container, opened by Spark's file system so that any store works."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path, name)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_chunked(spark: SparkSession, path: str, roi: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A zarr v2 or N5 array. Chunks outside the region are not read; missing chunks are the fill value.

    Codecs: none, gzip, zlib and zstd. Absent chunks are filled on the executors.
    """
    roi = roi or {}
    zarr = _meta(spark, path, ".zarray")
    n5 = None if zarr else _meta(spark, path, "attributes.json")
    if not zarr and not n5:
        raise ValueError(f"no array at {path}")
    shape, chunks = (zarr["shape"], zarr["chunks"]) if zarr else (n5["dimensions"][::-1], n5["blockSize"][::-1])
    kind = np.dtype(zarr["dtype"]) if zarr else np.dtype(n5["dataType"]).newbyteorder(">")
    codec = ((zarr.get("compressor") or {}).get("id", "raw")) if zarr else n5.get("compression", {}).get("type", "raw")
    fill = (zarr.get("fill_value") or 0) if zarr else 0
    sep = zarr.get("dimension_separator", ".") if zarr else "/"
    names, ndim = axes_of(len(shape)), len(shape)

    def decode(raw: bytes) -> bytes:
        if codec in ("raw", None):
            return raw
        if codec == "gzip":
            return gzip.decompress(raw)
        if codec == "zlib":
            return zlib.decompress(raw)
        if codec == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        raise ValueError(f"codec {codec}")

    grid = spark.range(1)
    for k, c in enumerate(names):
        lo, hi = roi.get(c, (0, shape[k]))
        grid = grid.withColumn(f"g{k}", F.explode(F.sequence(F.lit(lo // chunks[k]), F.lit(max(lo, hi - 1) // chunks[k]))))
    order = range(ndim) if zarr else reversed(range(ndim))
    grid = grid.withColumn("key", F.concat_ws(sep, *[F.col(f"g{k}").cast("string") for k in order]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("key", F.regexp_extract("path", r"((?:\d+[./])*\d+)$", 1)).select("key", "content")
    joined = grid.join(files, "key", "left").repartition("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                begin = [row[f"g{k}"] * chunks[k] for k in range(ndim)]
                size = [min(chunks[k], shape[k] - begin[k]) for k in range(ndim)]
                raw = row["content"]
                if raw is None:
                    a = np.full(size, fill, float)
                elif zarr:
                    a = np.frombuffer(decode(raw), kind).reshape(chunks, order=zarr.get("order", "C"))[tuple(slice(0, n) for n in size)]
                else:
                    _, n = struct.unpack_from(">HH", raw)
                    dims = struct.unpack_from(f">{n}I", raw, 4)
                    a = np.frombuffer(decode(raw[4 + 4 * n :]), kind).reshape(dims[::-1])
                yield _frame(a, begin, names, roi)

    return joined.mapInPandas(run, ", ".join(f"{c} long" for c in names) + ", v double")


def write_zarr(x: DataFrame, path: str, shape: Sequence[int], chunks: Sequence[int], dtype: str = "<f8", codec: str = "gzip", fill: float = 0) -> None:
    """A zarr v2 array; chunks are encoded on the executors and written by them to the (shared) path."""
    if codec not in ("raw", "gzip", "zlib"):
        raise ValueError(f"chunks can't be encoded by {codec}")
    names = axes_of(len(shape))
    os.makedirs(path, exist_ok=False)
    with open(os.path.join(path, ".zarray"), "w") as f:
        json.dump({"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "order": "C", "fill_value": fill, "filters": None, "compressor": None if codec == "raw" else {"id": codec, "level": 1}}, f)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [int(pdf[f"g{k}"].iloc[0]) for k in range(len(shape))]
        a = np.full(chunks, fill, np.dtype(dtype))
        a[tuple(pdf[c].to_numpy() - g * n for c, g, n in zip(names, key, chunks, strict=True))] = pdf["v"]
        raw = a.tobytes()
        raw = gzip.compress(raw, 1) if codec == "gzip" else zlib.compress(raw, 1) if codec == "zlib" else raw
        target = os.path.join(path, ".".join(map(str, key)))
        with open(f"{target}.part", "wb") as f:
            f.write(raw)
        os.replace(f"{target}.part", target)
        return pd.DataFrame({"key": [".".join(map(str, key))], "bytes": [len(raw)]})

    keyed = x.withColumns({f"g{k}": F.floor(F.col(c) / n).cast("long") for k, (c, n) in enumerate(zip(names, chunks, strict=True))})
    keyed.groupBy(*[f"g{k}" for k in range(len(shape))]).applyInPandas(run, "key string, bytes long").agg(F.count("*")).collect()


def _binary(decode: Callable[[bytes], np.ndarray]) -> Callable[..., DataFrame]:
    def reader(spark: SparkSession, path: str, roi: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for raw in batch["content"]:
                    a = decode(bytes(raw))
                    a = a[None] if a.ndim == 2 else a
                    for z in range(len(a)):
                        yield _frame(a[z : z + 1], (z, 0, 0), AXES, roi or {})

        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "z long, y long, x long, v double")

    return reader


def decode_mrc(raw: bytes) -> np.ndarray:
    """An MRC volume, with its second axis (the first of a plane) flipped."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = ">" if raw[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode = struct.unpack_from(f"{order}4i", raw)
    (extra,) = struct.unpack_from(f"{order}i", raw, 92)
    kind = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}[mode]
    a = np.frombuffer(raw, np.dtype(order + kind), nx * ny * nz, 1024 + extra).reshape(nz, ny, nx)
    return a[:, ::-1] if nz > 1 else a[0, ::-1]


def decode_nifti(raw: bytes) -> np.ndarray:
    """A NIfTI-1 volume in z, y, x order."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    (code,) = struct.unpack_from(f"{order}h", raw, 70)
    (at,) = struct.unpack_from(f"{order}f", raw, 108)
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}[code]
    shape = dim[1 : 1 + dim[0]]
    return np.frombuffer(raw, np.dtype(order + kind), math.prod(shape), int(at)).reshape(shape[::-1])


def decode_npy(raw: bytes) -> np.ndarray:
    import io

    return np.load(io.BytesIO(raw), allow_pickle=False)


def read_stack(spark: SparkSession, pattern: str, decode: Callable[[bytes], np.ndarray] = decode_npy) -> DataFrame:
    """Slices in files, stacked in the order of their paths. Slices of unequal shapes raise an error."""
    from pyspark.sql.window import Window

    files = spark.read.format("binaryFile").load(pattern)
    z = files.select("path").withColumn("z", F.row_number().over(Window.orderBy("path")) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, raw in zip(batch["z"], batch["content"], strict=True):
                yield _frame(decode(bytes(raw))[None], (k, 0, 0), AXES, {})

    return files.join(F.broadcast(z), "path").select("z", "content").mapInPandas(run, "z long, y long, x long, v double")


def _unavailable(what: str) -> Callable[..., DataFrame]:
    def reader(spark: SparkSession, path: str, **options) -> DataFrame:
        raise RuntimeError(f"{what} can't be read here; convert the file to zarr or parquet first")

    return reader


register_filetype(lambda spark, path, **o: spark.read.parquet(path), [".parquet"])
register_filetype(read_chunked, [".zarr", ".zr", ".n5"])
register_filetype(_binary(decode_mrc), [".mrc", ".rec"])
register_filetype(_binary(decode_nifti), [".nii", ".nii.gz"])
register_filetype(_binary(decode_npy), [".npy"])
register_filetype(_unavailable("HDF5"), [".h5", ".hdf", ".hdf5"])
register_filetype(_unavailable("MSR/OBF"), [".msr"])
register_filetype(_unavailable("a remote volume"), ["bossdb://"])
