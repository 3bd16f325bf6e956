import struct

import numpy as np
import pytest

from tesserae.sources import arrays, geometry


def test_zarr_round_trip(spark, tmp_path):
    a = np.arange(6 * 7, dtype=float).reshape(6, 7)
    df = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(6) for x in range(7)], "y long, x long, v double")
    path = str(tmp_path / "a.zarr")
    arrays.write_zarr(df, path, (6, 7), (4, 3))
    got = {(r["y"], r["x"]): r["v"] for r in arrays.open_file(spark, path).collect()}
    assert got == {(y, x): a[y, x] for y in range(6) for x in range(7)}
    part = arrays.read_chunked(spark, path, {"y": (2, 5), "x": (1, 2)}).collect()
    assert sorted((r["y"], r["x"]) for r in part) == [(2, 1), (3, 1), (4, 1)]


def test_mrc(spark, tmp_path):
    a = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 4, 3, 2, 2)
    (tmp_path / "a.mrc").write_bytes(bytes(head) + a.tobytes())
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in arrays.open_file(spark, str(tmp_path / "a.mrc")).collect()}
    assert got[(0, 0, 0)] == a[0, 2, 0] and len(got) == 24


def test_unknown(spark):
    with pytest.raises(ValueError):
        arrays.open_file(spark, "x.unknown")
    with pytest.raises(RuntimeError):
        arrays.open_file(spark, "x.h5")


def test_mesh(spark, tmp_path):
    (tmp_path / "t.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nv 0 0 1\nf 1 2 3\nf 1 2 4\nf 1 3 4\nf 2 3 4\n")
    v, f = geometry.read_obj(spark, str(tmp_path / "t.obj"))
    out = geometry.smooth_mesh(v, f).collect()
    assert len(out) == 4 and all(r["z"] == r["y"] == r["x"] == 0.25 for r in out)


def test_swc(spark, tmp_path):
    (tmp_path / "s.swc").write_text("# head\n1 0 1 2 3 0.5 -1\n2 0 4 5 6 0.5 1\n")
    assert [(r["id"], r["z"], r["parent"]) for r in geometry.read_swc(spark, str(tmp_path / "s.swc")).orderBy("id").collect()] == [(1, 3.0, -1), (2, 6.0, 1)]


def test_wells(spark):
    w = spark.createDataFrame([("A0",), ("B0",), ("A1",)], "name string")
    assert [tuple(r)[1:] for r in geometry.well_positions(w).collect()] == [(0, 0), (1, 0), (0, 1)]
