"""Meshes, skeletons, tracks, plates and registration files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of one text file in order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of an OBJ file; indices from 0, polygons cut to their first three corners."""
    from pyspark.sql.window import Window

    rows = _lines(spark, path).withColumn("f", F.split(F.trim("value"), r"\s+"))
    v = rows.where(F.col("f")[0] == "v").withColumn("i", F.row_number().over(Window.orderBy("pos")) - 1)
    corner = lambda k: (F.split(F.col("f")[k], "/")[0].cast("long") - 1)
    f = rows.where(F.col("f")[0] == "f").select("pos", corner(1).alias("a"), corner(2).alias("b"), corner(3).alias("c"))
    return v.select("i", *[F.col("f")[k + 1].cast("double").alias(c) for k, c in enumerate("zyx")]), f


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, zero_based: bool = False) -> None:
    """Vertices in order of their index, then faces."""
    shift = 0 if zero_based else 1
    v = vertices.select(F.lit(0).alias("k"), F.col("i").alias("n"), F.concat_ws(" ", F.lit("v"), "z", "y", "x").alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("pos").cast("long").alias("n"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + shift).cast("string") for c in "abc"]).alias("value"))
    v.withColumn("n", F.col("n").cast("long")).unionByName(f).orderBy("k", "n").select("value").coalesce(1).write.text(path)


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of an ASCII PLY file."""
    rows = _lines(spark, path)
    head = rows.agg(F.min(F.when(F.col("value") == "end_header", F.col("pos"))).alias("h"), F.max(F.when(F.col("value").startswith("element vertex"), F.split("value", " ")[2].cast("long"))).alias("n"))
    body = rows.crossJoin(F.broadcast(head)).withColumn("i", F.col("pos") - F.col("h") - 1).where("i >= 0 AND value <> ''").withColumn("f", F.split(F.trim("value"), r"\s+"))
    v = body.where("i < n").select("i", *[F.col("f")[k].cast("double").alias(c) for k, c in enumerate("zyx")])
    return v, body.where("i >= n").select((F.col("i") - F.col("n")).alias("pos"), *[F.col("f")[k + 1].cast("long").alias(c) for k, c in enumerate("abc")])


def smooth_mesh(vertices: DataFrame, faces: DataFrame, iterations: int = 1) -> DataFrame:
    """Vertices moved to the mean of themselves and their neighbours, again and again."""
    pairs = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a in "abc" for b in "abc" if a != b])
    near = faces.select(F.explode(pairs).alias("e")).select("e.*").distinct()
    near = near.unionByName(vertices.select("i", F.col("i").alias("j")))
    for _ in range(iterations):
        vertices = near.join(vertices.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*[F.avg(c).alias(c) for c in "zyx"])
    return vertices


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, z, y, x, radius, parent) of an SWC file; comment lines are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    names = [("id", "long"), ("type", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double"), ("parent", "long")]
    return spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(*[f[k].cast(t).alias(n) for k, (n, t) in enumerate(names)])


def swc_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent): the smallest neighbour of nodes with at least two neighbours, else -1."""
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("n")).unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("n"))).distinct()
    low = both.groupBy("id").agg(F.min("n").alias("m"), F.count("*").alias("k"))
    return nodes.select("id").join(low, "id", "left").select("id", F.when(F.col("k") >= 2, F.col("m")).otherwise(-1).cast("long").alias("parent"))


def write_swc(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    rows = nodes.join(swc_parents(nodes, edges), "id").orderBy("id")
    rows.select(F.concat_ws(" ", F.col("id").cast("string"), F.lit("0"), "x", "y", "z", F.lit("0"), F.col("parent").cast("string")).alias("value")).coalesce(1).write.text(path)


def skeleton_to_array(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(values): [n, 3n coordinates, m, 2m edges] of a skeleton, as variable-length chunks store it."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "z", "y", "x"))).alias("n"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("e"))
    flat = F.concat(F.array(F.size("n").cast("double")), F.flatten(F.transform("n", lambda r: F.array(r.z, r.y, r.x))), F.array(F.size("e").cast("double")), F.flatten(F.transform("e", lambda r: F.array(r.u.cast("double"), r.v.cast("double")))))
    return n.crossJoin(e).select(flat.alias("values"))


def array_to_skeleton(chunk: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.col("values")[0].cast("int")
    nodes = chunk.where("size(values) > 0").select(F.posexplode(F.expr("transform(sequence(0, cast(values[0] as int) - 1), i -> slice(values, 2 + 3 * i, 3))")).alias("id", "c")).select("id", *[F.col("c")[k].alias(a) for k, a in enumerate("zyx")])
    start = 2 + 3 * n
    edges = chunk.where("size(values) > 0").withColumn("_s", start).where("values[_s - 1] > 0").select(F.explode(F.expr("transform(sequence(0, cast(values[_s - 1] as int) - 1), i -> slice(values, _s + 1 + 2 * i, 2))")).alias("c"))
    return nodes, edges.select(F.col("c")[0].cast("long").alias("u"), F.col("c")[1].cast("long").alias("v"))


def read_nml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (thing, id, z, y, x), edges (thing, u, v)) of an NML file."""
    things = spark.read.format("xml").option("rowTag", "thing").option("attributePrefix", "_").load(path)
    nodes = things.select(F.col("_id").alias("thing"), F.explode("nodes.node").alias("n")).select("thing", F.col("n._id").cast("long").alias("id"), *[F.col(f"n._{a}").cast("double").alias(a) for a in "zyx"])
    edges = things.select(F.col("_id").alias("thing"), F.explode("edges.edge").alias("e")).select("thing", F.col("e._source").cast("long").alias("u"), F.col("e._target").cast("long").alias("v"))
    return nodes, edges


def mamut_voxels(spots: DataFrame, edges: DataFrame, frame: int, voxel_size: dict[str, float], binary: bool = False) -> DataFrame:
    """(z, y, x, track) of a frame's spots (id, frame, z, y, x); spots without an edge (track, source, target) get 0."""
    at = spots.where(F.col("frame") == frame)
    if at.isEmpty():
        raise RuntimeError(f"no frame {frame}")
    tracks = edges.select(F.explode(F.array("source", "target")).alias("id"), "track").distinct()
    v = F.lit(1).cast("long") if binary else F.coalesce("track", F.lit(0)).cast("long")
    return at.join(tracks, "id", "left").select(*[(F.col(a) / voxel_size[a]).cast("long").alias(a) for a in "zyx"], v.alias("track"))


def plate_wells(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, well): the file name up to its first underscore."""
    return files.select(path, F.regexp_extract(F.regexp_extract(path, r"([^/]+)$", 1), r"^([^_.]+)", 1).alias("well"))


def well_positions(wells: DataFrame, name: str = "name", zero_based: bool = True) -> DataFrame:
    """(name, row, column) from a letter and digits."""
    return wells.select(name, (F.ascii(F.substring(name, 1, 1)) - 65).alias("row"), (F.regexp_extract(name, r"(\d+)$", 1).cast("int") - (0 if zero_based else 1)).alias("column"))


def grid_positions(images: DataFrame, index: str, shape: tuple[int, int], columns: int, spacing: int = 16) -> DataFrame:
    h, w = shape
    return images.withColumns({"py": F.floor(F.col(index) / columns) * (h + spacing), "px": F.col(index) % columns * (w + spacing)})


def elastix_parameters(lines: DataFrame) -> DataFrame:
    """(key, values) of a transform parameter file."""
    m = lines.select(F.regexp_extract("value", r"^\((\S+)\s+(.*)\)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\((\S+)\s+(.*)\)\s*$", 2).alias("rest")).where("key <> ''")
    return m.select("key", F.split(F.regexp_replace(F.trim("rest"), '"', ""), r"\s+").alias("values"))


def carved_object(watershed: DataFrame, supervoxels: DataFrame, label: str = "label") -> DataFrame:
    """The voxels of an object given as a list of supervoxels."""
    return watershed.join(supervoxels.select(F.col(supervoxels.columns[0]).alias(label)), label, "left_semi").withColumn("object", F.lit(1))
