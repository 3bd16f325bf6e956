"""Region adjacency graphs, region and edge features, label transfer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.plans.fixpoint import neighbours, unit_offsets

PERCENTILES = [0.05, 0.10, 0.25, 0.75, 0.90, 0.95]


def canonical(pairs: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), *rest)


def faces(seg: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg", values: Sequence[str] = ()) -> DataFrame:
    """Face-adjacent voxel pairs with different labels, in canonical order, with both values."""
    near = neighbours(seg, unit_offsets(len(on)), on, [label, *values]).where(F.col(f"{label}_a") != F.col(f"{label}_b"))
    return canonical(near, f"{label}_a", f"{label}_b", *on, "offset", *[f"{v}_{s}" for v in values for s in "ab"])


def rag(seg: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg") -> DataFrame:
    """(u, v) of the region adjacency graph, label 0 included."""
    return faces(seg, on, label).select("u", "v").distinct()


def boundary_samples(seg: DataFrame, on: Sequence[str], label: str, value: str, samples: str = "both") -> DataFrame:
    """Samples (u, v, s) along boundaries: both end values of each face, or their mean."""
    f = faces(seg, on, label, [value])
    a, b = F.col(f"{value}_a").cast("double"), F.col(f"{value}_b").cast("double")
    return f.select("u", "v", F.explode(F.array(a, b)).alias("s")) if samples == "both" else f.select("u", "v", ((a + b) / 2).alias("s"))


def mean_and_length(seg: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg", value: str = "raw", samples: str = "both") -> DataFrame:
    return boundary_samples(seg, on, label, value, samples).groupBy("u", "v").agg(F.avg("s").alias("mean"), F.count("*").alias("size"))


def twelve(samples: DataFrame, keys: Sequence[str] = ("u", "v"), value: str = "s") -> DataFrame:
    """The twelve edge features: mean, median, std, min, max, six percentiles, size."""
    p = F.percentile(value, F.array(*[F.lit(q) for q in [0.5, *PERCENTILES]]))
    out = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("size"), p.alias("_p"))
    names = ["median", "p5", "p10", "p25", "p75", "p90", "p95"]
    return out.select(*keys, "mean", *[F.col("_p")[k].alias(n) for k, n in enumerate(names)][:1], "std", "min", "max", *[F.col("_p")[k].alias(n) for k, n in enumerate(names)][1:], "size")


def boundary_features(seg: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg", value: str = "raw") -> DataFrame:
    return twelve(boundary_samples(seg, on, label, value))


#: Filters and their scales.
FILTERS = {"gaussian_smoothing": [1.6, 4.2, 8.3], "laplacian_of_gaussian": [1.6, 4.2, 8.3], "hessian_of_gaussian_eigenvalues": [1.6, 4.2, 8.3]}


def boundary_features_with_filters(seg: DataFrame, block: Sequence[int], on: Sequence[str] = ("y", "x"), label: str = "seg", value: str = "raw", filters: dict[str, list[float]] = FILTERS, apply_2d: bool = False) -> DataFrame:  # noqa: B006
    """(u, v, size, features): eleven boundary features of every response of every filter, named filter_scale_channel_feature.

    All responses are joined to the labels once and accumulated along the boundaries in one pass. ``apply_2d``
    filters each plane of the first axis by itself.
    """
    from tesserae.operators.neighbourhood import apply_filter, channels

    axes = list(on)[1:] if apply_2d else list(on)
    wide, names = seg.select(*on, label), []
    for name, scales in filters.items():
        for sigma in scales:
            for k in range(channels(name, len(axes))):
                names.append(f"{name}_{str(sigma).replace('.', '_')}_{k}")
                response = apply_filter(seg, name, sigma, [1, *block[1:]] if apply_2d else block, on, value, k, int(apply_2d))
                wide = wide.join(response.withColumnRenamed("response", names[-1]), list(on))
    f = faces(wide, on, label, names)
    out = None
    for n in names:
        samples = f.select("u", "v", F.explode(F.array(F.col(f"{n}_a").cast("double"), F.col(f"{n}_b").cast("double"))).alias("s"))
        mine = twelve(samples)
        mine = mine.select("u", "v", *([F.col("size")] if out is None else []), *[F.col(c).alias(f"{n}_{c}") for c in mine.columns if c not in ("u", "v", "size")])
        out = mine if out is None else out.join(mine, ["u", "v"])
    return out


def affinity_features(seg: DataFrame, affs: DataFrame, offsets: Sequence[Sequence[int]], on: Sequence[str] = ("y", "x"), label: str = "seg") -> DataFrame:
    """Twelve features per RAG edge of the affinities (c, coordinates, a) between differing labels."""
    pairs = neighbours(seg, offsets, on, [label]).where(F.col(f"{label}_a") != F.col(f"{label}_b"))
    pairs = canonical(pairs, f"{label}_a", f"{label}_b", *on, F.col("offset").alias("c"))
    samples = pairs.join(affs, [*on, "c"]).select("u", "v", F.col("a").cast("double").alias("s"))
    return twelve(samples.join(rag(seg, on, label), ["u", "v"], "left_semi"))


def region_features(x: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg", value: str = "raw") -> DataFrame:
    """Count, extremes, mean, moments, quantiles, centres and (2D) radii of every label."""
    v = F.col(value).cast("double")
    centre = {f"c{c}": F.avg(F.col(c).cast("double")) for c in on}
    weighted = {f"w{c}": F.sum(v * F.col(c)) / F.sum(v) for c in on}
    spread = {f"_{a}{b}": F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for i, a in enumerate(on) for b in on[i:]}
    flat = lambda f: F.when((F.count("*") < 2) | (F.max(v) == F.min(v)), 0.0).otherwise(f(v))
    aggs = {"count": F.count("*"), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "sum": F.sum(v), "variance": F.var_pop(v), "kurtosis": flat(F.kurtosis), "skewness": flat(F.skewness), "quantiles": F.percentile(v, F.array(*[F.lit(q / 100) for q in (0, 10, 25, 50, 75, 90, 100)]))}
    out = x.groupBy(label).agg(*[e.alias(n) for n, e in {**aggs, **centre, **weighted, **spread}.items()])
    if len(on) == 2:
        a, b, c = F.col(f"_{on[0]}{on[0]}"), F.col(f"_{on[0]}{on[1]}"), F.col(f"_{on[1]}{on[1]}")
        root = F.sqrt(F.greatest((a - c) * (a - c) / 4 + b * b, F.lit(0.0)))
        out = out.withColumns({"radius_0": F.sqrt(F.greatest((a + c) / 2 + root, F.lit(0.0))), "radius_1": F.sqrt(F.greatest((a + c) / 2 - root, F.lit(0.0)))})
    return out.drop(*spread)


def edge_region_features(edges: DataFrame, nodes: DataFrame, features: Sequence[str], centres: Sequence[str], label: str = "seg") -> DataFrame:
    """min, max, absolute difference and sum of both ends' features, and squared centre differences."""
    side = lambda s: nodes.select(F.col(label).alias(s), *[F.col(f).alias(f"{f}_{s}") for f in [*features, *centres]])
    j = edges.join(side("u"), "u").join(side("v"), "v")
    out = []
    for f in features:
        a, b = F.col(f"{f}_u"), F.col(f"{f}_v")
        out += [F.nanvl(e.cast("double"), F.lit(0.0)).alias(f"{n}_{f}") for n, e in (("min", F.least(a, b)), ("max", F.greatest(a, b)), ("absdiff", F.abs(a - b)), ("sum", a + b))]
    out += [F.pow(F.col(f"{c}_u") - F.col(f"{c}_v"), 2).alias(f"sq_{c}") for c in centres]
    return j.select("u", "v", *out)


def z_edge_mask(edges: DataFrame, seg: DataFrame, z: str = "z", label: str = "seg") -> DataFrame:
    """Whether the last slices of both ends differ."""
    last = seg.groupBy(label).agg(F.max(z).alias("z"))
    at = lambda s: last.select(F.col(label).alias(s), F.col("z").alias(f"z{s}"))
    return edges.join(at("u"), "u").join(at("v"), "v").select("u", "v", (F.col("zu") != F.col("zv")).alias("z_edge"))


def stitch_edges(seg: DataFrame, block: Sequence[int], on: Sequence[str] = ("y", "x"), label: str = "seg") -> DataFrame:
    """(u, v, stitch) for every RAG edge: whether it is touched across a block face."""
    f = faces(seg, on, label)
    across = F.lit(False)
    for k, (c, b) in enumerate(zip(on, block, strict=True)):
        across = across | ((F.col("offset") == k) & ((F.col(c) + 1) % b == 0))
    return f.groupBy("u", "v").agg(F.max(across).alias("stitch"))


def project_node_labels(seg: DataFrame, nodes: DataFrame, label: str = "seg") -> DataFrame:
    """Every voxel with its label's node label (node, node_label)."""
    return seg.join(nodes.withColumnRenamed("node", label), label)


def maximum_overlap(x: DataFrame, a: str = "seg", b: str = "gt", ignore_zeros: bool = False) -> DataFrame:
    """(a, best): the label of b that overlaps each label of a most; ties go to the smallest."""
    ct = (x.where(F.col(b) != 0) if ignore_zeros else x).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    best = ct.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"))).alias("t")).select("a", (-F.col("t.m")).alias("best"))
    return best if not ignore_zeros else x.select(F.col(a).alias("a")).distinct().join(best, "a", "left").select("a", F.coalesce("best", F.lit(0)).alias("best"))


def edge_labels(edges: DataFrame, x: DataFrame, seg: str = "seg", gt: str = "gt", ignore: int | None = None) -> DataFrame:
    """(u, v, label, valid): whether the majority ground-truth labels of both ends differ."""
    best = maximum_overlap(x, seg, gt)
    at = lambda s: best.select(F.col("a").alias(s), F.col("best").alias(f"g{s}"))
    j = edges.join(at("u"), "u").join(at("v"), "v")
    valid = F.lit(True) if ignore is None else (F.col("gu") != ignore) & (F.col("gv") != ignore)
    return j.select("u", "v", (F.col("gu") != F.col("gv")).cast("int").alias("label"), valid.alias("valid"))


def edge_probabilities_from_embeddings(emb: DataFrame, edges: DataFrame, delta: float, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(u, v, p) from the distance of both ends' mean embeddings."""
    mean = emb.select(F.col(label).alias("l"), F.posexplode(embedding).alias("k", "e")).groupBy("l", "k").agg(F.avg("e").alias("m"))
    at = lambda s: mean.select(F.col("l").alias(s), "k", F.col("m").alias(f"m{s}"))
    d = edges.join(at("u"), "u").join(at("v"), ["v", "k"]).groupBy("u", "v").agg(F.sqrt(F.sum(F.pow(F.col("mu") - F.col("mv"), 2))).alias("d"))
    return d.select("u", "v", (1 - F.pow(F.greatest((2 * delta - F.col("d")) / (2 * delta), F.lit(0.0)), 2)).alias("p"))


def seg_to_edges(seg: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg") -> DataFrame:
    """(coordinates, edge): 1 where the central difference along any axis is not zero; borders reflect."""
    out = seg.select(*on, F.col(label).alias("l"))
    edge = F.lit(False)
    for k, c in enumerate(on):
        for s, d in (("p", 1), ("m", -1)):
            out = out.join(seg.select(*[F.col(o) if o != c else (F.col(o) - d).alias(o) for o in on], F.col(label).alias(f"{s}{k}")), list(on), "left")
        edge = edge | (F.coalesce(f"p{k}", "l") != F.coalesce(f"m{k}", "l"))
    return out.select(*on, edge.cast("int").alias("edge"))


def embeddings_to_affinities(emb: DataFrame, offsets: Sequence[Sequence[int]], delta: float, on: Sequence[str] = ("y", "x"), embedding: str = "embedding", invert: bool = False) -> DataFrame:
    """(c, coordinates, a): affinity to the voxel at each offset; outside the volume the other embedding is zero."""
    parts = None
    for k, offset in enumerate(offsets):
        other = emb.select(*[(F.col(c) - int(d)).alias(c) for c, d in zip(on, offset, strict=True)], F.col(embedding).alias("_o"))
        j = emb.select(*on, F.col(embedding).alias("_e")).join(other, list(on), "left")
        d = F.sqrt(F.aggregate(F.zip_with("_e", F.coalesce("_o", F.transform("_e", lambda e: e * 0)), lambda a, b: F.pow((a - b).cast("double"), 2)), F.lit(0.0), lambda s, e: s + e))
        a = F.pow(F.greatest((2 * delta - d) / (2 * delta), F.lit(0.0)), 2)
        one = j.select(F.lit(k).alias("c"), *on, (1 - a if invert else a).alias("a"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def affinities_to_boundaries(affs: DataFrame, offsets: Sequence[Sequence[int]], on: Sequence[str] = ("y", "x"), weights: Sequence[float] | None = None) -> DataFrame:
    """(coordinates, p): the largest weighted 1 - affinity over offsets, each moved by half its offset."""
    t = F.create_map(*[e for k, o in enumerate(offsets) for e in (F.lit(k), F.array(*[F.lit(int(d / 2)) for d in o]))])
    w = F.element_at(F.create_map(*[e for k in range(len(offsets)) for e in (F.lit(k), F.lit(float(weights[k] if weights else 1)))]), F.col("c"))
    moved = affs.select(*[(F.col(c) + F.element_at(t, F.col("c"))[i]).alias(c) for i, c in enumerate(on)], ((1 - F.col("a")) * w).alias("p"))
    return affs.select(*on).distinct().join(moved.groupBy(*on).agg(F.max("p").alias("p")), list(on), "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def visualise_edges(seg: DataFrame, values: DataFrame, on: Sequence[str] = ("y", "x"), label: str = "seg") -> DataFrame:
    """(coordinates, value): the value of its edge on every boundary voxel, the largest where several meet, else 0."""
    f = faces(seg, on, label).join(values, ["u", "v"])
    both = f.select(*on, "w")
    for k, c in enumerate(on):
        both = both.unionByName(f.where(F.col("offset") == k).select(*[F.col(o) if o != c else (F.col(o) + 1).alias(o) for o in on], "w"))
    return seg.select(*on).join(both.groupBy(*on).agg(F.max("w").alias("value")), list(on), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def first_label(x: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value)
