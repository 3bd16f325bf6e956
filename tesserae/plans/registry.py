"""Registered queries of the array, label and graph operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import elementwise as el
from tesserae.operators import graphs as gr
from tesserae.operators import learning as le
from tesserae.operators import metrics as me
from tesserae.operators import multisets as mu
from tesserae.operators import neighbourhood as nb
from tesserae.operators import reductions as rd
from tesserae.operators import regions as rg
from tesserae.operators import solvers as so
from tesserae.operators import tracking as tr
from tesserae.operators import transform as tf
from tesserae.operators import workflows as wf
from tesserae.plans.fixpoint import components
from tesserae.plans.views import view, with_views
from tesserae.sources import geometry as ge

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIGITS = 4


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Added before rounding where exact halves are common, so that the last bit of a sum doesn't decide.
NUDGE = 1.3e-6


def rounded(df: DataFrame, digits: int = DIGITS, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, without negative zeros, so that both engines print the same."""
    return df.select(*[(F.round(F.col(c) + F.lit(nudge), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def img(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "img")


def vol(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "vol")


YX = ("y", "x")


def rows_of(s: SparkSession, d: str) -> int:
    """Rows of the raster: its shape is that of the whole table."""
    return int(img(s, d).agg(F.max("y")).first()[0]) + 1

# Element-wise operators: both operands are rasters of one shape.
_BINARY = {
    "add": "p.raw + q.raw", "subtract": "p.raw - q.raw", "multiply": "p.raw * q.raw",
    "divide": "p.raw / q.raw",
    "greater": "CAST(p.raw > q.raw AS INT)", "greater_equal": "CAST(p.raw >= q.raw AS INT)", "less": "CAST(p.raw < q.raw AS INT)", "less_equal": "CAST(p.raw <= q.raw AS INT)",
    "minimum": "least(p.raw, q.raw)", "maximum": "greatest(p.raw, q.raw)",
}


def _binary(name: str, expression: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        a = img(s, d).select("y", "x", (F.col("raw") / 1000).alias("v"))
        other = img(s, d).select((F.col("y") + 1).alias("y"), "x", (F.col("raw") / 2000 + 1).alias("v"))
        return rounded(el.apply_operation(a, other, name, YX), nudge=0.0 if "CAST" in expression else NUDGE)

    query.__name__ = f"p_{name}"
    value = f"round({expression} + {NUDGE}, {DIGITS}) + 0.0" if "CAST" not in expression else expression
    register(f"SELECT p.y, p.x, {value} AS v FROM (SELECT y, x, raw / 1000 AS raw FROM img) p JOIN (SELECT y + 1 AS y, x, raw / 2000 + 1 AS raw FROM img) q ON p.y = q.y AND p.x = q.x")(query)


for _name, _expression in _BINARY.items():
    _binary(_name, _expression)


@register("SELECT p.y, p.x, round(p.raw - q.m, 4) + 0.0 AS v FROM img p JOIN (SELECT x, avg(raw) AS m FROM img GROUP BY x) q ON p.x = q.x")
def p1_broadcast_subtract(s, d):
    a = img(s, d).select("y", "x", F.col("raw").alias("v"))
    return rounded(el.apply_operation(a, el.apply_operation_single(a, F.avg, YX, axis="y"), "subtract", YX, broadcast_on=["x"]))


@register("SELECT x, max(raw) AS v FROM img GROUP BY x")
def p2_axis_reduction(s, d):
    return el.apply_operation_single(img(s, d).select("y", "x", F.col("raw").alias("v")), F.max, YX, axis="y")


@register("SELECT y, x, cls AS v, cls IN (SELECT DISTINCT ascii(o_orderstatus) FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F') AS isin FROM img")
def p13_isin(s, d):
    i = img(s, d)
    return el.isin(i.select("y", "x", F.col("cls").alias("v")), i.where("raw > 100000 AND cls <> 0").select("cls"))


@register("SELECT y, x, round((raw - lo) / (hi - lo + 1e-7), 6) + 0.0 AS raw FROM img, (SELECT min(raw) AS lo, max(raw) AS hi FROM img)")
def p15_w5_normalize(s, d):
    return rounded(el.normalize(img(s, d).select("y", "x", "raw"), "raw"), 6)


@register("SELECT y, x, round(least(greatest(raw / p, 0.0), 1.0), 6) + 0.0 AS raw FROM img, (SELECT quantile_cont(raw, 0.95) AS p FROM img)")
def p16_sharpen_edges(s, d):
    return rounded(el.sharpen_edges(img(s, d).select("y", "x", "raw"), 95, True, "raw"), 6)


@register("SELECT z, y, x, CASE WHEN label = bg THEN 0 WHEN label = 0 THEN bg ELSE label END AS label FROM vol, (SELECT label AS bg FROM vol GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)")
def p17_map_background(s, d):
    return el.map_background_to_zero(vol(s, d).select("z", "y", "x", "label"))


@register("SELECT y, x, round(1 - power(greatest((400000 - raw) / 400000, 0.0), 2), 6) + 0.0 AS w FROM img")
def p18_loss_weight(s, d):
    return rounded(img(s, d).select("y", "x", el.discriminative_loss_weight(F.col("raw"), 200000.0).alias("w")), 6)


@register("SELECT y - 2 AS y, x - 10 AS x, raw > 150000 AS raw FROM img WHERE y >= 2 AND y < 9 AND x >= 10 AND x < 60")
def w6_w7_threshold_roi(s, d):
    return el.threshold(el.roi(img(s, d).select("y", "x", "raw"), {"y": 2, "x": 10}, {"y": 9, "x": 60}), 150000, ">", "raw")


@register("SELECT g.y, h.x, coalesce(raw, 0.0) AS raw FROM (SELECT DISTINCT y FROM img UNION SELECT max(y) + 1 FROM img UNION SELECT max(y) + 2 FROM img) g, range(130) h(x) LEFT JOIN img i ON i.y = g.y AND i.x = h.x")
def w8_pad(s, d):
    return el.pad(img(s, d).select("y", "x", "raw"), {"y": rows_of(s, d), "x": 125}, {"y": 2, "x": 5}, "raw")


@register("SELECT y, x, raw + y * 10 + x AS v FROM img")
def w3_transformation(s, d):
    return el.multi_transform(lambda raw, at: raw + at, img(s, d).select("y", "x", F.col("raw").alias("v")), img(s, d).select("y", "x", (F.col("y") * 10 + F.col("x")).alias("v")), on=YX)


@register("SELECT p.y, p.x, greatest(p.raw, q.raw) AS raw FROM img p JOIN img q ON p.y = q.y AND p.x = q.x")
def w4_multi_transform(s, d):
    return el.multi_transform(lambda a, b: F.greatest(a, b), img(s, d), img(s, d), on=YX, value="raw")


@register("SELECT y + 3 AS y, x, CASE WHEN cls = 0 THEN 0 ELSE seg END AS seg FROM img")
def s17_s18_copy(s, d):
    return el.copy(img(s, d).withColumn("m", F.col("cls") == 0).select("y", "x", "seg", "m"), {"y": 3}, "m", "seg").drop("m")


@register("SELECT CAST(floor(y / 4.0) AS BIGINT) AS y, CAST(floor(x / 4.0) AS BIGINT) AS x, round(avg(raw) + 1.3e-6, 4) + 0.0 AS raw FROM img GROUP BY 1, 2")
def s19_downscale(s, d):
    return rounded(el.downscale(img(s, d).select("y", "x", "raw"), {"y": 4, "x": 4}, "mean", "raw"), nudge=NUDGE)


# Reductions.
@register("SELECT round(avg(raw), 4) AS mean, round(stddev_pop(raw), 4) AS std, min(raw) AS min, max(raw) AS max, count(*) AS n FROM img WHERE cls <> 0")
def r1_r6_stats(s, d):
    return rounded(rd.stats(img(s, d), "raw", F.col("cls") != 0))


@register("SELECT label, count(*) AS count FROM vol GROUP BY label")
def r7_unique(s, d):
    return rd.unique(vol(s, d))


@register("SELECT z, y, x, v.label, CASE WHEN v.label = 0 THEN 0 ELSE r.n END AS new FROM vol v JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM (SELECT DISTINCT label FROM vol)) r ON v.label = r.label")
def r8_relabel(s, d):
    return rd.relabel_consecutive(vol(s, d)).select("z", "y", "x", "label", "new")


@register(
    "WITH k AS (SELECT y, x, CASE WHEN n < 5 THEN 0 ELSE i.seg END AS seg FROM img i JOIN (SELECT seg, count(*) AS n FROM img GROUP BY seg) c ON i.seg = c.seg) "
    "SELECT y, x, CAST(k.seg AS BIGINT) AS seg, CASE WHEN k.seg = 0 THEN 0 ELSE r.n END AS new FROM k JOIN (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS n FROM (SELECT DISTINCT seg FROM k)) r ON k.seg = r.seg"
)
def r9_size_filter(s, d):
    return rd.size_filter(img(s, d).select("y", "x", "seg"), min_size=5, value="seg").select("y", "x", "seg", "new")


@register(
    "WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM vol WHERE label <> 0 GROUP BY label), m AS (SELECT min(n) AS lo, max(n) AS hi FROM t) "
    "SELECT CAST(least(floor((n - lo) * 10 / greatest(hi - lo, 1e-12)), 9) AS BIGINT) AS bin, round(lo + CAST(least(floor((n - lo) * 10 / greatest(hi - lo, 1e-12)), 9) AS BIGINT) * (hi - lo) / 10, 4) AS edge, count(*) AS n FROM t, m GROUP BY 1, 2"
)
def r11_size_histogram(s, d):
    return rounded(rd.size_histogram(vol(s, d)))


# Metrics.
CT = "ct AS (SELECT gt AS a, seg AS b, count(*) AS n FROM img GROUP BY gt, seg), ma AS (SELECT a, CAST(sum(n) AS BIGINT) AS na FROM ct GROUP BY a), mb AS (SELECT b, CAST(sum(n) AS BIGINT) AS nb FROM ct GROUP BY b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM ct)"
RAND = "r AS (SELECT s / sb AS p, s / sa AS q, sa, sb, s, t FROM (SELECT sum(CAST(n AS DOUBLE) * n) AS s FROM ct), (SELECT sum(CAST(na AS DOUBLE) * na) AS sa FROM ma), (SELECT sum(CAST(nb AS DOUBLE) * nb) AS sb FROM mb), t)"
VI = "vi AS (SELECT hb - i AS vi_split, ha - i AS vi_merge FROM (SELECT sum(n / t * log2(t * n / (CAST(na AS DOUBLE) * nb))) AS i FROM ct JOIN ma USING (a) JOIN mb USING (b), t), (SELECT -sum(na / t * log2(na / t)) AS ha FROM ma, t), (SELECT -sum(nb / t * log2(nb / t)) AS hb FROM mb, t))"
IOU = "o AS (SELECT a, b, n / greatest(CAST(na + nb - n AS DOUBLE), 1e-7) AS score FROM ct JOIN ma USING (a) JOIN mb USING (b))"


def ct(s: SparkSession, d: str) -> DataFrame:
    return me.contingency(img(s, d))


@register(f"WITH {CT} SELECT a, b, n FROM ct")
def e1_contingency(s, d):
    return ct(s, d)


@register("SELECT gt AS a, seg AS b, count(*) AS n FROM img WHERE NOT (gt IN (1, 2) AND seg IN (0, 1)) GROUP BY gt, seg")
def e2_ignore_mask(s, d):
    return me.contingency(img(s, d), ignore_a=[1, 2], ignore_b=[0, 1])


@register(f"WITH {CT}, {RAND}, {VI} SELECT round(1 - 2 * p * q / (p + q), 6) AS rand_error, round(1 - (sa + sb - 2 * s) / (t * t), 6) AS rand_index, round(vi_split, 6) AS vi_split, round(vi_merge, 6) AS vi_merge FROM r, vi")
def e3_e4_rand_vi(s, d):
    c = ct(s, d)
    return rounded(me.rand_index(c).crossJoin(me.variation_of_information(c)), 6)


@register(f"WITH {CT} SELECT a, round(-sum(n / na * log2(n / nb)), 6) + 0.0 AS vi_split, round(-sum(n / na * log2(n / na)), 6) + 0.0 AS vi_merge FROM ct JOIN ma USING (a) JOIN mb USING (b) GROUP BY a")
def e5_object_vi(s, d):
    return rounded(me.object_vi(ct(s, d)), 6)


@register(f"WITH {CT}, {RAND}, {VI} SELECT round(vi_split, 6) AS vi_split, round(vi_merge, 6) AS vi_merge, round(1 - 2 * p * q / (p + q), 6) AS rand_error, round(sqrt((1 - 2 * p * q / (p + q)) * (vi_split + vi_merge)), 6) AS cremi FROM r, vi")
def e6_cremi(s, d):
    return rounded(me.cremi_score(ct(s, d)), 6)


@register("SELECT round(2 * sum(s * g) / (sum(s) + sum(g) + 1e-7), 6) AS dice FROM (SELECT CAST(seg > 20 AS INT)::DOUBLE AS s, CAST(gt > 3 AS INT)::DOUBLE AS g FROM img)")
def e7_dice(s, d):
    return rounded(me.dice_score(img(s, d), "seg", "gt", 20, 3), 6)


@register(
    f"WITH {CT}, f AS (SELECT a, max(CASE WHEN b <> 0 THEN 2 * n / (na + nb + 1e-7) ELSE 0 END) AS v FROM ct JOIN ma USING (a) JOIN mb USING (b) WHERE a <> 0 GROUP BY a), "
    "g AS (SELECT b, max(CASE WHEN a <> 0 THEN 2 * n / (na + nb + 1e-7) ELSE 0 END) AS v FROM ct JOIN ma USING (a) JOIN mb USING (b) WHERE b <> 0 GROUP BY b) SELECT round(least((SELECT avg(v) FROM f), (SELECT avg(v) FROM g)), 6) AS dice"
)
def e8_best_dice(s, d):
    return rounded(me.symmetric_best_dice(ct(s, d)), 6)


@register(f"WITH {CT}, {IOU} SELECT a, b, round(score, 6) AS score FROM o WHERE a <> 0 AND b <> 0")
def e9_label_overlap(s, d):
    return rounded(me.label_overlap(ct(s, d)), 6)


# Ground truth for matching: the segments, with those of one class in every third row merged into the one before.
SHIFTED = "w AS (SELECT y, x, seg, CASE WHEN x % 8 < 6 THEN seg ELSE seg + 100000 END AS gt2 FROM img), c2 AS (SELECT gt2 AS a, seg AS b, count(*) AS n FROM w GROUP BY 1, 2), a2 AS (SELECT a, CAST(sum(n) AS BIGINT) AS na FROM c2 GROUP BY a), b2 AS (SELECT b, CAST(sum(n) AS BIGINT) AS nb FROM c2 GROUP BY b), o2 AS (SELECT a, b, n / CAST(na + nb - n AS DOUBLE) AS score FROM c2 JOIN a2 USING (a) JOIN b2 USING (b))"


def ct2(s: SparkSession, d: str) -> DataFrame:
    return me.contingency(img(s, d).withColumn("gt2", F.when(F.col("x") % 8 < 6, F.col("seg")).otherwise(F.col("seg") + 100000)), "gt2", "seg")


@register(
    f"WITH {SHIFTED}, m AS (SELECT CAST((SELECT count(*) FROM o2 WHERE score >= 0.6 AND a <> 0 AND b <> 0) AS DOUBLE) AS tp, (SELECT count(*) FROM b2 WHERE b <> 0) AS p, (SELECT count(*) FROM a2 WHERE a <> 0) AS t) "
    "SELECT round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(tp / (p + t - tp), 6) AS segmentation_accuracy, round(2 * tp / (p + t), 6) AS f1 FROM m"
)
def e10_matching(s, d):
    return rounded(me.matching(ct2(s, d), 0.6), 6)


@register()
def e10_matching_assignment(s, d):
    return rounded(me.matching(ct2(s, d), 0.3), 6)


@register(
    f"WITH {SHIFTED}, h AS (SELECT k.t, CAST(count(o2.score) AS DOUBLE) AS tp FROM (SELECT unnest([0.55, 0.65, 0.75, 0.85, 0.95]) AS t) k LEFT JOIN o2 ON o2.score >= k.t AND a <> 0 AND b <> 0 GROUP BY k.t) "
    "SELECT round(avg(tp / ((SELECT count(*) FROM b2 WHERE b <> 0) + (SELECT count(*) FROM a2 WHERE a <> 0) - tp)), 6) AS mean_accuracy FROM h"
)
def e11_mean_accuracy(s, d):
    return rounded(me.mean_segmentation_accuracy(ct2(s, d), [0.55, 0.65, 0.75, 0.85, 0.95]), 6)


@register(f"WITH {CT}, {IOU} SELECT mb.b, round(coalesce(max(score), 0.0), 6) AS best_iou FROM mb LEFT JOIN o ON o.b = mb.b AND o.a <> 0 WHERE mb.b <> 0 GROUP BY mb.b")
def e12_object_scores(s, d):
    return rounded(me.object_scores(ct(s, d)), 6)


@register(
    f"WITH {SHIFTED}, h AS (SELECT a, b FROM o2 WHERE score > 0.7 AND a <> 0 AND b <> 0) SELECT b AS id, CASE WHEN b IN (SELECT b FROM h) THEN 'tp' ELSE 'fp' END AS kind FROM b2 WHERE b <> 0 UNION ALL SELECT a, 'fn' FROM a2 WHERE a <> 0 AND a NOT IN (SELECT a FROM h)"
)
def e13_match_sets(s, d):
    return me.match_sets(ct2(s, d), 0.7)


# Regions and edges.
FACES = "f AS (SELECT p.y, p.x, least(p.seg, q.seg) AS u, greatest(p.seg, q.seg) AS v, p.raw AS ra, q.raw AS rb, 1 AS o FROM img p JOIN img q ON q.y = p.y AND q.x = p.x + 1 WHERE p.seg <> q.seg UNION ALL SELECT p.y, p.x, least(p.seg, q.seg), greatest(p.seg, q.seg), p.raw, q.raw, 0 FROM img p JOIN img q ON q.y = p.y + 1 AND q.x = p.x WHERE p.seg <> q.seg), e AS (SELECT DISTINCT u, v FROM f), smp AS (SELECT u, v, ra AS s FROM f UNION ALL SELECT u, v, rb FROM f)"


@register(f"WITH {FACES} SELECT u, v FROM e")
def g1_rag(s, d):
    return rg.rag(img(s, d))


@register(
    "WITH f AS (SELECT least(p.label, q.label) AS u, greatest(p.label, q.label) AS v FROM vol p JOIN vol q ON q.z = p.z AND q.y = p.y AND q.x = p.x + 1 UNION ALL SELECT least(p.label, q.label), greatest(p.label, q.label) FROM vol p JOIN vol q ON q.z = p.z AND q.y = p.y + 1 AND q.x = p.x "
    "UNION ALL SELECT least(p.label, q.label), greatest(p.label, q.label) FROM vol p JOIN vol q ON q.z = p.z + 1 AND q.y = p.y AND q.x = p.x) SELECT DISTINCT u, v FROM f WHERE u <> v"
)
def g1_rag_3d(s, d):
    return rg.rag(vol(s, d), ("z", "y", "x"), "label")


@register(f"WITH {FACES} SELECT u, v, round(avg(s) + 1.3e-6, 4) AS mean, count(*) AS size FROM smp GROUP BY u, v")
def g2_mean_and_length(s, d):
    return rounded(rg.mean_and_length(img(s, d)), nudge=NUDGE)


@register(
    f"WITH {FACES} SELECT u, v, round(avg(s) + 1.3e-6, 4) AS mean, round(quantile_cont(s, 0.5) + 1.3e-6, 4) AS median, round(stddev_pop(s) + 1.3e-6, 4) AS std, round(min(s) + 1.3e-6, 4) AS min, round(max(s) + 1.3e-6, 4) AS max, "
    + ", ".join(f"round(quantile_cont(s, {q / 100}) + 1.3e-6, 4) AS p{q}" for q in (5, 10, 25, 75, 90, 95))
    + ", count(*) AS size FROM smp GROUP BY u, v"
)
def g3_boundary_features(s, d):
    return rounded(rg.boundary_features(img(s, d)), nudge=NUDGE)


@register(
    f"WITH {FACES}, af AS (SELECT least(p.seg, q.seg) AS u, greatest(p.seg, q.seg) AS v, p.raw / 500000 AS a FROM img p JOIN img q ON q.y = p.y AND q.x = p.x + 1 UNION ALL SELECT least(p.seg, q.seg), greatest(p.seg, q.seg), p.raw / 250000 FROM img p JOIN img q ON q.y = p.y + 3 AND q.x = p.x) "
    "SELECT u, v, round(avg(a) + 1.3e-6, 4) AS mean, min(a) AS min, max(a) AS max, count(*) AS size FROM af JOIN e USING (u, v) GROUP BY u, v"
)
def g4_affinity_features(s, d):
    i = img(s, d)
    affs = i.select("y", "x", F.explode(F.array(F.struct(F.lit(0).alias("c"), (F.col("raw") / 500000).alias("a")), F.struct(F.lit(1).alias("c"), (F.col("raw") / 250000).alias("a")))).alias("e")).select("y", "x", "e.*")
    return rg.affinity_features(i, affs, [[0, 1], [3, 0]]).select("u", "v", F.round(F.col("mean") + NUDGE, 4).alias("mean"), "min", "max", "size")


@register(
    "SELECT seg, count(*) AS count, min(raw) AS min, max(raw) AS max, round(avg(raw) + 1.3e-6, 4) AS mean, round(sum(raw), 2) AS sum, round(avg(y) + 1.3e-6, 4) AS cy, round(avg(x) + 1.3e-6, 4) AS cx, round(sum(raw * y) / sum(raw), 4) AS wy, "
    "round(CASE WHEN count(*) < 2 OR max(raw) = min(raw) THEN 0 ELSE kurtosis_pop(raw) END, 4) + 0.0 AS kurtosis FROM img GROUP BY seg"
)
def g0_region_features(s, d):
    r = rg.region_features(img(s, d))
    return r.select("seg", "count", "min", "max", F.round(F.col("mean") + NUDGE, 4).alias("mean"), F.round("sum", 2).alias("sum"), F.round(F.col("cy") + NUDGE, 4).alias("cy"), F.round(F.col("cx") + NUDGE, 4).alias("cx"), F.round("wy", 4).alias("wy"), (F.round("kurtosis", 4) + F.lit(0.0)).alias("kurtosis"))


@register(
    f"WITH {FACES}, n AS (SELECT seg, avg(raw) AS m, avg(y) AS cy FROM img GROUP BY seg) SELECT e.u, e.v, round(least(p.m, q.m) + 1.3e-6, 4) AS min_mean, round(greatest(p.m, q.m) + 1.3e-6, 4) AS max_mean, round(abs(p.m - q.m) + 1.3e-6, 4) AS absdiff_mean, round(p.m + q.m + 1.3e-6, 4) AS sum_mean, round(power(p.cy - q.cy, 2) + 1.3e-6, 4) AS sq_cy FROM e JOIN n p ON e.u = p.seg JOIN n q ON e.v = q.seg"
)
def g6_edge_region_features(s, d):
    i = img(s, d)
    return rounded(rg.edge_region_features(rg.rag(i), rg.region_features(i), ["mean"], ["cy"]), nudge=NUDGE)


@register("WITH f AS (SELECT DISTINCT p.label AS u, q.label AS v FROM vol p JOIN vol q ON q.z = p.z AND q.y = p.y AND q.x = p.x + 1 WHERE p.label < q.label), l AS (SELECT label, max(z) AS z FROM vol GROUP BY label) SELECT u, v, a.z <> b.z AS z_edge FROM f JOIN l a ON u = a.label JOIN l b ON v = b.label")
def g7_z_edges(s, d):
    from tesserae.plans.fixpoint import neighbours

    e = neighbours(vol(s, d), [[0, 0, 1]], ("z", "y", "x"), ["label"]).where("label_a < label_b").select(F.col("label_a").alias("u"), F.col("label_b").alias("v")).distinct()
    return rg.z_edge_mask(e, vol(s, d), label="label")


@register(f"WITH {FACES} SELECT u, v, bool_or((o = 1 AND (x + 1) % 25 = 0) OR (o = 0 AND (y + 1) % 4 = 0)) AS stitch FROM f GROUP BY u, v")
def g8_stitch_edges(s, d):
    return rg.stitch_edges(img(s, d), [4, 25])


@register("SELECT y, x, seg, seg % 7 AS node_label FROM img")
def g9_project(s, d):
    i = img(s, d).select("y", "x", "seg")
    return rg.project_node_labels(i, i.select(F.col("seg").alias("node")).distinct().withColumn("node_label", F.col("node") % 7), "seg").select("y", "x", "seg", "node_label")


BEST = "best AS (SELECT seg AS a, gt AS best FROM (SELECT seg, gt, row_number() OVER (PARTITION BY seg ORDER BY count(*) DESC, gt) AS r FROM img GROUP BY seg, gt) WHERE r = 1)"


@register(f"WITH {FACES}, {BEST} SELECT u, v, CAST(p.best <> q.best AS INT) AS label, p.best <> 1 AND q.best <> 1 AS valid FROM e JOIN best p ON u = p.a JOIN best q ON v = q.a")
def g10_edge_labels(s, d):
    return rg.edge_labels(rg.rag(img(s, d)), img(s, d), ignore=1)


@register(f"WITH {BEST} SELECT a, best FROM best")
def g11_maximum_overlap(s, d):
    return rg.maximum_overlap(img(s, d))


@register(
    "WITH m AS (SELECT label, k, avg(e) AS m FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS k FROM emb) GROUP BY label, k), dd AS (SELECT p.label AS u, q.label AS v, sqrt(sum(power(p.m - q.m, 2))) AS d FROM m p JOIN m q ON p.k = q.k AND p.label < q.label GROUP BY 1, 2) "
    "SELECT u, v, round(1 - power(greatest((2 - d) / 2, 0.0), 2), 5) AS p FROM dd"
)
def g12_embedding_edges(s, d):
    e = view(s, d, "emb")
    ids = e.select("label").distinct()
    edges = ids.select(F.col("label").alias("u")).join(ids.select(F.col("label").alias("v")), F.col("u") < F.col("v"))
    return rounded(rg.edge_probabilities_from_embeddings(e, edges, 1.0), 5)


@register("WITH r AS (SELECT DISTINCT y FROM img) SELECT y * 125 + x AS u, y * 125 + x + 1 AS v FROM r, range(124) t(x) UNION ALL SELECT y * 125 + x, (y + 1) * 125 + x FROM r, range(125) t(x) WHERE y < (SELECT max(y) FROM img)")
def g14_grid_graph(s, d):
    return gr.grid_graph(s, (rows_of(s, d), 125))


@register("SELECT p.y, p.x, 0 AS \"offset\", round(sqrt(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda e: power(CAST(e[1] AS DOUBLE) - e[2], 2)))), 5) AS w FROM emb p JOIN emb q ON q.y = p.y + 1 AND q.x = p.x UNION ALL SELECT p.y, p.x, 1, round(sqrt(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda e: power(CAST(e[1] AS DOUBLE) - e[2], 2)))), 5) FROM emb p JOIN emb q ON q.y = p.y AND q.x = p.x + 1")
def g16_embedding_distances(s, d):
    return rounded(gr.grid_features(view(s, d, "emb"), YX, "embedding", "l2"), 5)


@register(f"WITH {FACES}, k AS (SELECT u, v, CAST(u % 3 <> 0 AS INT) + CAST(v % 3 <> 0 AS INT) AS k FROM e) SELECT u, v, CASE WHEN k = 0 THEN 0.0::DOUBLE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM k")
def g18_masked_weights(s, d):
    i = img(s, d)
    return gr.masked_weights(rg.rag(i).withColumn("w", F.lit(0.5)), i.select(F.col("seg").alias("node"), (F.col("seg") % 3 != 0).alias("m")).distinct())


@register(f"WITH {FACES}, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) SELECT DISTINCT p.u, q.v, 2 AS hops FROM b p JOIN b q ON p.v = q.u WHERE p.u < q.v AND NOT EXISTS (SELECT 1 FROM e WHERE e.u = p.u AND e.v = q.v)")
def g20_lifted_neighbourhood(s, d):
    return gr.lifted_neighbourhood(rg.rag(img(s, d)), 2)


@register(f"WITH {FACES}, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), l AS (SELECT DISTINCT p.u, q.v FROM b p JOIN b q ON p.v = q.u WHERE p.u < q.v AND NOT EXISTS (SELECT 1 FROM e WHERE e.u = p.u AND e.v = q.v)) SELECT u, v, CASE WHEN u % 4 = v % 4 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS w FROM l WHERE u % 4 <> 0 AND v % 4 <> 0")
def g21_g22_lifted_from_classes(s, d):
    i = img(s, d)
    return gr.lifted_from_classes(rg.rag(i), i.select(F.col("seg").alias("node"), (F.col("seg") % 4).alias("cls")).distinct(), 2)


@register("SELECT u % 10 AS u, v % 7 + 1000 AS v, round(sum(w), 4) + 0.0 AS w FROM signed GROUP BY 1, 2")
def g26_contract(s, d):
    """Both sides have their own nodes, but suppliers from 1000 on share numbers with parts: a part is the node below zero."""
    e = view(s, d, "signed").withColumn("v", -F.col("v"))
    nodes = e.select(F.col("u").alias("node"), (F.col("u") % 10).alias("label")).unionByName(e.select(F.col("v").alias("node"), (-F.col("v") % 7 + 1000).alias("label"))).distinct()
    return rounded(gr.contract(e, nodes))


@register("SELECT u, v, w FROM signed WHERE u % 2 = 0 AND v % 2 = 0")
def g27_inner_edges(s, d):
    e = view(s, d, "signed")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).where("node % 2 = 0").distinct()
    return gr.inner_edges(e, nodes).select("u", "v", "w")


@register("SELECT round(sum(CASE WHEN u % 5 <> v % 5 THEN w ELSE 0 END), 4) + 0.0 AS energy FROM signed")
def g28_energy(s, d):
    e = view(s, d, "signed")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct().withColumn("label", F.col("node") % 5)
    return rounded(gr.energy(e, nodes))


PROBS = f"{FACES}, pr AS (SELECT u, v, avg(s) / 600000 AS p, count(*) AS size FROM smp GROUP BY u, v)"


def probabilities(s: SparkSession, d: str) -> DataFrame:
    return rg.mean_and_length(img(s, d)).select("u", "v", (F.col("mean") / 600000).alias("p"), "size")


@register(f"WITH {PROBS} SELECT u, v, round((ln((1 - (0.998 * p + 0.001)) / (0.998 * p + 0.001)) + ln(0.6 / 0.4)) * (size / CAST((SELECT max(size) FROM pr) AS DOUBLE)), 6) + 0.0 AS w FROM pr")
def c1_costs(s, d):
    return rounded(gr.probabilities_to_costs(probabilities(s, d), 0.4, size="size").select("u", "v", "w"), 6)


@register(f"WITH {PROBS}, zp AS (SELECT *, u % 2 = 0 AS z FROM pr) SELECT u, v, round((ln((1 - (0.998 * p + 0.001)) / (0.998 * p + 0.001)) + ln(1.0)) * (size / CAST(max(size) OVER (PARTITION BY z) AS DOUBLE)), 6) + 0.0 AS w FROM zp")
def c2_costs_xyz(s, d):
    return rounded(gr.edge_costs(probabilities(s, d).withColumn("z_edge", F.col("u") % 2 == 0), 0.5, "xyz").select("u", "v", "w"), 6)


@register("SELECT u % 50 AS u, v, CASE WHEN u % 50 = 0 THEN -(SELECT max(abs(w)) FROM signed) ELSE w END AS w FROM signed")
def c3_mask_edges(s, d):
    return gr.mask_edges(view(s, d, "signed").withColumn("u", F.col("u") % 50)).select("u", "v", "w")


@register(
    "SELECT p.y, p.x, CAST(coalesce(r.seg, p.seg) <> coalesce(l.seg, p.seg) OR coalesce(b.seg, p.seg) <> coalesce(t.seg, p.seg) AS INT) AS edge FROM img p LEFT JOIN img r ON r.y = p.y AND r.x = p.x + 1 LEFT JOIN img l ON l.y = p.y AND l.x = p.x - 1 LEFT JOIN img b ON b.x = p.x AND b.y = p.y + 1 LEFT JOIN img t ON t.x = p.x AND t.y = p.y - 1"
)
def b11_seg_to_edges(s, d):
    return rg.seg_to_edges(img(s, d))


@register("SELECT 0 AS c, p.y, p.x, round(power(greatest((20 - sqrt(list_sum(list_transform(list_zip(p.embedding, coalesce(q.embedding, list_transform(p.embedding, lambda e: e * 0))), lambda e: power(CAST(e[1] AS DOUBLE) - e[2], 2))))) / 20, 0.0), 2), 5) AS a FROM emb p LEFT JOIN emb q ON q.y = p.y AND q.x = p.x + 1")
def b13_affinities(s, d):
    return rounded(rg.embeddings_to_affinities(view(s, d, "emb"), [[0, 1]], 10.0), 5)


@register("WITH a AS (SELECT y, x, raw / 600000 AS a FROM img), m AS (SELECT y + 1 AS y, x, 1 - a AS p FROM a UNION ALL SELECT y, x - 2, 1 - a FROM a) SELECT a.y, a.x, floor(coalesce(max(p), 0.0) * 1e6 + 0.5) / 1e6 AS p FROM a LEFT JOIN m ON a.y = m.y AND a.x = m.x GROUP BY a.y, a.x")
def b14_boundaries(s, d):
    a = img(s, d).select("y", "x", (F.col("raw") / 600000).alias("a"))
    affs = a.withColumn("c", F.lit(0)).unionByName(a.withColumn("c", F.lit(1)))
    # Rounded by the same float operations as the twin: ties are common among prices over a power of ten.
    return rg.affinities_to_boundaries(affs, [[3, 0], [0, -4]]).select("y", "x", (F.floor(F.col("p") * 1e6 + 0.5).cast("double") / 1e6).alias("p"))


@register(f"WITH {FACES}, q AS (SELECT y, x, (u + v) % 11 + 0.0 AS w FROM f UNION ALL SELECT y + CASE WHEN o = 0 THEN 1 ELSE 0 END, x + CASE WHEN o = 1 THEN 1 ELSE 0 END, (u + v) % 11 + 0.0 FROM f) SELECT i.y, i.x, CAST(coalesce(max(w), 0) AS DOUBLE) AS value FROM img i LEFT JOIN q ON i.y = q.y AND i.x = q.x GROUP BY i.y, i.x")
def v1_visualise_edges(s, d):
    i = img(s, d)
    return rg.visualise_edges(i, rg.rag(i).withColumn("w", ((F.col("u") + F.col("v")) % 11).cast("double")))


# Fixed points.
@register(
    "WITH RECURSIVE c AS (SELECT CAST(y * 125 + x AS BIGINT) AS node, cls, y, x FROM img), e AS (SELECT p.node AS u, q.node AS v FROM c p JOIN c q ON p.cls = q.cls AND p.cls <> 0 AND ((q.y = p.y AND q.x = p.x + 1) OR (q.x = p.x AND q.y = p.y + 1))), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), "
    "r AS (SELECT node, node AS l FROM c WHERE cls <> 0 UNION SELECT b.v, r.l FROM r JOIN b ON r.node = b.u WHERE r.l < b.v), m AS (SELECT node, min(l) AS l FROM r GROUP BY node), k AS (SELECT l, row_number() OVER (ORDER BY l) AS label FROM (SELECT DISTINCT l FROM m)) "
    "SELECT c.y, c.x, coalesce(k.label, 0) AS label FROM c LEFT JOIN m ON c.node = m.node LEFT JOIN k ON m.l = k.l"
)
def b10_label(s, d):
    return nb.label_components(img(s, d).select("y", "x", F.col("cls").alias("v")))


@register(f"WITH RECURSIVE {FACES}, b AS (SELECT u, v FROM e WHERE (u + v) % 5 = 0 UNION ALL SELECT v, u FROM e WHERE (u + v) % 5 = 0), n AS (SELECT u AS node FROM e UNION SELECT v FROM e), r AS (SELECT node, node AS l FROM n UNION SELECT b.v, r.l FROM r JOIN b ON r.node = b.u WHERE r.l < b.v) SELECT node, min(l) AS component FROM r GROUP BY node")
def g13_components(s, d):
    e = rg.rag(img(s, d))
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
    return components(e.where("(u + v) % 5 = 0"), nodes)


@register(f"WITH RECURSIVE {FACES}, b AS (SELECT u, v FROM e WHERE (u * 7 + v * 3) % 11 - 5 >= 0 UNION ALL SELECT v, u FROM e WHERE (u * 7 + v * 3) % 11 - 5 >= 0), n AS (SELECT u AS node FROM e UNION SELECT v FROM e), r AS (SELECT node, node AS l FROM n UNION SELECT b.v, r.l FROM r JOIN b ON r.node = b.u WHERE r.l < b.v) SELECT node, min(l) AS label FROM r GROUP BY node")
def m16_gasp_max(s, d):
    return so.gasp(signed_rag(s, d), "max")


def signed_rag(s: SparkSession, d: str) -> DataFrame:
    return rg.rag(img(s, d)).withColumn("w", ((F.col("u") * 7 + F.col("v") * 3) % 11 - 5).cast("double"))


# Tracking.
OVERLAP = "ov AS (SELECT a.z AS t, a.label AS source, b.label AS target, count(*) AS o FROM vol a JOIN vol b ON b.z = a.z + 1 AND b.y = a.y AND b.x = a.x WHERE a.label <> 0 AND b.label <> 0 GROUP BY 1, 2, 3), sz AS (SELECT z AS t, label AS source, count(*) AS n FROM vol GROUP BY 1, 2), te AS (SELECT t, source, target, o / CAST(n AS DOUBLE) AS score FROM ov JOIN sz USING (t, source))"


@register(f"WITH {OVERLAP} SELECT t, source, target, round(score, 6) AS score FROM te")
def t1_overlap_edges(s, d):
    return rounded(tr.overlap_edges(vol(s, d)), 6)


@register("WITH c AS (SELECT z, label, avg(y) AS y, avg(x) AS x FROM vol WHERE label <> 0 GROUP BY 1, 2), e AS (SELECT a.z AS t, a.label AS source, b.label AS target, sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2)) AS d FROM c a JOIN c b ON b.z = a.z + 1) SELECT t, source, target, round(1 - d / (SELECT max(d) FROM e WHERE d <= 4), 6) + 0.0 AS score FROM e WHERE d <= 4")
def t2_centroid_edges(s, d):
    return rounded(tr.centroid_edges(vol(s, d), 4.0), 6)


@register("SELECT label AS node, round(avg(raw) + 1.3e-6, 4) AS cost FROM vol WHERE label <> 0 GROUP BY label")
def t3_node_costs(s, d):
    return rounded(tr.node_costs(vol(s, d)), nudge=NUDGE)


@register("WITH p AS (SELECT z, label, row_number() OVER (PARTITION BY z ORDER BY label) AS r FROM (SELECT DISTINCT z, label FROM vol WHERE label <> 0)), o AS (SELECT z, coalesce(sum(n) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT z, max(r) AS n FROM p GROUP BY z)) SELECT v.z, v.y, v.x, v.label, CAST(coalesce(r + o, 0) AS BIGINT) AS new FROM vol v LEFT JOIN p ON v.z = p.z AND v.label = p.label LEFT JOIN o ON v.z = o.z")
def t4_relabel_frames(s, d):
    return tr.relabel_across_time(vol(s, d)).select("z", "y", "x", "label", "new")


LINEAGE = "li AS (SELECT DISTINCT t * 1000 + source AS source, (t + 1) * 1000 + target AS target FROM te WHERE score > 0.35)"


def lineage(s: SparkSession, d: str) -> DataFrame:
    e = tr.overlap_edges(vol(s, d)).where("score > 0.35")
    return e.select((F.col("t") * 1000 + F.col("source")).alias("source"), ((F.col("t") + 1) * 1000 + F.col("target")).alias("target")).distinct()


@register(f"WITH RECURSIVE {OVERLAP}, {LINEAGE}, b AS (SELECT source AS u, target AS v FROM li UNION ALL SELECT target, source FROM li), r AS (SELECT u AS node, u AS l FROM b UNION SELECT b.v, r.l FROM r JOIN b ON r.node = b.u WHERE r.l < b.v) SELECT node, min(l) AS component FROM r GROUP BY node")
def t8_lineage(s, d):
    return tr.lineage_components(lineage(s, d))


@register(f"WITH RECURSIVE {OVERLAP}, {LINEAGE}, one AS (SELECT source FROM li GROUP BY source HAVING count(*) = 1), k AS (SELECT li.* FROM li JOIN one USING (source)), b AS (SELECT source AS u, target AS v FROM k UNION ALL SELECT target, source FROM k), n AS (SELECT source AS node FROM li UNION SELECT target FROM li), r AS (SELECT node, node AS l FROM n UNION SELECT b.v, r.l FROM r JOIN b ON r.node = b.u WHERE r.l < b.v) SELECT node, min(l) AS track FROM r GROUP BY node")
def t9_tracks(s, d):
    return tr.tracks(lineage(s, d))


@register("SELECT z, y, x, label, CASE WHEN label % 3 = 1 THEN label * 10 ELSE 0 END AS track FROM vol")
def t10_recolor(s, d):
    v = vol(s, d).select("z", "y", "x", "label")
    return tr.recolor(v, v.where("label % 3 = 1").select(F.col("label").alias("node"), (F.col("label") * 10).alias("track")).distinct()).select("z", "y", "x", "label", "track")


@register("SELECT label AS track_id, z AS t, round(avg(y) + 1.3e-6, 4) AS y, round(avg(x) + 1.3e-6, 4) AS x FROM vol WHERE label <> 0 GROUP BY 1, 2")
def t11_track_layer(s, d):
    return rounded(tr.track_layer(vol(s, d)), nudge=NUDGE)


@register()
def t7_select_edges(s, d):
    return tr.select_edges(tr.overlap_edges(vol(s, d)).select("source", "target", "score"), 0.2)


@register("SELECT x, y, z, CASE WHEN min(m) OVER (PARTITION BY y, x ORDER BY z RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 THEN 1 ELSE 0 END AS closed FROM (SELECT x, y, z, max(CAST(label <> 0 AS INT)) OVER (PARTITION BY y, x ORDER BY z RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM vol)")
def b15_closing(s, d):
    return nb.temporal_closing(vol(s, d).select("z", "y", "x", F.col("label").alias("v")), 1).select("x", "y", "z", "closed")


# Label multisets.
@register("SELECT y, x, id, n AS count FROM (SELECT CAST(floor(y / 2.0) AS BIGINT) AS y, CAST(floor(x / 5.0) AS BIGINT) AS x, seg AS id, CAST(count(*) AS INT) AS n, row_number() OVER (PARTITION BY floor(y / 2.0), floor(x / 5.0) ORDER BY count(*) DESC, seg) AS r FROM img GROUP BY floor(y / 2.0), floor(x / 5.0), seg) WHERE r <= 2")
def n1_n2_multisets(s, d):
    return mu.entries(mu.downsample(mu.create(img(s, d), label="seg"), [2, 5], restrict=2))


@register("SELECT seg AS id, count(*) AS count FROM img WHERE y BETWEEN 2 AND 6 AND x < 40 GROUP BY seg")
def n4_roi_histogram(s, d):
    return mu.histogram(mu.create(img(s, d), label="seg").where("y BETWEEN 2 AND 6 AND x < 40"))


# Resampling.
_M = np.array([[0.5, 0.25, 0.5], [-0.125, 0.75, 4.0], [0, 0, 1.0]])
_SRC = "m AS (SELECT max(y) AS top FROM img), g AS (SELECT a.y, b.x, 0.5 * a.y + 0.25 * b.x + 0.5 AS sy, -0.125 * a.y + 0.75 * b.x + 4.0 AS sx, top FROM (SELECT DISTINCT y FROM img) a, range(125) b(x), m)"


@register(f"WITH {_SRC} SELECT g.y, g.x, CASE WHEN sy BETWEEN 0 AND top AND sx BETWEEN 0 AND 124 THEN coalesce(raw, 0.0) ELSE 0.0 END AS raw FROM g LEFT JOIN img i ON i.y = CAST(floor(sy + 0.5) AS BIGINT) AND i.x = CAST(floor(sx + 0.5) AS BIGINT)")
def a6_affine_nearest(s, d):
    shape = {"y": rows_of(s, d), "x": 125}
    return tf.affine(img(s, d).select("y", "x", "raw"), _M, shape, shape, 0, value="raw")


@register(
    f"WITH {_SRC}, k AS (SELECT y, x, floor(sy) + dy AS ty, floor(sx) + dx AS tx, (CASE WHEN dy = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN dx = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w FROM g, range(2) p(dy), range(2) q(dx) WHERE sy BETWEEN 0 AND top AND sx BETWEEN 0 AND 124) "
    "SELECT g.y, g.x, round(coalesce(s, 0.0) + 1.3e-6, 4) AS raw FROM g LEFT JOIN (SELECT k.y, k.x, sum(w * raw) AS s FROM k JOIN img i ON i.y = ty AND i.x = tx WHERE w > 0 GROUP BY k.y, k.x) r ON g.y = r.y AND g.x = r.x"
)
def a6_affine_linear(s, d):
    shape = {"y": rows_of(s, d), "x": 125}
    return rounded(tf.affine(img(s, d).select("y", "x", "raw"), _M, shape, shape, 1, value="raw"), nudge=NUDGE)


@register("WITH m AS (SELECT max(y) AS top FROM img), t AS (SELECT DISTINCT 2 * y AS y FROM img UNION SELECT DISTINCT 2 * y + 1 FROM img) SELECT t.y, b.x, CASE WHEN t.y * 0.5 <= top THEN coalesce(raw, 0.0) ELSE 0.0 END AS raw FROM t CROSS JOIN range(25) b(x) CROSS JOIN m LEFT JOIN img i ON i.y = CAST(floor(t.y * 0.5 + 0.5) AS BIGINT) AND i.x = b.x * 5")
def a8_resize(s, d):
    n = rows_of(s, d)
    return tf.resize(img(s, d).select("y", "x", "raw"), {"y": 2 * n, "x": 25}, {"y": n, "x": 125}, 0, "raw")


# Range joins, maxima, geometry.
@register("WITH o AS (SELECT y, x, seg FROM img WHERE cls = 0), p AS (SELECT DISTINCT y * 1000 + x AS pid, y, x FROM pts), j AS (SELECT pid, sqrt(power(p.y - o.y, 2) + power(p.x - o.x, 2)) AS d, seg FROM p JOIN o ON abs(p.y - o.y) <= 6 AND abs(p.x - o.x) <= 6), b AS (SELECT pid, d, seg, row_number() OVER (PARTITION BY pid ORDER BY d, seg) AS r FROM j WHERE d <= 6) SELECT p.pid, coalesce(seg, -1) AS label, round(coalesce(d, -1), 6) AS distance FROM p LEFT JOIN b ON p.pid = b.pid AND r = 1")
def b7_points_to_objects(s, d):
    p = view(s, d, "pts").select((F.col("y") * 1000 + F.col("x")).alias("pid"), "y", "x").distinct()
    o = img(s, d).where("cls = 0").select("y", "x", (F.col("seg") + 1).alias("label"))
    return nb.points_to_objects(o, p, 6).select("pid", (F.col("label") - 1).alias("label"), F.round(F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance")), 6).alias("distance"))


@register("SELECT p.y, p.x, p.raw FROM img p WHERE raw > 400000 AND NOT EXISTS (SELECT 1 FROM img q WHERE abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 AND q.raw > p.raw)")
def b9_local_maxima(s, d):
    return nb.local_maxima(img(s, d), distance=2, threshold=400000.0)


@register("SELECT y, x, (CAST(floor(y / 4.0) AS BIGINT) + CAST(floor(x / 25.0) AS BIGINT)) % 2 AS colour FROM img")
def u4_checkerboard(s, d):
    return nb.checkerboard(img(s, d), [4, 25]).select("y", "x", "colour")


@register("SELECT c_custkey AS i, CAST(floor(c_custkey / 12.0) AS BIGINT) * 80 AS py, c_custkey % 12 * 112 AS px FROM customer")
def v3_grid_positions(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("i"))
    return ge.grid_positions(c, "i", (64, 96), 12)


@register("WITH b AS (SELECT u AS id, v AS n FROM signed UNION SELECT v, u FROM signed), l AS (SELECT id, min(n) AS m, count(*) AS k FROM b GROUP BY id) SELECT id, CASE WHEN k >= 2 THEN m ELSE -1 END AS parent FROM l")
def s21_swc_parents(s, d):
    e = view(s, d, "signed")
    nodes = e.select(F.col("u").alias("id")).unionByName(e.select(F.col("v").alias("id"))).distinct()
    return ge.swc_parents(nodes, e)


@register("SELECT z, y, x, label, raw, 1 AS object FROM vol WHERE label IN (SELECT label FROM vol WHERE raw > 450000)")
def s26_carving(s, d):
    v = vol(s, d)
    return ge.carved_object(v, v.where("raw > 450000").select("label").distinct()).select("z", "y", "x", "label", "raw", "object")


# Kernels per block or component; SQL can't express them, tests compare them with whole-array kernels.
@register()
def b2_gaussian_smoothing(s, d):
    return rounded(nb.apply_filter(img(s, d), "gaussian_smoothing", 1.0, [32, 64]))


@register()
def b5_hessian_eigenvalues(s, d):
    return rounded(nb.apply_filter(img(s, d), "hessian_of_gaussian_eigenvalues", 1.0, [32, 64]), 2)


@register()
def b6_distance_transform(s, d):
    return rounded(nb.distance_transform(img(s, d).select("y", "x", F.col("cls").alias("v")), [32, 64], [16, 16]))


@register()
def b8_seeded_watershed(s, d):
    i = img(s, d).withColumn("seed", F.when((F.col("y") % 8 == 4) & (F.col("x") % 8 == 4), F.col("y") * 125 + F.col("x") + 1).otherwise(0))
    return nb.seeded_watershed(i, [32, 64], [8, 8])


@register()
def x2_stacked_watershed(s, d):
    return nb.stacked_watershed(vol(s, d).withColumn("raw", F.col("raw") / 600000), sigma_seeds=1.0)


@register()
def m2_multicut_kernighan_lin(s, d):
    return so.multicut(signed_rag(s, d), "kernighan-lin")


@register()
def m1_multicut_greedy(s, d):
    return so.multicut(signed_rag(s, d), "greedy-additive")


@register()
def m3_multicut_fixation(s, d):
    return so.multicut(signed_rag(s, d), "greedy-fixation")


@register()
def m5_multicut_fusion(s, d):
    return so.multicut(signed_rag(s, d), "fusion-moves")


@register()
def m7_blockwise_multicut(s, d):
    e = signed_rag(s, d)
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    return so.blockwise_multicut(e, nodes.withColumn("block", F.floor(F.col("node") / 100)))


@register()
def m9_lifted_multicut(s, d):
    e = signed_rag(s, d)
    return so.lifted(e, gr.lifted_neighbourhood(e, 2).withColumn("w", F.lit(-0.5)))


@register()
def m11_m12_mutex_watershed(s, d):
    return so.mws(signed_rag(s, d).withColumn("mutex", F.col("w") < 0))


@register()
def m16_gasp_mean(s, d):
    return so.gasp(signed_rag(s, d), "mean")


@register()
def m18_agglomerative(s, d):
    return so.agglomerative(signed_rag(s, d).withColumn("w", F.col("w") + 6).withColumn("size", F.lit(1.0)), 20)


@register()
def m21_graph_watershed(s, d):
    e = signed_rag(s, d)
    return so.watershed_on_graph(e, e.select(F.col("u").alias("node")).distinct().where("node % 40 = 0").withColumn("seed", F.col("node") + 1))


@register()
def x8_multicut_workflow(s, d):
    """Superpixels per slice, adjacency, boundary means, costs, multicut, labels back to voxels."""
    return wf.simple_multicut(vol(s, d).withColumn("raw", F.col("raw") / 600000), True, sigma_seeds=1.0)


@register()
def x9_lifted_multicut_workflow(s, d):
    """As x8, with lifted costs from bands of rows."""
    v = vol(s, d).withColumn("raw", F.col("raw") / 600000)
    return wf.lifted_from_segmentation(v.withColumn("prior", F.floor(F.col("y") / 8)), "prior", True, 0.5, 2, 1.0, -1.0, sigma_seeds=1.0)


@register()
def x3_two_pass_watershed(s, d):
    return nb.two_pass_watershed(img(s, d).withColumn("raw", F.col("raw") / 600000), [32, 64], [8, 8], sigma_seeds=1.0)


# Learning, filters and further partitions; tests compare them with small worked cases.
@register()
def l1_l3_edge_random_forest(s, d):
    """A forest of boundary features learnt from ground-truth edge labels, applied to all edges."""
    i = img(s, d)
    f = rg.boundary_features(i)
    e = f.join(rg.edge_labels(f.select("u", "v"), i), ["u", "v"])
    names = [c for c in f.columns if c not in ("u", "v")]
    model = le.learn_edge_random_forest(e, names, mask="valid", trees=10, depth=5)
    return rounded(le.predict_edge_random_forest(model, e).select("u", "v", "p"))


@register()
def g5_boundary_features_with_filters(s, d):
    return rounded(rg.boundary_features_with_filters(img(s, d), [32, 64], filters={"gaussian_smoothing": [1.6], "hessian_of_gaussian_eigenvalues": [1.6]}), 2)


@register()
def m13_seeded_mutex_watershed(s, d):
    e = signed_rag(s, d).withColumn("mutex", F.col("w") < 0)
    seeds = e.select(F.col("u").alias("node")).distinct().where("node % 40 = 0").withColumn("seed", F.col("node") % 3 + 1)
    return so.seeded_mws(e, seeds)


@register()
def m14_semantic_mutex_watershed(s, d):
    e = signed_rag(s, d).withColumn("mutex", F.col("w") < 0)
    votes = img(s, d).groupBy(F.col("seg").alias("node")).agg((F.max("gt") % 3).alias("kind"), (F.avg("raw") / 100000).alias("strength"))
    return so.semantic_mws(e, votes)


@register()
def m15_blockwise_mutex_watershed(s, d):
    e = signed_rag(s, d).withColumn("mutex", F.col("w") < 0)
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    return so.blockwise_mws(e, nodes.withColumn("block", F.floor(F.col("node") / 100)))


@register()
def m20_cluster_segmentation(s, d):
    return so.cluster_segmentation(img(s, d), 0.2).select("y", "x", "seg", "cluster")


@register()
def m21_graph_size_filter(s, d):
    sizes = img(s, d).groupBy(F.col("seg").alias("node")).agg(F.count("*").alias("size"))
    return so.graph_size_filter(signed_rag(s, d), sizes, 20)


@register()
def r10_apply_size_filter(s, d):
    return nb.apply_size_filter(img(s, d).select("y", "x", F.col("seg").alias("label"), "raw"), 20, [32, 64], [8, 8])
