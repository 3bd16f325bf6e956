"""Comparison of segmentations; all metrics come from one contingency table (a: ground truth, b: segmentation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(x: DataFrame, a: str = "gt", b: str = "seg", ignore_a: Sequence[int] = (), ignore_b: Sequence[int] = ()) -> DataFrame:
    """(a, b, n); a voxel is ignored when all given ignore lists hold for it."""
    conditions = [F.col(c).isin(list(v)) for c, v in ((a, ignore_a), (b, ignore_b)) if v]
    if conditions:
        x = x.where(~(conditions[0] & conditions[-1]))
    return x.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def marginals(ct: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ct.groupBy("a").agg(F.sum("n").alias("na")), ct.groupBy("b").agg(F.sum("n").alias("nb"))


def with_marginals(ct: DataFrame) -> DataFrame:
    na, nb = marginals(ct)
    return ct.join(na, "a").join(nb, "b")


def _squares(ct: DataFrame) -> DataFrame:
    na, nb = marginals(ct)
    sq = lambda c: F.sum(F.pow(F.col(c).cast("double"), 2))
    return ct.agg(sq("n").alias("s"), F.sum("n").cast("double").alias("t")).crossJoin(na.agg(sq("na").alias("sa"))).crossJoin(nb.agg(sq("nb").alias("sb")))


def rand_index(ct: DataFrame) -> DataFrame:
    """(rand_error, rand_index): one minus the adapted Rand F-score, and the Rand index."""
    p, r = F.col("s") / F.col("sb"), F.col("s") / F.col("sa")
    return _squares(ct).select((1 - 2 * p * r / (p + r)).alias("rand_error"), (1 - (F.col("sa") + F.col("sb") - 2 * F.col("s")) / (F.col("t") * F.col("t"))).alias("rand_index"))


def variation_of_information(ct: DataFrame, use_log2: bool = True) -> DataFrame:
    """(vi_split, vi_merge)."""
    log = (lambda c: F.log2(c)) if use_log2 else (lambda c: F.log(c))
    total = ct.agg(F.sum("n").cast("double").alias("t"))
    info = with_marginals(ct).crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * log(F.col("t") * F.col("n") / (F.col("na").cast("double") * F.col("nb")))).alias("i"))
    na, nb = marginals(ct)
    h = lambda m, c: m.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * log(F.col(c) / F.col("t")))).alias(f"h{c}"))
    return info.crossJoin(h(na, "na")).crossJoin(h(nb, "nb")).select((F.col("hnb") - F.col("i")).alias("vi_split"), (F.col("hna") - F.col("i")).alias("vi_merge"))


def object_vi(ct: DataFrame) -> DataFrame:
    """(a, vi_split, vi_merge) per ground-truth object."""
    p, q = F.col("n") / F.col("na"), F.col("n") / F.col("nb")
    return with_marginals(ct).groupBy("a").agg((-F.sum(p * F.log2(q))).alias("vi_split"), (-F.sum(p * F.log2(p))).alias("vi_merge"))


def cremi_score(ct: DataFrame) -> DataFrame:
    both = variation_of_information(ct).crossJoin(rand_index(ct))
    return both.select("vi_split", "vi_merge", "rand_error", F.sqrt(F.col("rand_error") * (F.col("vi_split") + F.col("vi_merge"))).alias("cremi"))


def dice_score(x: DataFrame, a: str, b: str, threshold_a: float | None = 0, threshold_b: float | None = 0) -> DataFrame:
    f = lambda c, t: F.col(c).cast("double") if t is None else (F.col(c) > t).cast("double")
    s, g = f(a, threshold_a), f(b, threshold_b)
    return x.agg((2 * F.sum(s * g) / (F.sum(s) + F.sum(g) + F.lit(1e-7))).alias("dice"))


def best_dice(ct: DataFrame) -> DataFrame:
    """(a, dice) with the best dice of each ground-truth object but 0 over the objects but 0 of the other side."""
    d = F.when(F.col("b") != 0, 2 * F.col("n") / (F.col("na") + F.col("nb") + F.lit(1e-7))).otherwise(0.0)
    return with_marginals(ct).where("a <> 0").groupBy("a").agg(F.max(d).alias("dice"))


def symmetric_best_dice(ct: DataFrame) -> DataFrame:
    there = best_dice(ct).agg(F.coalesce(F.avg("dice"), F.lit(0.0)).alias("d1"))
    back = best_dice(ct.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).agg(F.coalesce(F.avg("dice"), F.lit(0.0)).alias("d2"))
    return there.crossJoin(back).select(F.least("d1", "d2").alias("dice"))


def label_overlap(ct: DataFrame, criterion: str = "iou", ignore_label: int | None = 0) -> DataFrame:
    """(a, b, score); rows are the segmentation (b), columns the ground truth (a): iot divides by rows, iop by columns."""
    n = F.col("n").cast("double")
    whole = {"iou": F.col("na") + F.col("nb") - F.col("n"), "iot": F.col("nb"), "iop": F.col("na")}[criterion]
    out = with_marginals(ct).select("a", "b", (n / F.greatest(whole.cast("double"), F.lit(1e-7))).alias("score"))
    return out if ignore_label is None else out.where((F.col("a") != ignore_label) & (F.col("b") != ignore_label))


def hungarian(cost):
    """Row for each column of a least-cost assignment (columns <= rows) by shortest augmenting paths."""
    import numpy as np

    cost = np.asarray(cost, float)
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        match[m], j0 = i, m
        low, used, way = np.full(m, np.inf), np.zeros(m + 1, bool), np.full(m, m)
        while match[j0] >= 0:
            used[j0] = True
            free = np.flatnonzero(~used[:m])
            cur = cost[match[j0], free] - u[match[j0]] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[free] -= delta
            j0 = j1
        while j0 != m:
            match[j0], j0 = match[way[j0]], way[j0]
    return match[:m]


def matched_pairs(overlap: DataFrame, threshold: float) -> DataFrame:
    """Number of matches (tp) at a threshold by optimal assignment, one task per connected group of objects."""
    from tesserae.plans.fixpoint import components

    edges = overlap.where(F.col("score") > 0).select((2 * F.col("a")).alias("u"), (2 * F.col("b") + 1).alias("v"), "score")
    group = components(edges.select("u", "v"))

    def solve(pdf):
        import numpy as np
        import pandas as pd

        a, b = np.unique(pdf["u"]), np.unique(pdf["v"])
        score = np.zeros((len(a), len(b)))
        score[np.searchsorted(a, pdf["u"]), np.searchsorted(b, pdf["v"])] = pdf["score"]
        k = min(score.shape)
        cost = -(score >= threshold).astype(float) - score / (2 * k)
        cost = cost if cost.shape[0] <= cost.shape[1] else cost.T
        row = hungarian(cost)
        used = np.flatnonzero(row >= 0)
        s = score if score.shape[0] <= score.shape[1] else score.T
        return pd.DataFrame({"tp": [int((s[row[used], used] >= threshold).sum())]})

    return edges.join(group, F.col("u") == F.col("node")).groupBy("component").applyInPandas(solve, "tp long").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))


def scores_from_counts(counts: DataFrame) -> DataFrame:
    """precision, recall, segmentation_accuracy and f1 from tp and the numbers of objects; all 0 without a match."""
    tp, p, t = (F.col(c).cast("double") for c in ("tp", "n_seg", "n_gt"))
    safe = lambda x, y: F.when(tp > 0, x / y).otherwise(0.0)
    return counts.select(safe(tp, p).alias("precision"), safe(tp, t).alias("recall"), safe(tp, p + t - tp).alias("segmentation_accuracy"), safe(2 * tp, p + t).alias("f1"))


def matching(ct: DataFrame, threshold: float = 0.5, criterion: str = "iou", ignore_label: int | None = 0) -> DataFrame:
    """Scores of the optimal matching. For IoU above .5 a match is unique, so the pairs are counted; else assignment."""
    overlap = label_overlap(ct, criterion, ignore_label)
    if criterion == "iou" and threshold > 0.5:
        tp = overlap.agg(F.sum((F.col("score") >= threshold).cast("long")).alias("tp")).select(F.coalesce("tp", F.lit(0)).alias("tp"))
    else:
        tp = matched_pairs(overlap, threshold)
    keep = F.lit(True) if ignore_label is None else F.col("k") != ignore_label
    count = lambda c: ct.select(F.col(c).alias("k")).distinct().where(keep).agg(F.count("*").alias(f"n_{'gt' if c == 'a' else 'seg'}"))
    return scores_from_counts(tp.crossJoin(count("a")).crossJoin(count("b")))


def mean_segmentation_accuracy(ct: DataFrame, thresholds: Sequence[float] = tuple(0.5 + 0.05 * k for k in range(10)), ignore_label: int | None = 0) -> DataFrame:
    parts = None
    for t in thresholds:
        one = matching(ct, t, "iou", ignore_label).select(F.lit(t).alias("threshold"), "segmentation_accuracy")
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.avg("segmentation_accuracy").alias("mean_accuracy"))


def object_scores(ct: DataFrame, ignore_label: int = 0) -> DataFrame:
    """(b, best_iou): the best IoU of each segment over the ground truth; 0 where none."""
    best = label_overlap(ct, "iou", None).where(F.col("a") != ignore_label).groupBy("b").agg(F.max("score").alias("s"))
    return ct.select("b").distinct().where(F.col("b") != ignore_label).join(best, "b", "left").select("b", F.coalesce("s", F.lit(0.0)).alias("best_iou"))


def match_sets(ct: DataFrame, threshold: float, ignore_label: int = 0) -> DataFrame:
    """(id, kind): tp and fp for segments, fn for ground-truth objects, by IoU strictly above the threshold."""
    hits = label_overlap(ct, "iou", ignore_label).where(F.col("score") > threshold)
    seg, gt = (ct.select(F.col(c).alias("id")).distinct().where(F.col("id") != ignore_label) for c in ("b", "a"))
    hb, ha = hits.select(F.col("b").alias("id")).distinct(), hits.select(F.col("a").alias("id")).distinct()
    return seg.join(hb, "id", "left_semi").withColumn("kind", F.lit("tp")).unionByName(seg.join(hb, "id", "left_anti").withColumn("kind", F.lit("fp"))).unionByName(gt.join(ha, "id", "left_anti").withColumn("kind", F.lit("fn")))
