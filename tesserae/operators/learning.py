"""Random forests on edge features, for one kind of edges or for in-plane and between-plane edges apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def learn_edge_random_forest(edges: DataFrame, features: Sequence[str], label: str = "label", mask: str | None = None, trees: int = 50, depth: int = 8, seed: int = 0) -> PipelineModel:
    """A forest for the 0/1 ``label`` of edges; where ``mask`` names a column, only edges for which it holds are used.

    Null and NaN features count as 0. An edge table without rows to learn from is an error of the forest.
    """
    if missing := [c for c in [*features, label, *([mask] if mask else [])] if c not in edges.columns]:
        raise ValueError(f"columns {missing} are missing")
    rows = edges.where(F.col(mask)) if mask else edges
    rows = rows.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("_label"))
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), forest]).fit(rows)


def predict_edge_random_forest(model: PipelineModel, edges: DataFrame, probability: str = "p") -> DataFrame:
    """``edges`` with the probability of label 1."""
    features = model.stages[0].getInputCols()
    kept = {f"_in_{c}": F.col(c) for c in features}
    filled = edges.withColumns(kept).withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in features})
    # A forest that saw label 0 only has a single class.
    found = model.transform(filled).withColumn(probability, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return found.select(*[F.col(f"_in_{c}").alias(c) if c in features else F.col(c) for c in edges.columns if c != probability], probability)


def learn_random_forests_for_xyz_edges(edges: DataFrame, features: Sequence[str], z_edge: str = "z_edge", **options) -> tuple[PipelineModel, PipelineModel]:
    """(forest of in-plane edges, forest of edges between planes)."""
    return learn_edge_random_forest(edges.where(~F.col(z_edge)), features, **options), learn_edge_random_forest(edges.where(F.col(z_edge)), features, **options)


def predict_edge_random_forests_for_xyz_edges(in_plane: PipelineModel, between: PipelineModel, edges: DataFrame, z_edge: str = "z_edge", probability: str = "p") -> DataFrame:
    """``edges`` with the probability that the forest of their kind gives."""
    return predict_edge_random_forest(in_plane, edges.where(~F.col(z_edge)), probability).unionByName(predict_edge_random_forest(between, edges.where(F.col(z_edge)), probability))
