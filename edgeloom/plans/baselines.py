"""Trains embedding models on one split and reports filtered metrics side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import kge, metrics
from edgeloom.session import cut_lineage


def run_baselines(train: DataFrame, test: DataFrame, true_triples: DataFrame, entity_ids: DataFrame,
                  relation_ids: DataFrame, models: Sequence[str] = tuple(kge.SCORERS), dim: int = 128,
                  epochs: int = 100, lr: float = 1e-3, seed: int = 42) -> DataFrame:
    """One row per model and relation (``ALL`` for the total) with filtered MRR and Hits@K.

    ``true_triples`` should hold every split's triples; candidates are all entities.
    """
    train, test, true_triples = cut_lineage(train), cut_lineage(test), cut_lineage(true_triples)
    reports = []
    for model in models:
        entities, relations, _ = kge.fit(train, entity_ids, relation_ids, model, dim, epochs, lr, seed)
        ranks = kge.filtered_ranks(test, true_triples, entities, relations, model)
        report = metrics.filtered_report(ranks.withColumn("relation", F.col("r").cast("string")))
        reports.append(report.withColumn("model", F.lit(model)))
    out = reports[0]
    for other in reports[1:]:
        out = out.unionByName(other)
    return out
