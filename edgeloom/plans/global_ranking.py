"""End-to-end ranking: every source x target pair scored, best entities reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants
from edgeloom.operators import blocks, ranking, scoring


def attach_names(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """Names of both ends of the selected pairs (at most k rows)."""
    names = vectors.select("node_type", "idx", "name")
    small = F.broadcast(top)
    out = small.join(names.select(F.col("node_type").alias("src_type"), F.col("idx").alias("src"),
                                  F.col("name").alias("original_name")), ["src_type", "src"])
    return F.broadcast(out).join(names.select(F.col("node_type").alias("dst_type"), F.col("idx").alias("dst"),
                                              F.col("name").alias("disease")), ["dst_type", "dst"])


def rank_targets(vectors: DataFrame, known: DataFrame, edge_types: Sequence[scoring.Triple], *,
                 target_type: str = "Disease", source_types: Sequence[str] = ("Gene", "Protein"),
                 top_k: int = 2000, forms: Sequence[tuple[str, str]] = constants.ENTITY_FORMS,
                 block: int = blocks.BLOCK) -> DataFrame:
    """Ranked, entity-resolved targets.

    Edge types are filtered first, each type pair is scored once, known pairs
    are masked inside the scoring cells, and each cell keeps ``top_k`` pairs.
    ``top_k`` is the report length, so the tail works on that many rows at most.
    """
    wanted = scoring.target_edge_types(edge_types, target_type, source_types)
    per_type = scoring.top_pairs(vectors, wanted, known, top_k, block)
    top = scoring.merge_top(per_type.drop("rank"), top_k)
    named = attach_names(top, vectors).withColumn(
        "canonical_name", ranking.canonical_name(F.col("original_name"), forms))
    return ranking.assign_rank(ranking.best_per_entity(named))
