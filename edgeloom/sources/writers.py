"""Sinks: triples, id maps, split datasets, ranked lists, subgraphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.graph import EDGE_TYPE, edge_key
from edgeloom.operators.skew import spread_join


def triple_table(edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples with global ids and names.

    ``entities(node_type, idx, global_id, name)``, ``relations(*edge type, relation_id)``.
    """
    def side(end: str, out: str) -> DataFrame:
        return entities.select(F.col("node_type").alias(f"{end}_type"), F.col("idx").alias(end),
                               F.col("global_id").alias(out), F.col("name").alias(f"{out}_name"))

    both = spread_join(edges, side("src", "head"), ["src_type", "src"])
    both = spread_join(both, side("dst", "tail"), ["dst_type", "dst"])
    rels = relations.select(*EDGE_TYPE, F.col("relation_id").alias("relation"))
    return both.join(rels, EDGE_TYPE).select("head", "relation", "tail", "head_name", "tail_name",
                                             edge_key().alias("relation_name"))


def write_triples(triples: DataFrame, path: str) -> None:
    triples.write.mode("errorifexists").option("header", True).csv(path)


def write_maps(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Entity and relation id maps as JSON records."""
    entities.select("node_type", "idx", "global_id").write.mode("errorifexists").json(f"{path}/entity_map")
    relations.select(edge_key().alias("relation"), "relation_id").write.mode("errorifexists").json(f"{path}/relation_map")


def write_dataset(split_edges: DataFrame, report: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Edges partitioned by split and relation, with a report beside them.

    The report is made from the written table, so the split is computed once.
    """
    split_edges.write.mode("errorifexists").partitionBy("split", "rel").parquet(f"{path}/edges")
    report(split_edges.sparkSession.read.parquet(f"{path}/edges")).write.mode("errorifexists").json(f"{path}/report")


def write_features(features: DataFrame, path: str, split: str) -> None:
    """Node features of one split, a folder for each node type."""
    features.write.mode("errorifexists").partitionBy("node_type").parquet(f"{path}/features/{split}")


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Ranked candidates as JSON records."""
    ranked.write.mode("errorifexists").json(path)


def write_subgraph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    edges.write.mode("errorifexists").option("header", True).csv(f"{path}/edges")
    nodes.write.mode("errorifexists").option("header", True).csv(f"{path}/nodes")
