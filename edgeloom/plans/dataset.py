"""End-to-end dataset build: label scans and raw edges to split edges and negatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants
from edgeloom.operators import graph, literature, negatives, splits


@dataclass
class Dataset:
    nodes: DataFrame
    edges: DataFrame
    negatives: DataFrame
    report: DataFrame


def build_dataset(label_scans: DataFrame, raw_edges: DataFrame, dates: DataFrame, *,
                  priority=constants.TYPE_PRIORITY, windows: dict[str, str] = constants.TEMPORAL_WINDOWS,
                  node_dates: DataFrame | None = None, per_edge: int = 1, seed: int = 42) -> Dataset:
    """Types nodes, numbers them, maps and dates edges, splits, and draws negatives.

    ``label_scans(node_id, label, name)``; ``raw_edges(src, rel, dst, pmids)`` over
    node ids; ``dates(pmid, pub_date)``.
    """
    merged = graph.merge_labels(label_scans)
    typed = merged.select("node_id", "name", graph.assign_type(F.col("labels"), priority).alias("node_type"))
    ids = graph.dense_ids(typed)
    if node_dates is None:
        nodes = ids.withColumn("pub_date", F.lit(None).cast("string"))
    else:
        nodes = ids.join(node_dates, "node_id", "left")
    nodes = nodes.select("node_type", F.col("local_idx").alias("idx"), "node_id", "name", "pub_date")

    def kind(end):
        return typed.select(F.col("node_id").alias(end), F.col("node_type").alias(f"{end}_type"))

    edges = raw_edges.join(kind("src"), "src").join(kind("dst"), "dst")
    mapped = graph.reindex_edges(edges, ids).select(
        "src_type", "rel", "dst_type", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "pmids")
    dated = literature.date_edges(mapped, dates, splits.PAIR)
    routed = splits.route_inductive(splits.temporal_split(dated, windows), nodes, windows["train_end"])
    train = routed.where("split = 'train'")
    drawn = negatives.degree_preserving(train, nodes, per_edge, seed)
    return Dataset(nodes, routed, drawn, splits.temporal_report(routed))
