"""Temporal and stratified splits, inductive routing, reports and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.constants import TEMPORAL_WINDOWS
from edgeloom.functions.scalar import parse_date, seeded_key
from edgeloom.operators.graph import EDGE_TYPE, first_occurrence
from edgeloom.operators.ordering import dense_number
from edgeloom.operators.skew import spread_join
from edgeloom.session import cut_lineage, spread

PAIR = [*EDGE_TYPE, "src", "dst"]


def temporal_split(edges: DataFrame, windows: dict[str, str] = TEMPORAL_WINDOWS) -> DataFrame:
    """Adds ``split``: train / val / test, or dropped for dates in no window."""
    day = F.col("_day")
    bound = {k: F.lit(v).cast("date") for k, v in windows.items()}
    return edges.withColumn("_day", parse_date(F.col("pub_date"))).withColumn(
        "split",
        F.when(day <= bound["train_end"], "train")
        .when(day.between(bound["val_start"], bound["val_end"]), "val")
        .when(day.between(bound["test_start"], bound["test_end"]), "test")
        .otherwise("dropped")).drop("_day")


def known_nodes(nodes: DataFrame, train_end: str) -> DataFrame:
    """Nodes already published at the training cut-off; undated nodes count as known."""
    return nodes.where(parse_date(F.col("pub_date")) <= F.lit(train_end).cast("date")).select(
        "node_type", "idx")


def route_inductive(split_edges: DataFrame, nodes: DataFrame,
                    train_end: str = TEMPORAL_WINDOWS["train_end"]) -> DataFrame:
    """Relabels test edges with an endpoint unknown in training as ``inductive``."""
    known = known_nodes(nodes, train_end)

    def side(end: str) -> DataFrame:
        return known.select(F.col("node_type").alias(f"{end}_type"), F.col("idx").alias(end),
                            F.lit(True).alias(f"_{end}_known"))

    test = split_edges.where("split = 'test'")
    test = spread_join(test, side("src"), ["src_type", "src"], "left")
    test = spread_join(test, side("dst"), ["dst_type", "dst"], "left")
    both = F.col("_src_known") & F.col("_dst_known")
    routed = test.withColumn("split", F.when(both, "test").otherwise("inductive"))
    return split_edges.where("split <> 'test'").unionByName(routed.select(*split_edges.columns))


def temporal_report(routed: DataFrame) -> DataFrame:
    """One row of counts over a routed temporal split."""
    def n(split):
        return F.count(F.when(F.col("split") == split, 1))

    def types(split):
        return F.count_distinct(F.when(F.col("split") == split, F.concat_ws("__", *EDGE_TYPE)))

    per_type = routed.groupBy("split", *EDGE_TYPE).agg(F.count(F.lit(1)).alias("n"))

    def total(split):
        return F.coalesce(F.sum(F.when(F.col("split") == split, F.col("n"))), F.lit(0))

    out = per_type.agg(
        total("train").alias("train_edges"), total("val").alias("val_edges"),
        total("test").alias("test_edges"), total("inductive").alias("inductive_edges"),
        types("train").alias("train_edge_types"), types("test").alias("test_edge_types"))
    held = F.col("test_edges") + F.col("inductive_edges")
    return out.withColumn("has_temporal_info", F.col("test_edges") > 0).withColumn(
        "transductive_fraction",
        F.coalesce(F.round(F.try_divide(F.col("test_edges").cast("double"), held), 6), F.lit(0.0)))


def stratified_split(edges: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1,
                     seed: int = 42, min_edges: int = 10,
                     relations: Sequence[str] | None = None) -> DataFrame:
    """Seeded split of each edge type; types under ``min_edges`` stay in train.

    The shuffle position comes from a digest of seed and endpoints, so it does
    not depend on partitioning and repeats exactly.
    """
    if abs(train + val + test - 1.0) >= 1e-9:
        raise ValueError("fractions must sum to 1")
    if relations is not None:
        edges = edges.where(F.col("rel").isin(list(relations)))
    unique = spread(edges.select(*PAIR), "src", "dst").distinct()
    # Written once, for the bounds of the slices too. The bytes of a digest order as its digits do.
    keyed = cut_lineage(unique.withColumn("_k", F.unhex(seeded_key(seed, F.col("src"), F.col("dst")))))
    placed = dense_number(keyed, EDGE_TYPE, [F.col("_k"), F.col("src"), F.col("dst")], "_pos")
    sizes = placed.groupBy(*EDGE_TYPE).agg(F.count(F.lit(1)).alias("_n")).select(
        *EDGE_TYPE, "_n",
        F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(val))).cast("bigint").alias("_nv"),
        F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(test))).cast("bigint").alias("_nt"))
    # One row per edge type.
    joined = placed.join(F.broadcast(sizes), EDGE_TYPE)
    n_train = F.col("_n") - F.col("_nv") - F.col("_nt")
    return joined.withColumn(
        "split",
        F.when((F.col("_n") < min_edges) | (F.col("_pos") < n_train), "train")
        .when(F.col("_pos") < n_train + F.col("_nv"), "val").otherwise("test")).select(*PAIR, "split")


def stratified_report(split_edges: DataFrame) -> DataFrame:
    per_type = split_edges.groupBy(*EDGE_TYPE).agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "val", "test")])
    return per_type.agg(
        *[F.sum(s).alias(f"{s}_edges") for s in ("train", "val", "test")],
        *[F.count(F.when(F.col(s) > 0, 1)).alias(f"{s}_edge_types") for s in ("train", "val", "test")],
        F.count(F.when((F.col("val") == 0) & (F.col("test") == 0), 1)).alias("edge_types_without_split"))


def leakage_audit(split_edges: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Edges shared by each pair of splits, and their sizes, in one pass."""
    names = sorted({s for pair in pairs for s in pair})
    flags = split_edges.where(F.col("split").isin(names)).groupBy(*PAIR).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in names])
    sums = [F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                     F.sum(F.col(a)).alias("n_a"), F.sum(F.col(b)).alias("n_b"),
                     F.sum(F.col(a) * F.col(b)).alias("overlap")) for a, b in pairs]
    return flags.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def known_true(split_edges: DataFrame, splits: Sequence[str],
               relations: Sequence[str] | None = None) -> DataFrame:
    """Distinct true pairs over several splits."""
    out = split_edges.where(F.col("split").isin(list(splits)))
    if relations is not None:
        out = out.where(F.col("rel").isin(list(relations)))
    return spread(out.select(*PAIR), "src", "dst").distinct()


def message_graph(split_edges: DataFrame, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """Edges used for message passing at test time (bag union of the splits)."""
    return split_edges.where(F.col("split").isin(list(splits)))


__all__ = ["PAIR", "first_occurrence", "known_nodes", "known_true", "leakage_audit", "message_graph",
           "route_inductive", "stratified_report", "stratified_split", "temporal_report", "temporal_split"]
