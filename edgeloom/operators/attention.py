"""Tempered attention over typed edges, relational means, projections (inference)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.constants import MIN_TEMPERATURE
from edgeloom.functions import scalar as V
from edgeloom.operators.graph import EDGE_TYPE
from edgeloom.operators.skew import spread_join
from edgeloom.session import cut_lineage

PAIR = [*EDGE_TYPE, "src", "dst"]


def _slice(vec: str, head: int, width: int) -> Column:
    return F.slice(vec, head * width + 1, width)


def _side(vectors: DataFrame, end: str, name: str) -> DataFrame:
    return vectors.select(F.col("node_type").alias(f"{end}_type"), F.col("idx").alias(end),
                          F.col("vec").alias(name))


def attention_weights(edges: DataFrame, queries: DataFrame, keys: DataFrame, temperatures: DataFrame, *,
                      heads: int, dim: int, scope: str = "relation", bias: str | None = None,
                      decay: float = 1.0) -> DataFrame:
    """Per-edge softmax weights, one per head, as ``alpha``.

    Score: q(src).k(dst) / (max(tau, 0.01) * sqrt(d)) + bias * decay. The softmax
    runs over all edges of an edge type (``relation``) or per destination within
    it (``dst``). Maxima and sums are aggregates joined back: a large relation
    is never gathered in one task.
    """
    width = dim // heads
    if scope not in ("relation", "dst"):
        raise ValueError("scope must be 'relation' or 'dst'")
    rows = spread_join(edges, _side(queries, "src", "_q"), ["src_type", "src"])
    rows = spread_join(rows, _side(keys, "dst", "_k"), ["dst_type", "dst"])
    # One temperature per edge type: a short, closed list.
    rows = rows.join(F.broadcast(temperatures.select(*EDGE_TYPE, "tau")), EDGE_TYPE)
    scale = F.greatest(F.col("tau"), F.lit(MIN_TEMPERATURE)) * F.lit(float(np.sqrt(width)))
    prior = F.lit(0.0) if bias is None else F.col(bias) * F.lit(float(decay))
    scores = F.array(*[V.dot(_slice("_q", h, width), _slice("_k", h, width)) / scale + prior for h in range(heads)])
    scored = cut_lineage(rows.withColumn("_s", scores).drop("_q", "_k", "tau"))
    group = [*EDGE_TYPE] if scope == "relation" else [*EDGE_TYPE, "dst"]
    peaks = scored.groupBy(*group).agg(F.array(*[F.max(F.col("_s")[h]) for h in range(heads)]).alias("_max"))
    shifted = _attach(scored, peaks, group, scope).withColumn(
        "_e", F.zip_with("_s", "_max", lambda s, m: F.exp(s - m))).drop("_s", "_max")
    sums = shifted.groupBy(*group).agg(F.array(*[F.sum(F.col("_e")[h]) for h in range(heads)]).alias("_sum"))
    return _attach(shifted, sums, group, scope).withColumn(
        "alpha", F.zip_with("_e", "_sum", lambda e, s: e / s)).drop("_e", "_sum")


def _attach(rows: DataFrame, stats: DataFrame, group: Sequence[str], scope: str) -> DataFrame:
    if scope == "relation":  # one row per edge type
        return rows.join(F.broadcast(stats), list(group))
    return spread_join(rows, stats, list(group))


def mean_attention(weights: DataFrame) -> DataFrame:
    """Head-averaged attention per edge."""
    return weights.withColumn("attention", V.total(F.col("alpha")) / F.size("alpha")).drop("alpha")


def attention_layer(nodes: DataFrame, weights: DataFrame, values: DataFrame, *, heads: int, dim: int,
                    value_side: str = "dst") -> DataFrame:
    """Residual + LayerNorm of attention-weighted values, summed over edge types."""
    message = attention_messages(nodes, weights, values, heads=heads, dim=dim, value_side=value_side)
    return nodes.join(message, ["node_type", "idx"]).select(
        "node_type", "idx", V.layer_norm(V.add(F.col("vec"), F.col("message"))).alias("vec"))


def attention_messages(nodes: DataFrame, weights: DataFrame, values: DataFrame, *, heads: int, dim: int,
                       value_side: str = "dst") -> DataFrame:
    """``(node_type, idx, message)``: attention-weighted values of each node, summed over edge types.

    With ``value_side='dst'`` every message carries the receiver's own value, so
    only weights are summed per receiver and the value is applied once. Nodes
    without messages get zeros.
    """
    width = dim // heads
    if value_side == "dst":
        sums = weights.groupBy(F.col("dst_type").alias("node_type"), F.col("dst").alias("idx")).agg(
            F.array(*[F.sum(F.col("alpha")[h]) for h in range(heads)]).alias("_a"))
        joined = nodes.join(values.withColumnRenamed("vec", "_v"), ["node_type", "idx"]).join(
            sums, ["node_type", "idx"], "left")
        message = F.concat(*[V.scale(_slice("_v", h, width), F.coalesce(F.col("_a")[h], F.lit(0.0)))
                             for h in range(heads)])
    else:
        rows = spread_join(weights, _side(values, "src", "_v"), ["src_type", "src"]).select(
            F.col("dst_type").alias("node_type"), F.col("dst").alias("idx"),
            F.concat(*[V.scale(_slice("_v", h, width), F.col("alpha")[h]) for h in range(heads)]).alias("_m"))
        sums = rows.groupBy("node_type", "idx").agg(V.vector_sum("_m", dim).alias("_m"))
        joined = nodes.join(sums, ["node_type", "idx"], "left")
        message = F.coalesce("_m", V.zeros(dim))
    return joined.select("node_type", "idx", message.alias("message"))


def relational_mean(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Mean neighbour vector per relation, summed over relations, then ReLU.

    Nodes that receive nothing carry their vector forward. Sums combine inside
    each task before the shuffle.
    """
    rows = spread_join(edges.select(*PAIR), _side(nodes, "src", "_v"), ["src_type", "src"])
    means = rows.groupBy(*EDGE_TYPE, "dst").agg(V.vector_mean("_v", dim).alias("_m"))
    sums = means.groupBy(F.col("dst_type").alias("node_type"), F.col("dst").alias("idx")).agg(
        V.vector_sum("_m", dim).alias("_m"))
    return nodes.join(sums, ["node_type", "idx"], "left").select(
        "node_type", "idx", F.transform(F.coalesce("_m", "vec"), lambda x: F.greatest(x, F.lit(0.0))).alias("vec"))


@dataclass(frozen=True)
class Linear:
    """One matrix and shift for all node types, or one of each per type."""

    weight: np.ndarray | dict[str, np.ndarray]
    bias: np.ndarray | dict[str, np.ndarray] | float = 0.0

    def at(self, kind: str, x: np.ndarray) -> np.ndarray | None:
        """``x W + b`` for rows of a type; none if the type has no matrix."""
        weight = self.weight.get(kind) if isinstance(self.weight, dict) else self.weight
        if weight is None:
            return None
        bias = self.bias.get(kind, 0.0) if isinstance(self.bias, dict) else self.bias
        return x @ np.asarray(weight, dtype=np.float64) + bias


@dataclass(frozen=True)
class Norm:
    """Gain and shift of a LayerNorm."""

    gain: np.ndarray | float = 1.0
    shift: np.ndarray | float = 0.0
    eps: float = 1e-5

    def at(self, x: np.ndarray) -> np.ndarray:
        mean, var = x.mean(1, keepdims=True), x.var(1, keepdims=True)
        return (x - mean) / np.sqrt(var + self.eps) * self.gain + self.shift


NODE_VEC = "node_type string, idx bigint, vec array<double>"


def _by_type(rows: DataFrame, apply: Callable) -> DataFrame:
    """``apply(type, frame)`` on each task's rows of one type, as vectors; none leaves the type out."""

    def run(frames):
        for pdf in frames:
            for kind, part in pdf.groupby("node_type"):
                out = apply(kind, part)
                if out is not None:
                    yield pd.DataFrame({"node_type": kind, "idx": part["idx"].values, "vec": list(out)})

    return rows.mapInPandas(run, NODE_VEC)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def linear(nodes: DataFrame, layer: Linear) -> DataFrame:
    """``x W_type + b_type`` per node. Weights are model parameters, a few matrices."""
    rows = nodes.select("node_type", "idx", V.as_double(F.col("vec")).alias("vec"))
    return _by_type(rows, lambda kind, part: layer.at(kind, _stack(part["vec"])))


def typed_projection(nodes: DataFrame, weights: dict[str, np.ndarray], bias: dict[str, np.ndarray] | None = None,
                     eps: float = 1e-5, norm: dict[str, Norm] | None = None) -> DataFrame:
    """LayerNorm(x W_type + b_type) per node, with the gain and shift of its type if given."""
    layer, norms = Linear(weights, bias or {}), norm or {}

    def project(kind, part):
        x = layer.at(kind, _stack(part["vec"]))
        return None if x is None else norms.get(kind, Norm(eps=eps)).at(x)

    return _by_type(nodes.select("node_type", "idx", V.as_double(F.col("vec")).alias("vec")), project)


def residual_update(nodes: DataFrame, messages: DataFrame, skip: Linear, out: Linear, norm: Norm) -> DataFrame:
    """LayerNorm(skip(x) + out(message)) per node."""
    rows = nodes.join(messages, ["node_type", "idx"]).select(
        "node_type", "idx", V.as_double(F.col("vec")).alias("vec"), "message")
    return _by_type(rows, lambda kind, part: norm.at(skip.at(kind, _stack(part["vec"])) + out.at(kind, _stack(part["message"]))))
