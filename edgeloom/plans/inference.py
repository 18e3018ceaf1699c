"""Forward plan of the tempered graph transformer: features to the vectors that ranking takes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from edgeloom.operators import attention
from edgeloom.operators.attention import Linear, Norm
from edgeloom.session import cut_lineage


@dataclass(frozen=True)
class Layer:
    """Weights of one message-passing layer."""

    query: Linear
    key: Linear
    value: Linear
    skip: Linear
    out: Linear
    norm: Norm


def encode(features: DataFrame, encoder: Linear, norms: dict[str, Norm] | None = None) -> DataFrame:
    """Typed projection and LayerNorm of ``features(node_type, idx, vec)``."""
    return attention.typed_projection(features, encoder.weight, encoder.bias, norm=norms)


def forward(features: DataFrame, edges: DataFrame, temperatures: DataFrame, encoder: Linear, layers: Sequence[Layer],
            output: Linear, *, heads: int, dim: int, norms: dict[str, Norm] | None = None, bias: str | None = None,
            decay: float = 1.0, scope: str = "relation", value_side: str = "dst") -> DataFrame:
    """``(node_type, idx, vec)`` after the encoder, all layers and the output projection.

    Each layer is written, so its plan does not hold those before it.
    """
    state = cut_lineage(encode(features, encoder, norms))
    for layer in layers:
        weights = attention.attention_weights(
            edges, attention.linear(state, layer.query), attention.linear(state, layer.key), temperatures,
            heads=heads, dim=dim, scope=scope, bias=bias, decay=decay)
        messages = attention.attention_messages(
            state, weights, attention.linear(state, layer.value), heads=heads, dim=dim, value_side=value_side)
        state = cut_lineage(attention.residual_update(state, messages, layer.skip, layer.out, layer.norm))
    return attention.linear(state, output)
