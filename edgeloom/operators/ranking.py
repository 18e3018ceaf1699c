"""Annotation, entity resolution and reporting of ranked candidates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import constants
from edgeloom.functions.scalar import bind, first_match, has_any, holds_any

TIE_ORDER = ["src_type", "rel", "src", "dst"]


def is_textbook(name: Column, terms: Sequence[str] = constants.TEXTBOOK_TERMS) -> Column:
    return has_any(name, terms)


def is_mechanism(name: Column, terms: Sequence[str] = constants.MECHANISM_TERMS) -> Column:
    return has_any(name, terms)


def pathway_tags(name: Column, terms: dict[str, Sequence[str]] = constants.PATHWAY_TERMS) -> Column:
    """All tags with a term in the name, in table order."""
    def tags(low: Column) -> Column:
        return F.array(*[F.when(holds_any(low, words), F.lit(tag)) for tag, words in terms.items()])

    return F.filter(bind(F.lower(name), tags), lambda t: t.isNotNull())


def canonical_name(name: Column, forms: Sequence[tuple[str, str]] = constants.ENTITY_FORMS) -> Column:
    return first_match(F.lower(F.trim(name)), forms, name)


def anchor_name(name: Column, forms: Sequence[tuple[str, str]] = constants.ANCHOR_FORMS) -> Column:
    """Symbol of a known anchor, else the first 30 characters (by definition of the label)."""
    return first_match(F.lower(name), forms, F.substring(name, 1, 30))


def display_target(canonical: Column, original: Column) -> Column:
    """Canonical name with one spelling normalised; empty falls back to the original."""
    fixed = F.regexp_replace(canonical, "(?i)nf-.*b", "nf-kb")
    return F.coalesce(F.nullif(fixed, F.lit("")), original)


def matches(text: Column, low: Column, pattern: str) -> Column:
    """Case-insensitive pattern match; plain alternatives need no regex engine."""
    if re.fullmatch(r"[a-z0-9 |-]+", pattern):
        return holds_any(low, pattern.split("|"))
    return text.rlike(f"(?i){pattern}")


def category(name: Column, patterns: Sequence[tuple[str, str]] = constants.CATEGORY_PATTERNS,
             default: str = "Other") -> Column:
    """Category of the last matching pattern."""
    def pick(low: Column) -> Column:
        out = None
        for label, pattern in reversed(list(patterns)):
            hit = matches(name, low, pattern)
            out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
        return out.otherwise(F.lit(default))

    return bind(F.lower(name), pick)


def pathway_axis(name: Column, pattern: str = constants.FIBROSIS_AXIS_PATTERN,
                 axes: tuple[str, str] = constants.PATHWAY_AXES) -> Column:
    return bind(F.lower(name), lambda low: F.when(matches(name, low, pattern), F.lit(axes[1])).otherwise(F.lit(axes[0])))


def best_per_entity(candidates: DataFrame, key: str = "canonical_name") -> DataFrame:
    """Highest-scoring row per entity; earlier rows win ties. Combines before the shuffle."""
    cols = [c for c in candidates.columns if c != key]
    order = F.struct((-F.col("score")).alias("_neg"), *[F.col(c) for c in TIE_ORDER])
    return candidates.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in cols])


def assign_rank(candidates: DataFrame) -> DataFrame:
    """Final 1-based rank. Only for lists already cut to a report length."""
    order = Window.orderBy(F.col("score").desc(), *TIE_ORDER)
    return candidates.withColumn("rank", F.row_number().over(order).cast("bigint"))


def raw_ranks(candidates: DataFrame, terms: Sequence[str], name: str = "original_name") -> DataFrame:
    """Ranks before entity resolution of the candidates whose name holds one of the terms.

    ``candidates`` is a list already cut to a report length, with several rows an entity.
    """
    order = Window.orderBy(F.col("score").desc(), *TIE_ORDER)
    ranked = candidates.withColumn("raw_rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(has_any(F.lower(name), terms))


def category_share(ranked: DataFrame, top_n: int, name: str = "canonical_name",
                   patterns: Sequence[tuple[str, str]] = constants.CATEGORY_PATTERNS) -> DataFrame:
    """Count and percentage per category among the first ``top_n`` ranks."""
    counts = ranked.where(F.col("rank") <= top_n).groupBy(
        category(F.col(name), patterns).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))  # one row per category
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(whole) * 100, 1))


def head_table(ranked: DataFrame, n: int = 10, name_chars: int = 35, disease_chars: int = 20) -> DataFrame:
    """First rows of the ranking as a display table."""
    return ranked.where(F.col("rank") <= n).select(
        "rank", F.substring("canonical_name", 1, name_chars).alias("target"),
        F.col("src_type").alias("type"), F.round("score", 2).alias("score"),
        F.substring("disease", 1, disease_chars).alias("disease"))


def box_stats(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation, extremes and quartiles per metric after wide-to-long."""
    long = table.unpivot(list(keys), list(metrics), "metric", "value")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("value").alias("max"),
        F.min("value").alias("min"), F.percentile("value", F.lit(0.5)).alias("median"))


def compare_models(models: DataFrame, metric_columns: Sequence[str], ours: str) -> DataFrame:
    """First reported metric per model and fold change of ``ours`` over the best other."""
    value = F.coalesce(*[F.col(c) for c in metric_columns])
    named = models.select("model", value.alias("metric"))
    best = named.where(F.col("model") != ours).agg(F.max("metric")).first()[0]
    fold = F.try_divide(F.col("metric"), F.lit(best).cast("double"))
    return named.select("model", "metric", F.when(F.col("model") == ours, fold).alias("fold"))


def best_epoch(history: DataFrame, metric: str) -> DataFrame:
    return history.groupBy("model").agg(F.max_by("epoch", metric).alias("best_epoch"),
                                        F.max(metric).alias("best_value"))


def suppression(scores: DataFrame, reference: str) -> DataFrame:
    """Mean and best score on injected pairs per model and suppression 1 - mean/reference mean."""
    stats = scores.groupBy("model").agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    base = stats.where(F.col("model") == reference).agg(F.max("mean_score")).first()[0]
    out = stats.withColumn("suppression", F.lit(1.0) - F.try_divide(F.col("mean_score"), F.lit(base).cast("double")))
    lowest = Window.partitionBy(F.lit(1)).orderBy("mean_score", "model")  # one row per model
    return out.withColumn("is_best", F.row_number().over(lowest) == 1)


def overlap(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Membership of every gene in two lists, from one grouped pass."""
    both = predicted.select("gene", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        reference.select("gene", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("gene").agg((F.max("a") == 1).alias("in_predicted"), (F.max("b") == 1).alias("in_reference"))


def overlap_counts(members: DataFrame) -> DataFrame:
    a, b = F.col("in_predicted"), F.col("in_reference")
    out = members.agg(F.count(F.when(a & ~b, 1)).alias("predicted_only"),
                      F.count(F.when(~a & b, 1)).alias("reference_only"),
                      F.count(F.when(a & b, 1)).alias("intersection"))
    union = F.col("predicted_only") + F.col("reference_only") + F.col("intersection")
    return out.withColumn("jaccard", F.coalesce(F.try_divide(F.col("intersection").cast("double"), union), F.lit(0.0)))


def tier_predictions(predictions: DataFrame, rules: Sequence[tuple[float, str]], targets: DataFrame,
                     default: str) -> DataFrame:
    """Tier by the first score threshold reached, and membership in an outside list."""
    tier = None
    for threshold, label in rules:
        hit = F.col("score") >= threshold
        tier = F.when(hit, F.lit(label)) if tier is None else tier.when(hit, F.lit(label))
    marked = targets.select("gene").distinct().withColumn("_in", F.lit(True))
    return predictions.withColumn("tier", tier.otherwise(F.lit(default))).join(marked, "gene", "left").withColumn(
        "is_mr_target", F.coalesce("_in", F.lit(False))).drop("_in")


def tier_counts(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("n"),
                                      F.count(F.when(F.col("is_mr_target"), 1)).alias("n_mr"))
