"""Publication dates, literature support and evidence counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.constants import TEMPORAL_WINDOWS
from edgeloom.functions.scalar import parse_date
from edgeloom.operators.skew import spread_join
from edgeloom.session import spread


def resolve_dates(requested: DataFrame, cache: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Looks up only dates that are not cached.

    Returns the grown cache and the requested ids that have a date; ids found
    nowhere are absent.
    """
    todo = requested.select("pmid").distinct().join(cache, "pmid", "left_anti")
    fetched = source.where(F.col("pub_date").isNotNull()).join(todo, "pmid", "left_semi").select(
        "pmid", "pub_date")
    grown = cache.select("pmid", "pub_date").unionByName(fetched)
    return grown, grown.join(requested.select("pmid").distinct(), "pmid", "left_semi")


def date_edges(edges: DataFrame, dates: DataFrame, edge_id: Sequence[str]) -> DataFrame:
    """Earliest known date over the papers in ``pmids`` of each edge; null if none."""
    support = edges.select(*edge_id, F.explode_outer("pmids").alias("pmid"))
    dated = spread_join(support, dates.select("pmid", F.col("pub_date").alias("_d")), ["pmid"], "left")
    return spread(dated, *edge_id).groupBy(*edge_id).agg(F.min("_d").alias("pub_date"))


def inject_dates(edges: DataFrame, dates: DataFrame, edge_id: Sequence[str],
                 relations: Sequence[str]) -> DataFrame:
    """Replaces the dates of the given relations by ``dates(edge_id, pub_date)``."""
    chosen = F.coalesce(F.col("rel").isin(list(relations)), F.lit(False))
    # Only edges of these relations meet the dates, so dates of others need not be made.
    dated = edges.where(chosen).drop("pub_date").join(dates.select(*edge_id, "pub_date"), list(edge_id), "left")
    return edges.where(~chosen).unionByName(dated.select(*edges.columns))


def era(text: Column, windows: dict[str, str] = TEMPORAL_WINDOWS) -> Column:
    """Literature era of a publication date."""
    day = parse_date(text)
    bound = {k: F.lit(v).cast("date") for k, v in windows.items()}
    return (F.when(day <= bound["train_end"], "train_era").when(day <= bound["val_end"], "val_era")
            .when(day <= bound["test_end"], "prospective").otherwise("post_window"))


def prospective(dates: DataFrame, windows: dict[str, str] = TEMPORAL_WINDOWS) -> DataFrame:
    return dates.where(era(F.col("pub_date"), windows) == "prospective")


def newest_sources(mentions: DataFrame, cutoff: str, limit: int = 50) -> DataFrame:
    """Newest papers per entity up to the cut-off, numbered from 1.

    The rank filter is applied before the shuffle too, so a frequent entity
    sends at most ``limit`` rows per task.
    """
    newest = Window.partitionBy("entity").orderBy(F.col("pub_date").desc(), F.col("pmid"))
    return (mentions.where(F.col("pub_date") <= F.lit(cutoff))
            .withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= limit))


def entity_summaries(entities: DataFrame, sources: DataFrame, static: Sequence[str] = (),
                     max_sources: int = 10, per_source: int = 3, max_parts: int = 15,
                     static_chars: int = 500) -> DataFrame:
    """Summary text per entity from its numbered sources.

    Static sources win: up to ``per_source`` of them, cut to ``static_chars``
    by definition. Otherwise sentences that name the entity, else the name.
    """
    low = F.lower(F.col("entity"))
    trimmed = F.transform(
        F.filter(F.split(F.coalesce("abstract", F.lit("")), r"\."), lambda s: F.contains(F.lower(s), low)),
        lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    is_static = F.col("pmid").isin(list(static)) if static else F.lit(False)
    used = sources.select(
        "entity", "nth", is_static.alias("is_static"),
        F.when(is_static, F.array(F.concat(F.col("entity"), F.lit(": "),
                                           F.substring("abstract", 1, static_chars))))
        .otherwise(F.slice(trimmed, 1, per_source)).alias("parts"))
    nth_static = Window.partitionBy("entity").orderBy(F.col("is_static").desc(), "nth")
    used = used.withColumn("order", F.row_number().over(nth_static))
    # At most max_sources short lists per entity, so the collected group is bounded.
    used = used.where((F.col("is_static") & (F.col("order") <= per_source))
                      | (~F.col("is_static") & (F.col("nth") <= max_sources)))
    grouped = used.groupBy("entity").agg(
        F.max("is_static").alias("any_static"),
        F.array_sort(F.collect_list(F.struct("nth", "is_static", "parts"))).alias("rows"))
    kept = F.filter("rows", lambda r: r["is_static"] == F.col("any_static"))
    parts = F.slice(F.flatten(F.transform(kept, lambda r: r["parts"])), 1, max_parts)
    texts = grouped.select("entity", F.array_join(parts, ". ").alias("summary"))
    return entities.join(texts, "entity", "left").select(
        "entity", F.coalesce(F.nullif("summary", F.lit("")), F.col("entity")).alias("summary"))


def evidence_counts(mentions: DataFrame, date_from: str, date_to: str, examples: int = 5) -> DataFrame:
    """Distinct papers per target inside a date window, with a few example ids."""
    day = parse_date(F.col("pub_date"))
    inside = mentions.where(day.between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))).select(
        "target", "pmid").distinct()
    counts = inside.groupBy("target").agg(F.count(F.lit(1)).alias("n_hits"))
    first = Window.partitionBy("target").orderBy("pmid")
    shown = (inside.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= examples)
             .groupBy("target").agg(F.array_sort(F.collect_list("pmid")).alias("pmids")))
    return counts.join(shown, "target")


def prediction_status(predictions: DataFrame, mentions: DataFrame,
                      windows: dict[str, str] = TEMPORAL_WINDOWS) -> DataFrame:
    """prospective / reproduction / unvalidated per predicted target."""
    seen = mentions.groupBy("target").agg(
        F.count(F.when(era(F.col("pub_date"), windows) == "prospective", 1)).alias("n_prospective"),
        F.count(F.when(era(F.col("pub_date"), windows).isin("train_era", "val_era"), 1)).alias("n_earlier"))
    out = predictions.join(seen, "target", "left").fillna(0, ["n_prospective", "n_earlier"])
    return out.withColumn("status", F.when(F.col("n_prospective") > 0, "prospective")
                          .when(F.col("n_earlier") > 0, "reproduction").otherwise("unvalidated"))


def neglect_ratio(mentions: DataFrame, topic: str, reference: str) -> DataFrame:
    """Share of a target's papers on a topic, and how much more a reference topic has."""
    low = F.lower("abstract")
    counted = mentions.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.contains(low, F.lit(topic)), 1)).alias("n_topic"),
        F.count(F.when(F.contains(low, F.lit(reference)), 1)).alias("n_reference"))
    return counted.withColumn(
        "topic_pct", F.round(F.lit(100.0) * F.col("n_topic") / F.col("n_total"), 1)).withColumn(
        "neglect_ratio", F.round(F.try_divide(F.col("n_reference").cast("double"), F.col("n_topic")), 1))
