"""Ordered running totals and dense numbering without a single-task window.

A plain ``Window.orderBy`` sends each group to one task, which fails when one
group holds a large share of the rows. Here rows are range-partitioned on
(group, order), totals run inside each slice, and slice offsets are added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import cut_lineage, parallelism, spread

SLICE = "_slice"


def sorted_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows tagged with their range slice.

    The tagged rows are written out: range bounds come from a sample, and every
    later read must see the same slices even if executors are lost.
    """
    n = parallelism(df.sparkSession, df)
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums over ``order`` inside each ``keys`` group.

    ``order`` should be unique within a group so that ties spread over slices. ``df`` is read twice, once
    for the bounds of the slices: hand over a written table where it is costly to make.
    """
    tmp = {name: f"_v_{name}" for name in sums}
    staged = df
    for name, expr in sums.items():
        staged = staged.withColumn(tmp[name], expr)
    staged = sorted_slices(staged, keys, order)

    local = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = staged.groupBy(SLICE, *keys).agg(
        *[F.sum(tmp[n]).alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        F.col(SLICE).alias("_oslice"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums])
    # Slices are contiguous, so each one continues at most one group: there are
    # fewer offset rows than slices, whatever the data size.
    first = next(iter(sums))
    offsets = F.broadcast(offsets.where(F.col(f"_b_{first}").isNotNull()))

    # Slices are of bounded size; each task gets few of them, however many there are.
    out = spread(staged, SLICE)
    for name in sums:
        out = out.withColumn(name, F.sum(tmp[name]).over(local))
    cond = F.col(SLICE) == F.col("_oslice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    out = out.join(offsets, cond, "left")
    return out.select(*[F.col(c) for c in df.columns], *[
        (F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in sums])


def dense_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 name: str = "idx", start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start`` inside each group, in order."""
    out = running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) + F.lit(start - 1))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ascending rank of ``value`` where ties share the mean of their ranks."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running_totals(counts, [], [F.col(value)], {"_upto": F.col("_ties")})
    ranks = ranked.select(
        F.col(value).alias("_rank_value"),
        (F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("_rank_value")).drop("_rank_value")
