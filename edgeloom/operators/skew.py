"""Join of a large table to a keyed lookup when some keys are very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import cut_lineage, input_bytes

HOT_ROWS = 1_000_000
SMALL_ROWS = 1_000_000
SPLIT_BYTES = 16 * 1024 ** 3


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The frame, written once, and marked for a broadcast join if it is counted to be small.

    Beyond the bound the join shuffles; the result is the same.
    """
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df


def spread_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Equi-join that splits each key with more than ``hot_rows`` rows.

    Inputs under ``split_bytes`` cannot hold a key too large for adaptive skew
    handling and use a plain join. Above it, hot keys are counted and only they
    are salted: their rows in ``big`` spread over ``rows / hot_rows`` salts and
    their ``lookup`` rows are repeated that often. There are at most
    ``|big| / hot_rows`` hot keys.
    """
    on = list(on)
    size = input_bytes(big)
    if size is not None and size < split_bytes:
        return big.join(lookup, on, how)
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > hot_rows).select(
        *on, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    rest = [F.col(c) for c in big.columns if c not in on] or [F.lit(0)]
    salted = big.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*rest), F.col("_salts")).cast("int"))).drop("_salts")
    copies = lookup.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
