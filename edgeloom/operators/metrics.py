"""Link-prediction metrics: pooled and filtered ranks, AUROC, losses, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scalar import dot
from edgeloom.operators import blocks
from edgeloom.operators.graph import EDGE_TYPE
from edgeloom.operators.ordering import average_rank, running_totals
from edgeloom.operators.scoring import score_edges
from edgeloom.session import cut_lineage, handed_on, owned_tables, release_shuffles

SCORED_PAIR = [*EDGE_TYPE, "src", "dst"]
#: Copies of vectors that are shuffled at a time.
TURN_COPIES = 4_000_000


def pooled_ranks(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives, negatives, negatives below and above.

    Counting by score first keeps the work linear in distinct scores instead of
    comparing every positive to every negative.
    """
    keys = list(keys)
    counts = scores.groupBy(*keys, "score").agg(
        F.count(F.when(F.col("is_pos") == 1, 1)).alias("p"),
        F.count(F.when(F.col("is_pos") == 0, 1)).alias("n"))
    up = running_totals(counts, keys, [F.col("score")], {"n_upto": F.col("n")})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("p").alias("p_all"))
    if keys:
        joined = up.join(totals, keys)
    else:
        both = totals.first()
        joined = up.withColumn("n_all", F.lit(both.n_all).cast("bigint")).withColumn(
            "p_all", F.lit(both.p_all).cast("bigint"))
    return joined.select(*keys, "score", "p", "n", "p_all", "n_all",
                         (F.col("n_upto") - F.col("n")).alias("n_below"),
                         (F.col("n_all") - F.col("n_upto")).alias("n_above"))


def auroc(ranks: DataFrame, keys: Sequence[str] = (), ties: str = "zero") -> DataFrame:
    """Share of (positive, negative) pairs ordered correctly; ties count zero or half."""
    wins = F.col("n_below") + (F.col("n") / 2.0 if ties == "half" else F.lit(0))
    return ranks.groupBy(*keys).agg(F.coalesce(F.try_divide(
        F.sum(F.col("p") * wins).cast("double"), F.max("p_all") * F.max("n_all")), F.lit(0.5)).alias("auroc"))


def mrr(ranks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean reciprocal rank of positives among all negatives (ties do not count against)."""
    return ranks.groupBy(*keys).agg(F.coalesce(F.try_divide(
        F.sum(F.col("p") / (F.col("n_above") + 1)), F.max("p_all")), F.lit(0.0)).alias("mrr"))


def hits_at(ranks: DataFrame, ks: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    return ranks.groupBy(*keys).agg(*[F.coalesce(F.try_divide(
        F.sum(F.when(F.col("n_above") + 1 <= k, F.col("p")).otherwise(0)).cast("double"), F.max("p_all")),
        F.lit(0.0)).alias(f"hits_{k}") for k in ks])


def hits_per_row(pos: DataFrame, neg: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Hits@k when every positive ``(item, score)`` has its own negatives ``(item, neg_score)``."""
    ranked = pos.join(neg, "item", "left").groupBy("item").agg(
        (F.count(F.when(F.col("neg_score") > F.col("score"), 1)) + 1).alias("rank"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in ks])


def counts_above(rows: DataFrame, items: DataFrame, metric: str, block: int) -> DataFrame:
    """``(grp, qid, above_all)``: how many items of its group score above each row's threshold."""
    fold, schema = blocks.count_above()
    n_rows, n_items = rows.select("grp", "qid").count(), items.count()
    turns = max(1, -(-(n_rows * -(-n_items // block) + n_items * -(-n_rows // block)) // TURN_COPIES))
    parts = []
    for turn in range(turns):
        own = rows if turns == 1 else rows.where(F.pmod(F.xxhash64("grp", "qid"), F.lit(turns)) == turn)
        part = blocks.score_blocks(own, items, fold, schema, metric=metric, block=block).groupBy("grp", "qid").agg(F.sum("above").alias("above_all"))
        if turns == 1:
            return part
        parts.append(cut_lineage(part))
        del part
        release_shuffles(rows.sparkSession)
    above = parts[0]
    for part in parts[1:]:
        above = above.unionByName(part)
    return above


def rank_among(eval_rows: DataFrame, items: DataFrame, known: DataFrame, keys: Sequence[str],
               metric: str = "dot", block: int = blocks.BLOCK) -> DataFrame:
    """1 + items scoring above the threshold that are not known for the row's keys.

    ``eval_rows(grp, qid, qvec, threshold, *keys)`` with a ``qid`` of its own for each
    row; ``known(*keys, kid, score)``. The
    total over all items comes from block counts. Known ones are subtracted by a
    running count in score order, so a frequent key costs no pair blow-up. Rows meet the items in turns,
    so that the copies of one turn are on disk at once.
    """
    distinct = eval_rows.dropDuplicates(["grp", "qid"]).select("grp", "qid", "qvec", "threshold")
    above = counts_above(distinct, items, metric, block)
    marks = eval_rows.select(*keys, F.col("threshold").alias("s"), F.lit(0).alias("is_known"), "grp", "qid")
    marks = marks.unionByName(known.select(
        *keys, F.col("score").alias("s"), F.lit(1).alias("is_known"), F.lit(None).cast("string").alias("grp"),
        F.col("kid").alias("qid")))
    counted = running_totals(marks, keys, [F.col("s").desc(), F.col("is_known"), F.col("qid")],
                             {"above_known": F.col("is_known").cast("bigint")}).where("is_known = 0")
    return counted.join(above, ["grp", "qid"]).select(
        *keys, "grp", "qid", (F.col("above_all") - F.col("above_known") + 1).alias("rank"))


def filtered_ranks(eval_pairs: DataFrame, true_pairs: DataFrame, vectors: DataFrame,
                   block: int = blocks.BLOCK) -> DataFrame:
    """Head and tail rank of each eval pair among typed candidates, other true pairs removed."""
    def scored(pairs: DataFrame) -> DataFrame:
        # Written once: both directions and all their steps read it.
        # The row number is settled by the write and stands for the pair, whatever its ids.
        return cut_lineage(score_edges(pairs.select(*SCORED_PAIR).distinct(), vectors).select(
            *SCORED_PAIR, F.round("score", blocks.SCORE_DIGITS).alias("score"), F.monotonically_increasing_id().alias("qid")))

    spark = vectors.sparkSession
    with owned_tables(spark):
        known = scored(true_pairs)
        rows = known if eval_pairs is true_pairs else scored(eval_pairs)
        out = rows.select(*SCORED_PAIR, "qid")
        pair_type = F.concat_ws("__", "src_type", "dst_type")
        for side, own, other in (("tail", "src", "dst"), ("head", "dst", "src")):
            keys = [*EDGE_TYPE, own]
            own_vecs = vectors.select(F.col("node_type").alias(f"{own}_type"), F.col("idx").alias(own),
                                      F.col("vec").alias("qvec"))
            queries = rows.join(own_vecs, [f"{own}_type", own]).select(
                pair_type.alias("grp"), "qid", "qvec",
                F.col("score").alias("threshold"), *keys)
            pairs = rows.select(F.col(f"{other}_type").alias("node_type"), pair_type.alias("grp")).distinct()
            items = vectors.join(pairs, "node_type").select("grp", F.col("idx").alias("iid"), F.col("vec").alias("ivec"))
            with owned_tables(spark):
                ranks = rank_among(queries, items, known.withColumn("kid", F.col(other)), keys, block=block)
                ranks = handed_on(ranks.select("qid", F.col("rank").alias(f"{side}_rank")))
            release_shuffles(spark)
            out = out.join(ranks, "qid")
        return handed_on(out.drop("qid"))


def filtered_report(ranks: DataFrame, by: str = "relation") -> DataFrame:
    """MRR and Hits@1/3/10 per relation and over all triples, rounded to 4."""
    def both(expr) -> Column:
        return F.round((F.avg(expr(F.col("tail_rank"))) + F.avg(expr(F.col("head_rank")))) / 2, 4)

    def reciprocal(rank: Column) -> Column:
        return F.lit(1.0) / rank

    return ranks.rollup(by).agg(
        F.count(F.lit(1)).alias("n_triples"),
        F.round(F.avg(reciprocal(F.col("tail_rank"))), 4).alias("tail_mrr"),
        F.round(F.avg(reciprocal(F.col("head_rank"))), 4).alias("head_mrr"),
        both(reciprocal).alias("mrr"),
        *[both(lambda r, k=k: (r <= k).cast("double")).alias(f"hits_{k}") for k in (1, 3, 10)],
        F.grouping(by).alias("_all")).select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by)).alias(by), "n_triples", "tail_mrr",
        "head_mrr", "mrr", "hits_1", "hits_3", "hits_10")


def seed_summary(runs: DataFrame, metrics: Sequence[str], best_by: str) -> DataFrame:
    """Mean and sample deviation per metric over seeds, and the best seed."""
    return runs.agg(
        F.count(F.lit(1)).alias("n_seeds"), F.max_by("seed", best_by).alias("best_seed"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def bce_loss(logit: Column, label: Column) -> Column:
    """Numerically stable binary cross-entropy of one row."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def margin_loss(pos: Column, neg: Column, margin: float) -> Column:
    return F.greatest(F.lit(0.0), neg - pos + F.lit(margin))


def spearman(df: DataFrame, a: str, b: str, name: str = "rho") -> DataFrame:
    ranked = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias(name), F.count(F.lit(1)).alias("n"))


__all__ = ["auroc", "bce_loss", "dot", "filtered_ranks", "filtered_report", "hits_at", "hits_per_row",
           "margin_loss", "mrr", "pooled_ranks", "rank_among", "seed_summary", "spearman"]
