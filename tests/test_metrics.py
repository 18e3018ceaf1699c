"""Metrics against literal expectations and brute force."""

import numpy as np
from pyspark.sql import functions as F

from edgeloom.operators import kge as K
from edgeloom.operators import metrics as M


def scores(spark, pos, neg):
    rows = [(float(p), 1) for p in pos] + [(float(n), 0) for n in neg]
    return spark.createDataFrame(rows, "score double, is_pos int")


def test_auroc(spark):
    def value(pos, neg, **kw):
        return M.auroc(M.pooled_ranks(scores(spark, pos, neg)), **kw).first().auroc

    assert value([10, 9, 8], [-1, -2, -3]) == 1.0
    assert value([], [1, 2]) == 0.5 and value([1], []) == 0.5
    assert value([1], [1]) == 0.0 and value([1], [1], ties="half") == 0.5


def test_mrr_and_hits(spark):
    assert abs(M.mrr(M.pooled_ranks(scores(spark, [5], [10, 8, 3, 1]))).first().mrr - 1 / 3) < 1e-12
    assert M.mrr(M.pooled_ranks(scores(spark, [], [1, 2]))).first().mrr == 0.0
    assert M.hits_at(M.pooled_ranks(scores(spark, [0], [1, 2, 3])), [1]).first().hits_1 == 0.0


def one_hot(spark):
    rows = [("Gene", i, [1.0 if j == i else 0.0 for j in range(16)]) for i in range(10)]
    rows += [("Disease", i, [1.0 if j == i else 0.0 for j in range(16)]) for i in range(5)]
    return spark.createDataFrame(rows, "node_type string, idx long, vec array<double>")


def test_filtered_ranks_one_hot(spark):
    pair = spark.createDataFrame([("Gene", "A", "Disease", 0, 0)], "src_type string, rel string, dst_type string, src long, dst long")
    ranks = M.filtered_ranks(pair, pair, one_hot(spark)).collect()
    assert len(ranks) == 1 and ranks[0].tail_rank == 1 and ranks[0].head_rank == 1


def test_filtered_ranks_brute_force(spark):
    rng = np.random.default_rng(3)
    genes, diseases = rng.normal(size=(20, 6)), rng.normal(size=(15, 6))
    vectors = spark.createDataFrame(
        [("Gene", i, v.tolist()) for i, v in enumerate(genes)] + [("Disease", i, v.tolist()) for i, v in enumerate(diseases)],
        "node_type string, idx long, vec array<double>")
    # Gene 0 holds a third of all known pairs.
    true = {(0, t) for t in range(12)} | {(int(h), int(t)) for h, t in rng.integers(0, [20, 15], size=(24, 2))}
    pairs = spark.createDataFrame([("Gene", "A", "Disease", h, t) for h, t in true],
                                  "src_type string, rel string, dst_type string, src long, dst long")
    got = {(r.src, r.dst): (r.tail_rank, r.head_rank) for r in M.filtered_ranks(pairs, pairs, vectors, block=7).collect()}
    s = genes @ diseases.T
    for h, t in true:
        tail = 1 + sum(s[h, x] > s[h, t] for x in range(15) if (h, x) not in true)
        head = 1 + sum(s[x, t] > s[h, t] for x in range(20) if (x, t) not in true)
        assert got[(h, t)] == (tail, head)


def test_embedding_scorers_agree_in_both_directions(spark):
    rng = np.random.default_rng(4)
    h, t, r = rng.normal(size=8), rng.normal(size=8), rng.normal(size=8)
    for name, scorer in K.SCORERS.items():
        rel = r[:4] if name == "rotate" else r
        row = spark.createDataFrame([(h.tolist(), rel.tolist(), t.tolist())], "h array<double>, r array<double>, t array<double>")
        from edgeloom.functions import scalar as V
        head_query = scorer.head_query(F.col("t"), F.col("r"))
        back = V.dot(head_query, F.col("h")) if scorer.metric == "dot" else -V.norm(V.subtract(head_query, F.col("h")))
        out = row.select(scorer.score(F.col("h"), F.col("r"), F.col("t")).alias("a"), back.alias("b")).first()
        assert abs(out.a - out.b) < 1e-9, name
        score, gh, gr, gt = K._gradients(name, h[None], rel[None], t[None])
        assert abs(score[0] - out.a) < 1e-6
        for vec, grad in ((h, gh), (rel, gr), (t, gt)):  # finite differences
            i, eps = 1, 1e-6
            vec[i] += eps
            up = K._gradients(name, h[None], rel[None], t[None])[0][0]
            vec[i] -= 2 * eps
            down = K._gradients(name, h[None], rel[None], t[None])[0][0]
            vec[i] += eps
            assert abs((up - down) / (2 * eps) - grad[0, i]) < 1e-4, name


def test_training_lowers_loss(spark):
    triples = spark.createDataFrame([(i, 0, (i + 1) % 12) for i in range(12)], "h long, r long, t long")
    ids = spark.range(12)
    for model in ("transe", "complex"):
        _, _, history = K.fit(triples, ids, spark.range(1), model, dim=8, epochs=4, lr=0.1)
        assert history[-1] < history[0], (model, history)


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 9.0), (2.0, 7.0), (3.0, 1.0)], "a double, b double")
    assert abs(M.spearman(df, "a", "b").first().rho + 1.0) < 1e-12


def test_hits_per_row(spark):
    pos = spark.createDataFrame([(1, 5.0), (2, 1.0)], "item long, score double")
    neg = spark.createDataFrame([(1, 4.0), (1, 3.0), (2, 4.0), (2, 3.0)], "item long, neg_score double")
    assert M.hits_per_row(pos, neg, [1]).first().hits_1 == 0.5


def test_baseline_plan(spark):
    from edgeloom.plans.baselines import run_baselines

    triples = spark.createDataFrame([(i, i % 2, (i + 1) % 10) for i in range(10)], "h long, r long, t long")
    out = run_baselines(triples.where("h < 8"), triples.where("h >= 8"), triples, spark.range(10), spark.range(2),
                        ["distmult"], dim=4, epochs=1)
    rows = {r.relation: r for r in out.collect()}
    assert rows["ALL"].n_triples == 2 and rows["ALL"].model == "distmult" and 0 < rows["ALL"].mrr <= 1


def test_filtered_ranks_in_turns(spark, monkeypatch):
    """The same ranks whether rows meet the candidates at once or in turns; only the result's table is left."""
    from pathlib import Path

    from edgeloom.session import shared_dir

    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(kind, i, rng.normal(size=4).tolist()) for kind in ("Gene", "Disease") for i in range(15)],
                                    "node_type string, idx long, vec array<double>")
    pairs = spark.createDataFrame([("Gene", "R", "Disease", i % 15, (i * 4) % 15) for i in range(30)],
                                  "src_type string, rel string, dst_type string, src long, dst long")

    def ranks():
        return sorted((r.src, r.dst, r.tail_rank, r.head_rank) for r in M.filtered_ranks(pairs, pairs, vectors).collect())

    whole, seen = ranks(), []
    monkeypatch.setattr(M, "TURN_COPIES", 20)
    monkeypatch.setattr(M.blocks, "score_blocks", lambda *a, f=M.blocks.score_blocks, **k: seen.append(1) or f(*a, **k))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert ranks() == whole and len(whole) > 1 and len(seen) > 2
    assert len(set(folder.iterdir()) - before) == 1


def test_filtered_ranks_of_ids_above_32_bits(spark):
    rng = np.random.default_rng(8)
    ids = [1, 2, (1 << 32) + 1, (1 << 40) + 5, 9, (1 << 32) + 9]
    vecs = {i: rng.normal(size=4) for i in ids}
    vectors = spark.createDataFrame([(k, i, v.tolist()) for k in ("Gene", "Disease") for i, v in vecs.items()],
                                    "node_type string, idx long, vec array<double>")
    true = {(1, 9), (1, (1 << 32) + 9), ((1 << 32) + 1, 9), ((1 << 40) + 5, 2)}
    pairs = spark.createDataFrame([("Gene", "A", "Disease", h, t) for h, t in true], "src_type string, rel string, dst_type string, src long, dst long")
    rows = M.filtered_ranks(pairs, pairs, vectors, block=2).collect()
    score = {(h, t): vecs[h] @ vecs[t] for h in ids for t in ids}
    assert {(r.src, r.dst): (r.tail_rank, r.head_rank) for r in rows} == {
        (h, t): (1 + sum(score[h, x] > score[h, t] for x in ids if (h, x) not in true),
                 1 + sum(score[x, t] > score[h, t] for x in ids if (x, t) not in true)) for h, t in true}
    triples = spark.createDataFrame([(h, 0, t) for h, t in true], "h long, r long, t long")
    entities = spark.createDataFrame([(i, v.tolist()) for i, v in vecs.items()], "id long, vec array<double>")
    relation = spark.createDataFrame([(0, [1.0] * 4)], "id long, vec array<double>")
    rows = K.filtered_ranks(triples, triples, entities, relation, "distmult", block=2).collect()
    assert {(r.h, r.t): r.tail_rank for r in rows} == {
        (h, t): 1 + sum(score[h, x] > score[h, t] for x in ids if (h, x) not in true) for h, t in true}


def test_true_triples_never_outrank_themselves(spark):
    rng = np.random.default_rng(9)
    for size, gap in ((200.0, 1e-5), (2.0, 1e-10)):
        heads = rng.normal(size=(20, 8)) * size
        tails = heads + 1.0 + rng.normal(size=(20, 8)) * gap
        rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([heads, tails]))]
        entities = spark.createDataFrame(rows, "id long, vec array<double>")
        relation = spark.createDataFrame([(0, [1.0] * 8)], "id long, vec array<double>")
        triples = spark.createDataFrame([(i, 0, 20 + i) for i in range(20)], "h long, r long, t long")
        ranks = K.filtered_ranks(triples, triples, entities, relation, "transe").collect()
        assert {(r.tail_rank, r.head_rank) for r in ranks} == {(1, 1)}
