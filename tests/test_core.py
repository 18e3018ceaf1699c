"""Ordering, skewed joins, block scoring, scalar expressions."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import scalar as V
from edgeloom.operators import blocks
from edgeloom.operators.graph import meta_path, sparse_product
from edgeloom.operators.scoring import _sides, norm_pruning, pair_groups, top_pairs
from edgeloom.operators.ordering import average_rank, dense_number, running_totals
from edgeloom.operators.skew import spread_join


def test_parse_date(spark):
    cases = {"2020-03-15": "2020-03-15", "2020-3-5": "2020-03-05", "2020-07": "2020-07-01", "2020": "2020-01-01",
             "2020-03-15T10:00": "2020-03-15", "Mar 2020": "1900-01-01", "n.d.": "1900-01-01", None: "1900-01-01",
             "2020-13-40": "2020-01-01", "20201": "2020-01-01", "0000": "1900-01-01", "2020-01-5 x": "2020-01-01"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", V.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_cosine_decay():
    assert V.cosine_decay(0, 100) == 1.0
    assert abs(V.cosine_decay(50, 100) - 0.5) < 1e-12
    assert abs(V.cosine_decay(100, 100)) < 1e-12 and V.cosine_decay(0, 0) == 1.0 and abs(V.cosine_decay(3, 0)) < 1e-12
    values = [V.cosine_decay(i, 20) for i in range(21)]
    assert values == sorted(values, reverse=True)


def test_running_totals_with_one_hot_group(spark):
    df = spark.range(600).select(F.when(F.col("id") < 400, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id", (F.col("id") % 5).alias("v"))
    got = {(r.g, r.id): r.s for r in running_totals(df, ["g"], [F.col("id")], {"s": F.col("v")}).collect()}
    totals = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        totals[r.g] = totals.get(r.g, 0) + r.v
        assert got[(r.g, r.id)] == totals[r.g]


def test_dense_number_is_consecutive(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", 7)], "k string, v long")
    out = {(r.k, r.v): r.idx for r in dense_number(df, ["k"], [F.col("v")]).collect()}
    assert [out[("a", i * 3)] for i in range(50)] == list(range(50)) and out[("b", 7)] == 0


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert sorted(r.r for r in average_rank(df, "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_spread_join_salts_hot_keys(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    small = spark.range(35).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        plain = big.join(small, "k", how)
        salted = spread_join(big, small, ["k"], how, hot_rows=50, split_bytes=0)
        key = lambda r: (r.id, r.k, r.w if r.w is not None else -1)
        assert sorted(map(key, salted.collect())) == sorted(map(key, plain.collect()))


def brute(q, items):
    return np.round(q @ items.T, blocks.SCORE_DIGITS)


def test_blocks_match_brute_force(spark):
    rng = np.random.default_rng(1)
    q, items = rng.normal(size=(37, 8)), rng.normal(size=(53, 8))
    queries = spark.createDataFrame([("g", i, q[i].tolist(), 0.5) for i in range(37)],
                                    "grp string, qid long, qvec array<double>, threshold double")
    things = spark.createDataFrame([("g", i, items[i].tolist()) for i in range(53)],
                                   "grp string, iid long, ivec array<double>")
    known = spark.createDataFrame([("g", "g", i, i) for i in range(37)], "grp string, view string, qid long, iid long")
    scores = brute(q, items)
    fold, schema = blocks.count_above()
    got = blocks.score_blocks(queries, things, fold, schema, block=10).groupBy("qid").agg(F.sum("above").alias("n"))
    assert {r.qid: r.n for r in got.collect()} == {i: int((scores[i] > 0.5).sum()) for i in range(37)}
    masked = scores.copy()
    masked[np.arange(37), np.arange(37)] = -np.inf
    fold, schema = blocks.keep_top(5)
    rows = blocks.score_blocks(queries, things, fold, schema, known=known, block=10).orderBy(
        F.col("score").desc(), "qid", "iid").limit(5).collect()
    best = np.argsort(-masked.ravel())[:5]
    assert [(r.qid, r.iid) for r in rows] == [(b // 53, b % 53) for b in best]


def test_blocks_distance(spark):
    rng = np.random.default_rng(2)
    q, items = rng.normal(size=(5, 4)), rng.normal(size=(9, 4))
    queries = spark.createDataFrame([("g", i, q[i].tolist()) for i in range(5)], "grp string, qid long, qvec array<double>")
    things = spark.createDataFrame([("g", i, items[i].tolist()) for i in range(9)], "grp string, iid long, ivec array<double>")
    fold, schema = blocks.keep_top_per_query(9)
    got = {(r.qid, r.iid): r.score for r in blocks.score_blocks(queries, things, fold, schema, metric="l2", block=3).collect()}
    for i in range(5):
        for j in range(9):
            assert abs(got[(i, j)] + np.linalg.norm(q[i] - items[j])) < 1e-7


def test_tiles_decide_as_double_precision_does():
    rng = np.random.default_rng(3)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for metric in ("dot", "l2"):
        for scale in (1.0, 1e-12, 1e5, 1e20):
            q = rng.normal(size=(600, 6)) * scale
            # Copies tie, and some items are a few units of double precision apart.
            items = np.vstack([rng.normal(size=(4200, 6)) * scale, q[:300], q[:300], q[:300] * (1 + 1e-15)])
            i, j = np.divmod(np.arange(len(q) * len(items)), len(items))
            brute_scores = blocks._exact(q, items, metric, i, j).reshape(len(q), len(items))
            least = brute_scores[np.arange(600), rng.integers(0, len(items), 600)]
            pairs = rng.integers(0, 600, 900), rng.integers(0, len(items), 900)
            for skip in (nothing, pairs):
                open_scores = brute_scores.copy()
                open_scores[skip] = -np.inf
                cell = blocks.Cell("g", np.arange(600), q, least, np.arange(len(items)) * 3, items, metric, skip)
                assert (blocks.count_above()[0](cell)["above"] == (open_scores > least[:, None]).sum(axis=1)).all()
                best = np.argsort(-open_scores, axis=1, kind="stable")[:, :4]
                got = blocks.keep_top_per_query(4)[0](cell)
                assert (got["iid"].reshape(-1, 4) == 3 * best).all() and (got["score"].reshape(-1, 4) == np.take_along_axis(open_scores, best, 1)).all()
                best = np.argsort(-open_scores.ravel(), kind="stable")[:50]
                got = blocks.keep_top(50)[0](cell)
                assert (got["qid"] == best // len(items)).all() and (got["iid"] == 3 * (best % len(items))).all()


def test_memory_of_a_cell_is_that_of_its_tiles():
    rng = np.random.default_rng(4)
    q, items = rng.normal(size=(4096, 8)), rng.normal(size=(8192, 8))
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = blocks.Cell("g", np.arange(4096), q, np.full(4096, 3.0), np.arange(8192), items, "dot", nothing)
    for fold in (blocks.keep_top(2000), blocks.keep_top_per_query(5), blocks.count_above(), blocks.summarise()):
        tracemalloc.start()
        fold[0](cell)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # The scores of the cell are 268 MB.
        assert peak < 80e6


def test_memory_of_tied_scores_is_that_of_a_lot():
    # All pairs score the same: each of a tile's two million pairs could be among the best.
    q, items = np.full((512, 16), 0.25), np.full((4096, 16), 0.25)
    skip = np.array([0, 0, 1]), np.array([0, 2, 1])
    for metric in ("dot", "l2"):
        score = 1.0 if metric == "dot" else 0.0
        cell = blocks.Cell("g", np.arange(512), q, np.full(512, score), np.arange(4096), items, metric, skip)
        found = []
        for fold in (blocks.keep_top(2000), blocks.keep_top_per_query(5), blocks.count_above()):
            tracemalloc.start()
            found.append(fold[0](cell))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 70e6
        assert [(i, j) for i, j in zip(found[0]["qid"], found[0]["iid"])] == [(0, j) for j in range(2002) if j not in (0, 2)]
        first = found[1]["iid"].reshape(-1, 5)
        assert first[0].tolist() == [1, 3, 4, 5, 6] and first[1].tolist() == [0, 2, 3, 4, 5] and (first[2:] == np.arange(5)).all()
        assert (found[1]["score"] == score).all() and (found[2]["above"] == 0).all()


def test_vectors_are_read_without_copies():
    rows = pa.array([[1.0, 2.0], None, [3.0, 4.0]], pa.list_(pa.float64()))
    got = blocks._matrix(pa.chunked_array([rows]))
    assert got.tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert blocks._matrix(pa.chunked_array([rows, rows])).tolist() == 2 * [[1.0, 2.0], [3.0, 4.0]]
    whole = rows.drop_null()
    assert np.shares_memory(blocks._matrix(pa.chunked_array([whole])), whole.values.to_numpy())


def test_few_copies_of_large_sides(spark):
    # 40,000 rows meet in blocks of 16,384, not of 2,048: each row is sent to few cells.
    assert blocks._block_counts(spark.range(40_000).withColumn("grp", F.lit("g")), "grp", blocks.BLOCK, 1) == {"g": 3}


def test_layer_norm_and_scale(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(
        V.layer_norm(F.col("v")).alias("n"), V.scale(F.col("v"), F.lit(2.0)).alias("s")).first()
    x = np.array([1.0, 2, 3, 4])
    assert np.allclose(row.n, (x - x.mean()) / np.sqrt(x.var() + 1e-5)) and row.s == [2.0, 4.0, 6.0, 8.0]


def test_best_rows_are_merged_without_a_window(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 3}", int(i), int(i * 7 % 11), float(s)) for i, s in enumerate(rng.integers(0, 40, 3000))]
    cells = spark.createDataFrame(rows, "grp string, qid long, iid long, score double").repartition(9)
    merged = blocks.merge_best(cells, 50)
    assert "Window" not in merged._jdf.queryExecution().toString()
    got = {(r.grp, r["rank"]): (r.qid, r.iid) for r in merged.collect()}
    for g in ("g0", "g1", "g2"):
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2]))[:50]
        assert [got[g, i + 1] for i in range(50)] == [(r[1], r[2]) for r in best]


def test_owned_tables_are_deleted(spark):
    import os

    from edgeloom.session import cut_lineage, owned_tables, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with owned_tables(spark):
        kept = cut_lineage(spark.range(5))
        with owned_tables(spark):
            assert cut_lineage(kept).count() == 5
        assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


@pytest.mark.parametrize("spread, k", [(1.5, 40), (0.0, 40), (1.5, 100_000)])
def test_top_pairs_with_norm_bounds(spark, spread, k):
    """The same rows as all scores sorted, with most cells skipped where norms differ; negative scores and known pairs too."""
    rng = np.random.default_rng(10)

    def side(kind, n):
        return [(kind, i, (v / np.linalg.norm(v) * np.exp(spread * rng.normal())).tolist()) for i, v in enumerate(rng.normal(size=(n, 6)))]

    rows = side("Gene", 400) + side("Disease", 230)
    vectors = spark.createDataFrame(rows, "node_type string, idx long, vec array<double>")
    types = [("Gene", "A", "Disease"), ("Gene", "B", "Disease")]
    matrices = {kind: np.array([r[2] for r in rows if r[0] == kind]) for kind in ("Gene", "Disease")}
    scores = np.round(matrices["Gene"] @ matrices["Disease"].T, 8)
    best = np.dstack(np.unravel_index(np.argsort(-scores, axis=None)[:30], scores.shape))[0]
    known = spark.createDataFrame([("Gene", "A", "Disease", int(i), int(j)) for i, j in best] + [("Gene", "A", "Disease", 10 ** 6, 1)],
                                  "src_type string, rel string, dst_type string, src long, dst long")
    got = {rel: [(r.src, r.dst, r.score) for r in part] for rel in "AB" if (part := top_pairs(vectors, types, known, k, block=16).where(F.col("rel") == rel).orderBy("rank").collect())}
    hidden = {(int(i), int(j)) for i, j in best}
    for rel in "AB":
        every = sorted(((-scores[i, j], i, j) for i in range(400) for j in range(230) if rel == "B" or (i, j) not in hidden))[:k]
        assert [(i, j) for i, j, _ in got[rel]] == [(i, j) for _, i, j in every]
        assert np.allclose([s for _, _, s in got[rel]], [-s for s, _, _ in every], atol=1e-8)
    queries, items = _sides(vectors, types)
    pruning = norm_pruning(queries, items, None, pair_groups(types), k, 16)
    assert (pruning is None) == (spread == 0.0)
    if pruning is not None:
        every, skipped = pruning.cells(16)
        assert every > 300 and (skipped > every / 2 if k == 40 else skipped == 0)


def test_sparse_product_cuts_hubs(spark):
    """A node with many ends on both sides, beside light ones: the same counts, no task with all of its pairs."""
    rng = np.random.default_rng(3)
    left = [(i, 0, int(rng.integers(1, 4))) for i in range(300)] + [(int(a), int(b), 1) for a, b in rng.integers(1, 40, (200, 2))]
    right = [(0, i, int(rng.integers(1, 4))) for i in range(250)] + [(int(a), int(b), 2) for a, b in rng.integers(1, 40, (200, 2))]
    ldf, rdf = spark.createDataFrame(left, "a long, b long, n long"), spark.createDataFrame(right, "b long, c long, m long")
    got = {(r.a, r.c): r.n for r in sparse_product(ldf, rdf, heavy=1000, side=40).collect()}
    want = {}
    for a, b, n in left:
        for b2, c, m in right:
            if b == b2:
                want[a, c] = want.get((a, c), 0) + n * m
    assert got == want
    assert sparse_product(ldf.limit(0), rdf).count() == 0


def test_meta_path_over_a_star(spark):
    """10^5 edges into one middle node."""
    edges = spark.range(100_000).select(F.lit("G").alias("src_type"), F.lit("R").alias("rel"), F.lit("M").alias("dst_type"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    out = spark.createDataFrame([("M", "S", "D", 0, 5), ("M", "S", "D", 0, 6)], "src_type string, rel string, dst_type string, src long, dst long")
    paths = meta_path(edges.unionByName(out), [("G", "R", "M"), ("M", "S", "D")])
    assert paths.agg(F.count("*"), F.sum("n_paths")).first()[:] == (200_000, 200_000)


def test_handed_on_and_discarded_tables(spark):
    from pyspark.sql import functions as F

    from edgeloom.session import cut_lineage, discard, handed_on, owned_tables, tables_of

    with owned_tables(spark):
        with owned_tables(spark):
            inner = cut_lineage(spark.range(5))
            spent = cut_lineage(spark.range(3))
            discard(spent)
            assert not any(Path(f.removeprefix("file:")).exists() for f in tables_of(spent))
            result = handed_on(inner.select((F.col("id") * 2).alias("id")))
        folders = [Path(f.removeprefix("file:")) for f in (*tables_of(inner), *tables_of(result))]
        assert [f.exists() for f in folders] == [False, True]
        assert sorted(r.id for r in result.collect()) == [0, 2, 4, 6, 8]
    assert not folders[1].exists()
