"""Knowledge-graph-embedding scorers, filtered evaluation and training epochs.

Every scorer turns (known end, relation) into a query vector; a candidate is
then scored by an inner product or a negative distance to that vector. One form
serves single triples, all-candidate scoring and both prediction directions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions import scalar as V
from edgeloom.operators import blocks
from edgeloom.operators.lowrank import matrix, sum_rows
from edgeloom.operators.metrics import rank_among
from edgeloom.operators.skew import spread_join
from edgeloom.session import cut_lineage, drop_tables, parallelism, release_shuffles, side_table


def _halves(vec: Column) -> tuple[Column, Column]:
    half = (F.size(vec) / 2).cast("int")
    return F.slice(vec, F.lit(1), half), F.slice(vec, half + 1, half)


def _complex(a: Column, b: Column, conjugate: bool) -> Column:
    """Complex product a*b, or a*conj(b), of [re, im] vectors."""
    ar, ai = _halves(a)
    br, bi = _halves(b)
    sign = -1.0 if conjugate else 1.0
    re = V.subtract(V.multiply(ar, br), V.scale(V.multiply(ai, bi), F.lit(sign)))
    im = V.add(V.scale(V.multiply(ar, bi), F.lit(sign)), V.multiply(ai, br))
    return F.concat(re, im)


def _unit(phase: Column) -> Column:
    return F.concat(F.transform(phase, lambda x: F.cos(x)), F.transform(phase, lambda x: F.sin(x)))


@dataclass(frozen=True)
class Scorer:
    """Query vectors for tail and head prediction, and how candidates compare to them."""

    tail_query: Callable[[Column, Column], Column]
    head_query: Callable[[Column, Column], Column]
    metric: str
    loss: str
    margin: float = 1.0

    def score(self, h: Column, r: Column, t: Column) -> Column:
        query = self.tail_query(h, r)
        return V.dot(query, t) if self.metric == "dot" else -V.norm(V.subtract(query, t))


SCORERS = {
    "transe": Scorer(V.add, V.subtract, "l2", "margin", 1.0),
    "distmult": Scorer(V.multiply, V.multiply, "dot", "bce"),
    "complex": Scorer(lambda h, r: _complex(h, r, False), lambda t, r: _complex(t, r, True), "dot", "bce"),
    "rotate": Scorer(lambda h, p: _complex(h, _unit(p), False), lambda t, p: _complex(t, _unit(p), True),
                     "l2", "margin", 6.0),
}


def to_triples(edges: DataFrame, entity_ids: DataFrame, relation_ids: DataFrame) -> DataFrame:
    """Global (h, r, t) triples; edges with an unmapped end or relation are left out."""
    def side(end: str, out: str) -> DataFrame:
        return entity_ids.select(F.col("node_type").alias(f"{end}_type"), F.col("idx").alias(end),
                                 F.col("global_id").alias(out))

    mapped = spread_join(edges, side("src", "h"), ["src_type", "src"])
    mapped = spread_join(mapped, side("dst", "t"), ["dst_type", "dst"])
    rels = relation_ids.select("src_type", "rel", "dst_type", F.col("relation_id").alias("r"))
    return mapped.join(rels, ["src_type", "rel", "dst_type"]).select("h", "r", "t")


def with_vectors(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds hv, rv, tv from ``entities(id, vec)`` and ``relations(id, vec)``."""
    out = spread_join(triples, entities.select(F.col("id").alias("h"), F.col("vec").alias("hv")), ["h"])
    out = spread_join(out, entities.select(F.col("id").alias("t"), F.col("vec").alias("tv")), ["t"])
    # One relation vector per edge type: a short, closed list.
    return out.join(relations.select(F.col("id").alias("r"), F.col("vec").alias("rv")), "r")


def score_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, model: str) -> DataFrame:
    full = with_vectors(triples, entities, relations)
    score = SCORERS[model].score(F.col("hv"), F.col("rv"), F.col("tv"))
    return full.select("h", "r", "t", score.alias("score"))


def normalise(entities: DataFrame) -> DataFrame:
    """Unit-length entity vectors, as at initialisation of the translation model."""
    return entities.withColumn("vec", V.scale(F.col("vec"), F.lit(1.0) / F.greatest(
        V.norm(F.col("vec")), F.lit(1e-12))))


def score_candidates(questions: DataFrame, entities: DataFrame, relations: DataFrame, model: str,
                     side: str, k: int, block: int = blocks.BLOCK) -> DataFrame:
    """Best k entities for each distinct question ``(known, r)``; ``side`` is the open end."""
    scorer = SCORERS[model]
    make = scorer.tail_query if side == "tail" else scorer.head_query
    # The number is settled by the write and stands for the question, whatever its ids.
    asked = cut_lineage(questions.select("known", "r").distinct().withColumn("qid", F.monotonically_increasing_id()))
    full = spread_join(asked,
                       entities.select(F.col("id").alias("known"), F.col("vec").alias("kv")), ["known"])
    full = full.join(relations.select(F.col("id").alias("r"), F.col("vec").alias("rv")), "r")
    queries = full.select(F.lit("all").alias("grp"), "qid",
                          make(F.col("kv"), F.col("rv")).alias("qvec"))
    items = entities.select(F.lit("all").alias("grp"), F.col("id").alias("iid"), F.col("vec").alias("ivec"))
    fold, schema = blocks.keep_top_per_query(k)
    cells = blocks.score_blocks(queries, items, fold, schema, metric=scorer.metric, block=block)
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "iid")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(asked, "qid").select(
        "known", "r", F.col("iid").alias("candidate"), "score", F.col("rank").cast("bigint").alias("rank"))


def filtered_ranks(test: DataFrame, true_triples: DataFrame, entities: DataFrame, relations: DataFrame,
                   model: str, block: int = blocks.BLOCK) -> DataFrame:
    """Head and tail ranks of test triples among all entities, other true triples removed."""
    scorer = SCORERS[model]

    def rounded(triples, *extra):
        # Written once: both directions and all their steps read it.
        full = with_vectors(triples.select("h", "r", "t").distinct(), entities, relations)
        # Each side is compared with candidates by its own query, so its threshold comes from that query too.
        tail = scorer.score(F.col("hv"), F.col("rv"), F.col("tv"))
        back = scorer.head_query(F.col("tv"), F.col("rv"))
        head = V.dot(back, F.col("hv")) if scorer.metric == "dot" else -V.norm(V.subtract(back, F.col("hv")))
        return cut_lineage(full.select("h", "r", "t", F.round(tail, blocks.SCORE_DIGITS).alias("tail_score"),
                                       F.round(head, blocks.SCORE_DIGITS).alias("head_score"),
                                       F.monotonically_increasing_id().alias("qid"), *extra))

    rows = rounded(test, scorer.tail_query(F.col("hv"), F.col("rv")).alias("tail_query"),
                   scorer.head_query(F.col("tv"), F.col("rv")).alias("head_query"))
    known = (rows if test is true_triples else rounded(true_triples)).select("h", "r", "t", "tail_score", "head_score")
    items = entities.select(F.lit("all").alias("grp"), F.col("id").alias("iid"), F.col("vec").alias("ivec"))
    out = rows.select("h", "r", "t", "qid")
    for side, own, other in (("tail", "h", "t"), ("head", "t", "h")):
        queries = rows.select(F.lit("all").alias("grp"),
                              "qid", F.col(f"{side}_query").alias("qvec"), F.col(f"{side}_score").alias("threshold"), own, "r")
        marked = known.select("h", "r", "t", F.col(other).alias("kid"), F.col(f"{side}_score").alias("score"))
        ranks = rank_among(queries, items, marked, [own, "r"], scorer.metric, block)
        out = out.join(ranks.select("qid", F.col("rank").alias(f"{side}_rank")), "qid")
    return out.drop("qid")


def corrupt_tails(triples: DataFrame, n_entities: int, k: int = 1, seed: int = 42) -> DataFrame:
    """k copies of each triple with a uniformly drawn tail (no filtering)."""
    draws = triples.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))
    u = V.seeded_uniform(seed, F.col("h"), F.col("r"), F.col("t"), F.col("copy"))
    return draws.withColumn("neg_t", F.floor(u * F.lit(float(n_entities))).cast("bigint"))


# ---------------------------------------------------------------- training
def _gradients(name: str, h, r, t):
    """Score and its gradients for a batch of triples (rows)."""
    half = h.shape[1] // 2

    def split(x):
        return x[:, :half], x[:, half:]

    if name == "distmult":
        return (h * r * t).sum(1), r * t, h * t, h * r
    if name == "complex":
        (hr, hi), (rr, ri), (tr, ti) = split(h), split(r), split(t)
        score = (hr * rr * tr + hr * ri * ti + hi * rr * ti - hi * ri * tr).sum(1)
        return (score, np.hstack([rr * tr + ri * ti, rr * ti - ri * tr]),
                np.hstack([hr * tr + hi * ti, hr * ti - hi * tr]),
                np.hstack([hr * rr - hi * ri, hr * ri + hi * rr]))
    if name == "transe":
        diff = h + r - t
        dist = np.sqrt((diff * diff).sum(1)) + 1e-12
        unit = diff / dist[:, None]
        return -dist, -unit, -unit, unit
    (hr, hi), (c, s) = split(h), (np.cos(r), np.sin(r))
    re, im = hr * c - hi * s, hr * s + hi * c
    diff = np.hstack([re, im]) - t
    dist = np.sqrt((diff * diff).sum(1)) + 1e-12
    unit = diff / dist[:, None]
    ur, ui = split(unit)
    return (-dist, -np.hstack([ur * c + ui * s, -ur * s + ui * c]), -(-ur * im + ui * re), unit)


STATE = "kind string, part int, id bigint, vec array<double>, m array<double>, v array<double>"
_VECTOR = pa.list_(pa.float64())
_STATE = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("id", pa.int64()), ("vec", _VECTOR), ("m", _VECTOR), ("v", _VECTOR)])
_SUMS = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("g", _VECTOR)])
#: Sums of gradients a task holds before it passes them on.
HELD_ROWS = 65_536
#: Ids of a part, numbers in the entity table that a join may broadcast (8 MB), and triples of a chunk.
PART_ROWS, BROADCAST_NUMBERS, CHUNK_ROWS = 8_192, 1 << 20, 8_192
#: Epochs whose tables are kept at once, and triples whose gradients are made at once.
KEPT_EPOCHS, BATCH_ROWS = 4, 2_048


def _lists(rows: np.ndarray) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(rows).ravel()))


def _batch_sums(model: str, n: int, h, r, t, x) -> tuple[float, list]:
    """Loss and gradients of one batch of triples and corrupted tails, as ``(kind, end, gradients)``."""
    scorer = SCORERS[model]
    sp, ph, pr, pt = _gradients(model, h, r, t)
    sn, nh, nr, nt = _gradients(model, h, r, x)
    if scorer.loss == "margin":
        loss = np.maximum(0.0, sn - sp + scorer.margin)
        wp = -(loss > 0).astype(float) / n
        wn, total = -wp, loss.sum() / n
    else:
        total = np.logaddexp(0.0, -np.concatenate([sp, -sn])).sum() / (2 * n)
        wp, wn = -1.0 / (1.0 + np.exp(sp)) / (2 * n), 1.0 / (1.0 + np.exp(-sn)) / (2 * n)
    wp, wn = wp[:, None], wn[:, None]
    return total, [("e", "h", wp * ph + wn * nh), ("r", "r", wp * pr + wn * nr), ("e", "t", wp * pt), ("e", "neg_t", wn * nt)]


def gradient_sums(full: DataFrame, model: str, n: int) -> DataFrame:
    """``(kind, id, g)``: gradients summed by id inside each task, and the loss as kind ``loss``.

    A task keeps up to ``HELD_ROWS`` sums over its batches, so a frequent entity sends a row a task.
    """

    def run(batches):
        held: dict[str, list] = {"e": [], "r": []}
        loss = 0.0

        def merged(kind: str) -> tuple[np.ndarray, np.ndarray]:
            return sum_rows(np.concatenate([i for i, _ in held[kind]]), np.vstack([g for _, g in held[kind]]))

        def rows(kind: str, sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(sums[0]), pa.string()), pa.array(sums[0], pa.int64()), _lists(sums[1])], schema=_SUMS)

        for batch in batches:
            if not batch.num_rows:
                continue
            total, parts = _batch_sums(model, n, *(matrix(batch.column(c)) for c in ("hv", "rv", "tv", "nv")))
            loss += total
            for kind, end, grads in parts:
                held[kind].append(sum_rows(batch.column(end).to_numpy(), grads))
            for kind in held:
                held[kind] = [merged(kind)]
                if len(held[kind][0][0]) > HELD_ROWS:
                    yield rows(kind, held[kind].pop())
        for kind, sums in held.items():
            if sums:
                yield rows(kind, merged(kind))
        if loss:
            yield rows("loss", (np.zeros(1, np.int64), np.array([[loss]])))

    return full.select("h", "r", "t", "neg_t", "hv", "rv", "tv", "nv").mapInArrow(run, "kind string, id bigint, g array<double>")


def chunk_sums(pairs: DataFrame, entities: DataFrame, relations: DataFrame, model: str, n: int) -> DataFrame:
    """``gradient_sums`` where the entity table is too large to broadcast.

    Triples are dealt into chunks by hash. A chunk asks for each vector once, and sends back one sum for
    it, so neither the driver nor a task holds all entities, and no row carries three vectors.
    """
    chunks = max(1, -(-n // CHUNK_ROWS))
    dealt = pairs.select("h", "r", "t", "neg_t", F.pmod(F.xxhash64("h", "r", "t"), F.lit(chunks)).cast("int").alias("chunk"))
    asked = dealt.select(F.col("chunk").alias("task"), F.explode(F.array("h", "t", "neg_t")).alias("id")).distinct()
    # One relation vector per edge type: a short, closed list.
    every = pairs.sparkSession.range(chunks).select(F.col("id").cast("int").alias("task")).crossJoin(F.broadcast(relations))
    held = asked.join(entities, "id").select("task", F.lit("e").alias("kind"), "id", "vec").unionByName(
        every.select("task", F.lit("r").alias("kind"), "id", "vec"))

    def run(own: pa.Table, held: pa.Table) -> pa.Table:
        tables = {}
        for kind in ("e", "r"):
            rows = held.filter(pc.equal(held["kind"], kind)).sort_by("id").combine_chunks()
            if not rows.num_rows:
                return _SUMS.empty_table()
            tables[kind] = rows["id"].to_numpy(), matrix(rows["vec"].combine_chunks())
        own = own.sort_by([(c, "ascending") for c in ("h", "r", "t")])
        ends = {end: ("r" if end == "r" else "e", own[end].to_numpy()) for end in ("h", "r", "t", "neg_t")}
        known, places = np.ones(own.num_rows, bool), {}
        for end, (kind, ids) in ends.items():
            every_id = tables[kind][0]
            places[end] = np.minimum(np.searchsorted(every_id, ids), len(every_id) - 1)
            known &= every_id[places[end]] == ids
        places = {end: at[known] for end, at in places.items()}
        sums, loss = {kind: np.zeros_like(vecs) for kind, (_, vecs) in tables.items()}, 0.0
        for start in range(0, int(known.sum()), BATCH_ROWS):
            at = {end: place[start:start + BATCH_ROWS] for end, place in places.items()}
            total, parts = _batch_sums(model, n, *(tables[ends[end][0]][1][at[end]] for end in ("h", "r", "t", "neg_t")))
            loss += total
            for kind, end, grads in parts:
                row, summed = sum_rows(at[end], grads)
                sums[kind][row] += summed
        out = [pa.table([pa.array([kind] * len(ids), pa.string()), pa.array(ids, pa.int64()), _lists(sums[kind])], schema=_SUMS) for kind, (ids, _) in tables.items()]
        return pa.concat_tables([*out, pa.table([pa.array(["loss"]), pa.array([0], pa.int64()), _lists(np.array([[loss]]))], schema=_SUMS)])

    return dealt.groupBy("chunk").cogroup(held.groupBy("task")).applyInArrow(run, "kind string, id bigint, g array<double>")


def train_epoch(triples: DataFrame, state: DataFrame, model: str, epoch: int, n_entities: int, n_triples: int, parts: int,
                lr: float = 1e-3, seed: int = 42, small: bool = False) -> DataFrame:
    """One full-batch epoch: join, gradients summed per id, and an Adam step of each part of ids.

    ``state`` holds all vectors with their optimiser state, and so does the result, which
    also has the epoch's loss as rows of kind ``loss``. It is one job with one table to write. With ``small`` the
    entity vectors, counted by the caller, are broadcast; otherwise chunks of triples ask for theirs.
    """
    entities, relations = (state.where(F.col("kind") == k).select("id", "vec") for k in ("e", "r"))
    pairs = corrupt_tails(triples, n_entities, 1, seed + epoch)
    if small:
        entities = F.broadcast(entities)
        full = with_vectors(pairs.select("h", "r", "t", "neg_t"), entities, F.broadcast(relations))
        full = full.join(entities.select(F.col("id").alias("neg_t"), F.col("vec").alias("nv")), "neg_t")
        sums = gradient_sums(full, model, n_triples)
    else:
        sums = chunk_sums(pairs, entities, relations, model, n_triples)
    sums = sums.withColumn("part", part_of(parts))
    b1, b2, eps = 0.9, 0.999, 1e-8

    def step(key, own: pa.Table, grads: pa.Table) -> pa.Table:
        kind, part = key[0].as_py(), key[1].as_py()
        if kind == "loss":
            total = np.array([[matrix(grads["g"].combine_chunks()).sum()]])
            none = pa.array([[]], _VECTOR)
            return pa.table([pa.array([kind]), pa.array([part], pa.int32()), pa.array([epoch], pa.int64()), _lists(total), none, none], schema=_STATE)
        if not own.num_rows:
            return _STATE.empty_table()
        own = own.sort_by("id").combine_chunks()
        ids = own["id"].to_numpy()
        vec, m, v = (matrix(own[c].combine_chunks()) for c in ("vec", "m", "v"))
        g = np.zeros_like(vec)
        if grads.num_rows:
            at, summed = sum_rows(grads["id"].to_numpy(), matrix(grads["g"].combine_chunks()))
            place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
            known = ids[place] == at
            g[place[known]] = summed[known]
        m, v = m * b1 + g * (1 - b1), v * b2 + g * g * (1 - b2)
        vec = vec - lr * (m / (1 - b1 ** epoch)) / (np.sqrt(v / (1 - b2 ** epoch)) + eps)
        return pa.table([own["kind"], own["part"], own["id"], _lists(vec), _lists(m), _lists(v)], schema=_STATE)

    key = ["kind", "part"]
    return state.where("kind <> 'loss'").groupBy(*key).cogroup(sums.groupBy(*key)).applyInArrow(step, STATE)


def part_of(parts: int) -> Column:
    return F.when(F.col("kind") == "e", F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(0).cast("int")


def initial_vectors(ids: DataFrame, dim: int, seed: int, bound: float) -> DataFrame:
    """Seeded uniform start in [-bound, bound] with zero optimiser state."""
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)),
                      lambda i: (V.seeded_uniform(seed, F.col("id"), i) * 2 - 1) * bound)
    return ids.select("id", vec.alias("vec"), V.zeros(dim).alias("m"), V.zeros(dim).alias("v"))


def fit(triples: DataFrame, entity_ids: DataFrame, relation_ids: DataFrame, model: str, dim: int = 128,
        epochs: int = 100, lr: float = 1e-3, seed: int = 42):
    """Trains one model; returns entity vectors, relation vectors and the loss history.

    Each epoch writes the state once and the next one reads it, so no plan grows and a lost
    executor costs an epoch at most. Losses are read every ``KEPT_EPOCHS`` epochs, and older states are deleted.
    """
    spark = triples.sparkSession
    n_entities, n_relations = entity_ids.count(), relation_ids.count()
    rel_dim = dim // 2 if model == "rotate" else dim
    rel_bound = 3.14159 if model == "rotate" else float(np.sqrt(6.0 / (n_relations + dim)))
    entities = initial_vectors(entity_ids, dim, seed, float(np.sqrt(6.0 / (n_entities + dim))))
    if model == "transe":
        entities = normalise(entities)
    relations = initial_vectors(relation_ids, rel_dim, seed + 1, rel_bound)
    parts = max(1, min(parallelism(spark), n_entities), -(-n_entities // PART_ROWS))
    both = entities.withColumn("kind", F.lit("e")).unionByName(relations.withColumn("kind", F.lit("r"))).withColumn("part", part_of(parts))
    triples, state, paths = cut_lineage(triples), cut_lineage(both.select(*_STATE.names)), []
    n_triples = triples.count()
    history: dict[int, float] = dict.fromkeys(range(1, epochs + 1), 0.0)
    for epoch in range(1, epochs + 1):
        moved = train_epoch(triples, state, model, epoch, n_entities, n_triples, parts, lr, seed, n_entities * dim <= BROADCAST_NUMBERS)
        paths.append(side_table(spark, "epoch"))
        moved.write.parquet(paths[-1])
        state = spark.read.schema(STATE).parquet(paths[-1])
        if len(paths) == KEPT_EPOCHS or epoch == epochs:
            losses = spark.read.schema(STATE).parquet(*paths).where("kind = 'loss'").select("id", F.col("vec")[0].alias("loss")).collect()
            history |= {r.id: r.loss for r in losses}
            drop_tables(spark, paths[:-1])
            # The newest table's loss is read again with the next ones.
            paths = paths[-1:]
            del moved
            release_shuffles(spark)
    entities, relations = (state.where(F.col("kind") == k).select("id", "vec", "m", "v") for k in ("e", "r"))
    return entities, relations, [history[e] for e in range(1, epochs + 1)]
