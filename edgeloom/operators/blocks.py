"""Block-wise scoring of every query vector against every item vector.

Both sides are cut into hash blocks of bounded size. A cell holds one query
block and one item block; one matrix product scores it and a fold keeps only
what the caller needs (best k, counts, summaries), so the full score matrix is
never stored. Blocks are hashed on unique ids, which keeps cells even, and each
side is repeated only once per block of the other side. Inside a task a cell is
scored tile by tile; where a fold only compares scores, the tile is made in single
precision with an error bound, and pairs that the bound leaves open are scored
term by term in double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scalar import norm
from edgeloom.operators.skew import spread_join
from edgeloom.session import parallelism

#: Rows of a block at most, and rows of a block that make a task worth while.
BLOCK, LEAST = 16_384, 1_024
#: Query rows and item rows of a tile, pairs of a tile that are looked at together, and terms of pairs that are summed at once.
TILE_ROWS, TILE_ITEMS, PAIRS, TERMS = 512, 4_096, 1 << 17, 1 << 18
SCORE_DIGITS = 8


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors that are not null, as rows; a view of the column where it has one chunk."""
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    rows = len(column) - column.null_count
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1)


def _exact(q: np.ndarray, items: np.ndarray, metric: str, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded scores of listed pairs, term by term as a column expression makes them."""
    out = np.empty(len(rows))
    lot = max(1, TERMS // max(1, q.shape[1]))
    for at in range(0, len(rows), lot):
        i, j = rows[at:at + lot], cols[at:at + lot]
        terms = (q[i] - items[j]) ** 2 if metric == "l2" else q[i] * items[j]
        total = np.add.accumulate(terms, axis=1)[:, -1]
        out[at:at + lot] = np.round(-np.sqrt(total) if metric == "l2" else total, SCORE_DIGITS)
    return out


class Tile:
    """Approximate scores of some query rows with some items, and how far they may be off.

    ``grade`` rises with the score: the product itself, or the negative square of the distance. It
    is in single precision unless numbers are too large for that. ``below(s)`` and ``beyond(s)`` are, by row,
    grades under and over which a rounded score is surely under and over ``s``.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, slack: np.ndarray, metric: str):
        self.grade, self.slack, self.metric = left @ right.T, slack, metric

    def _grade(self, score: np.ndarray, step: float) -> np.ndarray:
        moved = score + step * 2 * 10.0 ** -SCORE_DIGITS
        if self.metric == "l2":
            # No score is over zero: there every grade is under.
            moved = np.where(moved > 0, np.where(step > 0, np.inf, 0.0), -np.square(np.minimum(moved, 0.0)))
        return np.nextafter((moved + step * self.slack).astype(self.grade.dtype), self.grade.dtype.type(step * np.inf))[:, None]

    def below(self, score: np.ndarray) -> np.ndarray:
        return self._grade(score, -1.0)

    def beyond(self, score: np.ndarray) -> np.ndarray:
        return self._grade(score, 1.0)

    def reached(self, k: int) -> np.ndarray:
        """A score by row that at least ``k`` items reach; minus infinity where there may be fewer."""
        rows, n = self.grade.shape
        # The k-th best of the largest of groups of items: k items reach that.
        width = max(1, n // max(4 * k, 128))
        groups = n // width
        if groups < k:
            return np.full(rows, -np.inf)
        tops = self.grade[:, :groups * width].reshape(rows, width, groups).max(axis=1)
        return self.surely(np.partition(tops, groups - k, axis=1)[:, groups - k])

    def surely(self, grade: np.ndarray) -> np.ndarray:
        """Scores that rows with pairs of these grades reach."""
        least = grade.astype(np.float64) - self.slack
        return (-np.sqrt(np.maximum(-least, 0.0)) if self.metric == "l2" else least) - 2 * 10.0 ** -SCORE_DIGITS


@dataclass(frozen=True)
class Cell:
    """One query block and one item block of a view, and the pairs of them to skip, as places in both."""

    grp: str
    qid: np.ndarray
    q: np.ndarray
    threshold: np.ndarray
    iid: np.ndarray
    items: np.ndarray
    metric: str
    skip: tuple[np.ndarray, np.ndarray]

    def spans(self, n: int, step: int) -> list[slice]:
        return [slice(at, min(at + step, n)) for at in range(0, n, step)]

    def tiles(self):
        """Places of the rows and items of each tile, rows outermost."""
        for rows in self.spans(len(self.q), TILE_ROWS):
            for cols in self.spans(len(self.items), TILE_ITEMS):
                yield rows, cols

    @cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrices whose product is the grade of each pair, and by row how far it may be off."""
        q_sq, i_sq = np.einsum("ij,ij->i", self.q, self.q), np.einsum("ij,ij->i", self.items, self.items)
        top = float(i_sq.max())
        kind = np.float32 if q_sq.max() < 1e30 and top < 1e30 else np.float64
        unit = 4.0 * (self.q.shape[1] + 4) * np.finfo(kind).eps
        if self.metric != "l2":
            return self.q.astype(kind), self.items.astype(kind), unit * np.sqrt(q_sq * top) + 1e-30
        left = np.column_stack([2.0 * self.q, -q_sq, np.ones(len(q_sq))]).astype(kind)
        right = np.column_stack([self.items, np.ones(len(i_sq)), -i_sq]).astype(kind)
        return left, right, unit * (q_sq + top) + 1e-30

    def tile(self, rows: slice, cols: slice) -> Tile:
        left, right, slack = self.factors
        return Tile(left[rows], right[cols], slack[rows], self.metric)

    def skipped(self, rows: slice, cols: slice) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to skip inside a tile, as places in it."""
        i, j = self.skip
        own = (i >= rows.start) & (i < rows.stop) & (j >= cols.start) & (j < cols.stop)
        return i[own] - rows.start, j[own] - cols.start

    def open(self, rows: slice, cols: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which listed pairs of a tile are not to be skipped."""
        if not len(self.skip[0]):
            return np.ones(len(i), bool)
        si, sj = self.skipped(rows, cols)
        width = cols.stop - cols.start
        return ~np.isin(i.astype(np.int64) * width + j, si.astype(np.int64) * width + sj)

    def marked(self, rows: slice, cols: slice, mask: np.ndarray):
        """Places of a tile's true entries that are not to be skipped, in lots: where scores tie, all may be true."""
        # Far faster over a flat mask than over its two axes.
        flat = np.flatnonzero(mask.ravel())
        for at in range(0, len(flat), PAIRS):
            i, j = np.divmod(flat[at:at + PAIRS], mask.shape[1])
            ok = self.open(rows, cols, i, j)
            yield i[ok], j[ok]

    def exact(self, rows: slice, cols: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _exact(self.q[rows], self.items[cols], self.metric, i, j)

    def scores(self, rows: slice, cols: slice) -> np.ndarray:
        """All rounded scores of a tile in double precision, skipped pairs at minus infinity."""
        q, items = self.q[rows], self.items[cols]
        product = q @ items.T
        if self.metric == "l2":
            product = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (items * items).sum(1)[None, :] - 2.0 * product, 0.0))
        out = np.round(product, SCORE_DIGITS, out=product)
        out[self.skipped(rows, cols)] = -np.inf
        return out


def _block_counts(df: DataFrame, group: str, block: int, spread: int) -> dict[str, int]:
    """Blocks per group. Groups are type pairs or relations: a closed, short list."""
    rows = df.groupBy(group).count().collect()
    fine = min(block, LEAST)
    return {r[0]: max(-(-r[1] // block), min(spread, -(-r[1] // fine))) for r in rows}


def _lookup(counts: dict[str, int], key: Column) -> Column:
    entries = [F.lit(v) for pair in sorted(counts.items()) for v in pair]
    return F.create_map(*entries)[key]


BANDS = 32
#: Relative slack of norm bounds, far over the rounding of a product and of a score.
SLACK = 1e-6


@dataclass(frozen=True)
class Side:
    """One side's bands of falling norm in one group: bounds between them, largest norm and rows of each."""

    bounds: list[float]
    tops: list[float]
    rows: list[int]

    def blocks(self, block: int) -> list[int]:
        """Number of the first block of each band, and of all blocks."""
        return [0, *np.cumsum([-(-n // block) for n in self.rows]).tolist()]


def norm_bands(rows: DataFrame, vec: str, bands: int = BANDS) -> dict[str, Side]:
    """Bands of ``rows(grp, <vec>)`` by group; groups are few, and so are the numbers of each."""
    sized = rows.select("grp", norm(F.col(vec).cast("array<double>")).alias("norm"))
    cuts = sized.groupBy("grp").agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)], 1000).alias("cuts"))
    bounds = {r.grp: sorted(set(r.cuts), reverse=True) for r in cuts.collect()}
    counted = sized.groupBy("grp", band_of(bounds, F.col("norm")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()
    found = {}
    for group, own in bounds.items():
        mine = {r.band: r for r in counted if r.grp == group}
        places = range(len(own) + 1)
        found[group] = Side(own, [mine[b].top if b in mine else 0.0 for b in places], [mine[b].n if b in mine else 0 for b in places])
    return found


def _by_group(values: dict[str, list], kind: str) -> Column:
    entries = [x for g, v in sorted(values.items()) for x in (F.lit(g), F.array(*[F.lit(y) for y in v]).cast(f"array<{kind}>"))]
    return F.create_map(*entries)[F.col("grp")]


def band_of(bounds: dict[str, list[float]], size: Column) -> Column:
    """0 for the largest norms: how many bounds of the group are above the norm."""
    return F.size(F.filter(_by_group(bounds, "double"), lambda x: x > size))


@dataclass(frozen=True)
class Pruning:
    """What cells of norm-ordered blocks can reach a group's score: bands of both sides, and the score by group."""

    queries: dict[str, Side]
    items: dict[str, Side]
    floor: dict[str, float]

    def reach(self, own: dict[str, Side], other: dict[str, Side], block: int) -> Column:
        """How many blocks of the other side a row of ``norm`` has to meet: those of the bands whose largest norm reaches."""
        tops = {g: other[g].tops for g in self.floor}
        firsts = {g: other[g].blocks(block)[1:] for g in self.floor}
        least = {g: [f] for g, f in self.floor.items()}
        slack = 1.0 + SLACK
        pairs = F.arrays_zip(_by_group(tops, "double").alias("top"), _by_group(firsts, "int").alias("upto"))
        # A negative score is reached by any product of norms.
        met = F.filter(pairs, lambda p: (p["top"] * F.col("norm") * slack + SLACK >= _by_group(least, "double")[0]))
        return F.coalesce(F.array_max(F.transform(met, lambda p: p["upto"])), F.lit(0))

    def cells(self, block: int) -> tuple[int, int]:
        """All cells, and those that are skipped whole."""
        every = skipped = 0
        for g, floor in self.floor.items():
            q, i = self.queries[g], self.items[g]
            nq, ni = np.diff(q.blocks(block)), np.diff(i.blocks(block))
            every += int(nq.sum() * ni.sum())
            for top, n in zip(q.tops, nq):
                # A row meets every band down to the last that reaches, as in ``reach``.
                far = [b for b, other in enumerate(i.tops) if top * other * (1.0 + SLACK) + SLACK >= floor]
                skipped += int(n * (ni.sum() - (ni[:max(far) + 1].sum() if far else 0)))
        return every, skipped


def score_blocks(queries: DataFrame, items: DataFrame, fold: Callable, schema: str, *,
                 known: DataFrame | None = None, views: dict[str, list[str]] | None = None,
                 metric: str = "dot", block: int = BLOCK, pruning: Pruning | None = None) -> DataFrame:
    """Runs ``fold`` on every cell of the query x item grid of each group.

    ``queries(grp, qid, qvec[, threshold])`` and ``items(grp, iid, ivec)`` share
    ``grp``; ``known(grp, view, qid, iid)`` lists pairs to skip, each sent to the
    one cell that scores it. ``views`` names several results wanted from the
    same scores of a group (relations over one type pair), each with its own
    skipped pairs; the fold then reports the view name as ``grp``. With ``pruning`` blocks follow
    falling norm, and a row goes only to blocks that can reach its group's score with it.
    """
    if pruning is not None:
        return _pruned(queries, items, fold, schema, known, views, metric, block, pruning)
    # Some cells a task, so that tasks end together.
    spread = max(1, int((8 * parallelism(queries.sparkSession)) ** 0.5))
    nq = _block_counts(queries, "grp", block, spread)
    ni = _block_counts(items, "grp", block, spread)
    shared = sorted(set(nq) & set(ni))
    if not shared:
        return queries.sparkSession.createDataFrame([], schema)
    nq = {g: nq[g] for g in shared}
    ni = {g: ni[g] for g in shared}
    in_scope = F.col("grp").isin(shared)

    def q_block():
        return F.pmod(F.xxhash64("qid"), _lookup(nq, F.col("grp"))).cast("int")

    def i_block():
        return F.pmod(F.xxhash64("iid"), _lookup(ni, F.col("grp"))).cast("int")

    threshold = F.col("threshold") if "threshold" in queries.columns else F.lit(None)
    left = queries.where(in_scope).select(
        "grp", "qid", F.col("qvec").cast("array<double>").alias("qvec"),
        threshold.cast("double").alias("threshold"), F.lit(None).cast("bigint").alias("skip"),
        F.lit(None).cast("string").alias("view"), q_block().alias("_qb"),
        F.explode(F.sequence(F.lit(0), _lookup(ni, F.col("grp")) - 1)).alias("_ib"))
    if known is not None:
        left = left.unionByName(known.where(in_scope).select(
            "grp", "qid", F.lit(None).cast("array<double>").alias("qvec"),
            F.lit(None).cast("double").alias("threshold"), F.col("iid").alias("skip"),
            F.col("view"), q_block().alias("_qb"), i_block().alias("_ib")))
    right = items.where(in_scope).select(
        "grp", "iid", F.col("ivec").cast("array<double>").alias("ivec"),
        F.explode(F.sequence(F.lit(0), _lookup(nq, F.col("grp")) - 1)).alias("_qb"),
        i_block().alias("_ib"))

    return _run_cells(left, right, fold, schema, views, metric, sum(nq[g] * ni[g] for g in shared))


def _pruned(queries, items, fold, schema, known, views, metric, block, pruning: Pruning) -> DataFrame:
    shared = sorted(pruning.floor)
    if not shared:
        return queries.sparkSession.createDataFrame([], schema)
    in_scope = F.col("grp").isin(shared)

    def placed(rows: DataFrame, key: str, sides: dict[str, Side]) -> DataFrame:
        """Adds the block of each row: its band's first block plus a hash over the band's blocks."""
        firsts = _by_group({g: sides[g].blocks(block) for g in shared}, "int")
        band = band_of({g: sides[g].bounds for g in shared}, F.col("norm"))
        rows = rows.withColumn("_band", band).withColumn("_first", F.get(firsts, F.col("_band")))
        width = F.greatest(F.get(firsts, F.col("_band") + 1) - F.col("_first"), F.lit(1))
        return rows.withColumn("_block", (F.col("_first") + F.pmod(F.xxhash64(key), width)).cast("int")).drop("_band", "_first")

    def upto(n: Column) -> Column:
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    q = placed(queries.where(in_scope).select("grp", "qid", F.col("qvec").cast("array<double>").alias("qvec")).withColumn("norm", norm(F.col("qvec"))), "qid", pruning.queries)
    i = placed(items.where(in_scope).select("grp", "iid", F.col("ivec").cast("array<double>").alias("ivec")).withColumn("norm", norm(F.col("ivec"))), "iid", pruning.items)
    left = q.select("grp", "qid", "qvec", F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("bigint").alias("skip"), F.lit(None).cast("string").alias("view"),
                    F.col("_block").alias("_qb"), upto(pruning.reach(pruning.queries, pruning.items, block)).alias("_ib"))
    right = i.select("grp", "iid", "ivec", upto(pruning.reach(pruning.items, pruning.queries, block)).alias("_qb"), F.col("_block").alias("_ib"))
    if known is not None:
        at_q = q.select("grp", "qid", F.col("_block").alias("_qb"))
        at_i = i.select("grp", "iid", F.col("_block").alias("_ib"))
        marked = spread_join(spread_join(known.where(in_scope).select("grp", "view", "qid", "iid"), at_q, ["grp", "qid"]), at_i, ["grp", "iid"])
        left = left.unionByName(marked.select("grp", "qid", F.lit(None).cast("array<double>").alias("qvec"), F.lit(None).cast("double").alias("threshold"),
                                              F.col("iid").alias("skip"), "view", "_qb", "_ib"))
    every, skipped = pruning.cells(block)
    return _run_cells(left, right, fold, schema, views, metric, every - skipped)


def _run_cells(left: DataFrame, right: DataFrame, fold: Callable, schema: str, views: dict[str, list[str]] | None, metric: str, n_cells: int) -> DataFrame:
    arrow_schema = _arrow_schema(schema)

    def cell(key, lt: pa.Table, rt: pa.Table) -> pa.Table:
        is_query = pc.is_valid(lt["qvec"])
        rt = rt.filter(pc.is_valid(rt["ivec"])) if rt["ivec"].null_count else rt
        if lt["qvec"].null_count == lt.num_rows or rt.num_rows == 0:
            return arrow_schema.empty_table()
        # Only narrow columns are filtered and sorted as tables; of the vectors no more copies are made than needed.
        narrow = lt.drop_columns("qvec")
        qt, mt = narrow.filter(is_query), narrow.filter(pc.invert(is_query))
        # Items in the order of their ids, which is that of equal scores.
        order = np.argsort(rt["iid"].to_numpy(), kind="stable")
        qid, iid = qt["qid"].to_numpy(), rt["iid"].to_numpy()[order]
        q, items, threshold = _matrix(lt["qvec"]), _matrix(rt["ivec"])[order], qt["threshold"].to_numpy()
        group = key[0].as_py()
        parts = []
        for name in views[group] if views else [group]:
            skip = mt.filter(pc.equal(mt["view"], name)) if mt.num_rows else mt
            places = _places(qid, iid, skip["qid"].to_numpy(), skip["skip"].to_numpy())
            parts.append(pa.table(fold(Cell(name, qid, q, threshold, iid, items, metric, places)), schema=arrow_schema))
        return pa.concat_tables(parts)

    keys = ["grp", "_qb", "_ib"]
    # What a task sorts and holds follows the cells: a few of them each, however many there are.
    least = parallelism(left.sparkSession)
    tasks = max(least, min(n_cells, 4 * least), -(-n_cells // 8))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    pairs = [field.strip().split() for field in schema.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


def _places(qid: np.ndarray, iid: np.ndarray, skip_q: np.ndarray, skip_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of skipped pairs in both blocks; ``iid`` is in order."""
    if not len(skip_q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    qo = np.argsort(qid)
    qp = np.searchsorted(qid[qo], skip_q)
    ip = np.searchsorted(iid, skip_i)
    ok = (qp < len(qid)) & (ip < len(iid))
    qp, ip, skip_q, skip_i = qp[ok], ip[ok], skip_q[ok], skip_i[ok]
    ok = (qid[qo][qp] == skip_q) & (iid[ip] == skip_i)
    return qo[qp[ok]], ip[ok]


# ------------------------------------------------------------------ folds
def keep_top(k: int) -> tuple[Callable, str]:
    """Best k pairs of a cell, ties broken by ids."""

    def fold(cell: Cell):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        floor = -np.inf
        for rows, cols in cell.tiles():
            tile = cell.tile(rows, cols)
            flat = tile.grade.ravel()
            # So many of the tile's best that k of them are not to be skipped.
            wanted = k + len(cell.skipped(rows, cols)[0])
            if floor == -np.inf and flat.size > wanted:
                least = np.partition(flat, flat.size - wanted)[flat.size - wanted]
                floor = tile.surely(np.full(len(tile.grade), least)).min()
            for i, j in cell.marked(rows, cols, tile.grade >= tile.below(np.full(len(tile.grade), floor))):
                score = cell.exact(rows, cols, i, j)
                ok = np.isfinite(score) & (score >= floor)
                held = [np.concatenate(pair) for pair in zip(held, (cell.qid[rows][i[ok]], cell.iid[cols][j[ok]], score[ok]))]
                if len(held[0]) > k:
                    best = np.lexsort((held[1], held[0], -held[2]))[:k]
                    held = [x[best] for x in held]
                    floor = held[2][-1]
        return {"grp": [cell.grp] * len(held[0]), "qid": held[0], "iid": held[1], "score": held[2]}

    return fold, "grp string, qid bigint, iid bigint, score double"


def keep_top_per_query(k: int) -> tuple[Callable, str]:
    """Best k items of each query in a cell."""

    def fold(cell: Cell):
        found = []
        for rows in cell.spans(len(cell.q), TILE_ROWS):
            n = rows.stop - rows.start
            held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            floor = np.full(n, -np.inf)
            for cols in cell.spans(len(cell.items), TILE_ITEMS):
                tile = cell.tile(rows, cols)
                skipped = cell.skipped(rows, cols)
                tile.grade[skipped] = -np.inf
                floor = np.maximum(floor, tile.reached(k))
                for i, j in cell.marked(rows, cols, tile.grade >= tile.below(floor)):
                    score = cell.exact(rows, cols, i, j)
                    ok = np.isfinite(score)
                    row, item, score = (np.concatenate(pair) for pair in zip(held, (i[ok], j[ok] + cols.start, score[ok])))
                    best = np.lexsort((item, -score, row))
                    row = row[best]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    best = best[place < k]
                    full = row[place == k - 1]
                    held = [row[place < k], item[best], score[best]]
                    floor[full] = np.maximum(floor[full], held[2][np.searchsorted(held[0], full, "right") - 1])
            found.append((cell.qid[rows][held[0]], cell.iid[held[1]], held[2]))
        qid, iid, score = (np.concatenate(x) for x in zip(*found))
        return {"grp": [cell.grp] * len(qid), "qid": qid, "iid": iid, "score": score}

    return fold, "grp string, qid bigint, iid bigint, score double"


def count_above() -> tuple[Callable, str]:
    """Items of a cell scoring strictly above each query's threshold."""

    def fold(cell: Cell):
        above = np.zeros(len(cell.q), np.int64)
        for rows, cols in cell.tiles():
            tile, least = cell.tile(rows, cols), cell.threshold[rows]
            tile.grade[cell.skipped(rows, cols)] = -np.inf
            sure, maybe = tile.grade > tile.beyond(least), tile.grade >= tile.below(least)
            above[rows] += [np.count_nonzero(row) for row in sure]
            for i, j in cell.marked(rows, cols, np.logical_xor(sure, maybe, out=maybe)):
                over = cell.exact(rows, cols, i, j) > least[i]
                above[rows] += np.bincount(i[over], minlength=rows.stop - rows.start)
        return {"grp": [cell.grp] * len(cell.qid), "qid": cell.qid, "above": above}

    return fold, "grp string, qid bigint, above bigint"


def summarise() -> tuple[Callable, str]:
    """Count, sum and best score of each query in a cell."""

    def fold(cell: Cell):
        n, total, best = np.zeros(len(cell.q), np.int64), np.zeros(len(cell.q)), np.full(len(cell.q), -np.inf)
        for rows, cols in cell.tiles():
            scores = cell.scores(rows, cols)
            ok = np.isfinite(scores)
            n[rows] += ok.sum(axis=1)
            total[rows] += np.where(ok, scores, 0.0).sum(axis=1)
            best[rows] = np.maximum(best[rows], scores.max(axis=1))
        return {"grp": [cell.grp] * len(n), "qid": cell.qid, "n_pairs": n, "score_sum": total, "score_max": best}

    return fold, "grp string, qid bigint, n_pairs bigint, score_sum double, score_max double"


def _best(table: pa.Table, k: int) -> pa.Table:
    order = pc.sort_indices(table, [("grp", "ascending"), ("score", "descending"), ("qid", "ascending"), ("iid", "ascending")])
    table = table.take(order)
    groups = table["grp"].combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.arange(len(groups)) - np.searchsorted(groups, groups)
    return table.filter(pa.array(place < k))


def merge_best(cells: DataFrame, k: int) -> DataFrame:
    """Best k rows of each group with their rank, from ``cells(grp, qid, iid, score)``.

    Groups are a closed, short list. Each task keeps k rows a group as it reads,
    first where the cells are, then over about the square root of as many tasks;
    what meets in a group's last task is k rows from each of those.
    """
    schema = "grp string, qid bigint, iid bigint, score double"
    arrow = _arrow_schema(schema)

    def keep(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).cast(arrow))
            rows += batch.num_rows
            if rows > 4 * k + 100_000:
                held = [_best(pa.concat_tables(held), k)]
                rows = 0
        if held:
            yield from _best(pa.concat_tables(held), k).combine_chunks().to_batches()

    def last(table: pa.Table) -> pa.Table:
        best = _best(table.cast(arrow), k)
        return best.append_column("rank", pa.array(np.arange(1, best.num_rows + 1), pa.int64()))

    tasks = max(1, round(parallelism(cells.sparkSession) ** 0.5))
    kept = cells.mapInArrow(keep, schema).repartition(tasks, F.xxhash64("qid", "iid")).mapInArrow(keep, schema)
    return kept.groupBy("grp").applyInArrow(last, schema + ", rank bigint")
