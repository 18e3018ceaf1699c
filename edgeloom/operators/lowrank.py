"""Low-rank factors of tall tables, by randomised subspaces and trees of triangular factors.

Rows stay spread over tasks. What leaves a task is a few matrices whose sides are the
rank asked for and the width of a row; they meet eight at a time in a tree, and the
last eight at most reach the driver. No square matrix of the row width is built.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scalar import hashed_uniform
from edgeloom.operators.ordering import dense_number
from edgeloom.operators.skew import spread_join
from edgeloom.session import cut_lineage, discard, drop_tables, handed_on, owned_tables, release_shuffles, tables_of

FAN = 8
EXTRA = 10
Parts = list[np.ndarray]


def _packed(parts: Parts) -> bytes:
    out = io.BytesIO()
    np.savez(out, *parts)
    return out.getvalue()


def _unpacked(data: bytes) -> Parts:
    with np.load(io.BytesIO(data)) as stored:
        return [stored[f"arr_{i}"] for i in range(len(stored.files))]


def matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


#: Rows of one number up to which they are added in turns.
TURNS = 64


def sum_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of ``at`` in order, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    if not len(at):
        return at, rows
    size = np.diff(np.append(first, len(at)))
    most = int(size.max())
    if most > TURNS:
        return at[first], np.add.reduceat(rows[order], first, axis=0)
    # The second row of each number is added to its first, then the third: most numbers have few rows.
    out = rows[order[first]]
    for turn in range(1, most):
        own = np.flatnonzero(size > turn)
        out[own] += rows[order[first[own] + turn]]
    return at[first], out


def tree_fold(rows: DataFrame, columns: list[str], start: Callable[[list[np.ndarray]], Parts], merge: Callable[[Parts, Parts], Parts]) -> Parts | None:
    """One result of all rows: ``start`` of each batch's matrices, put together by ``merge``; None without rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = start([matrix(batch.column(c)) for c in columns])
                held = own if held is None else merge(held, own)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(held)], pa.binary())], ["part"])

    def together(table: pa.Table) -> pa.Table:
        held = None
        for data in table["part"].to_pylist():
            own = _unpacked(data)
            held = own if held is None else merge(held, own)
        return pa.table({"part": pa.array([_packed(held)], pa.binary())})

    parts = cut_lineage(rows.select(*columns).mapInArrow(fold, "part binary").select(F.spark_partition_id().alias("at"), "part"))
    count = parts.count()
    while count > FAN:
        group = F.floor(F.col("at") / FAN).cast("int")
        merged = parts.groupBy(group.alias("_group")).applyInArrow(lambda key, table: together(table).append_column("at", pa.array([key[0].as_py()], pa.int32())), "part binary, at int")
        parts = cut_lineage(merged)
        count = parts.count()
    found = parts.orderBy("at").collect()
    held = None
    for row in found:
        own = _unpacked(row.part)
        held = own if held is None else merge(held, own)
    return held


def triangular(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _moments(blocks: list[np.ndarray]) -> Parts:
    a = blocks[0]
    mean = a.mean(axis=0)
    return [np.array([len(a)], np.int64), mean, ((a - mean) ** 2).sum(axis=0)]


def _merged_moments(x: Parts, y: Parts) -> Parts:
    n = x[0] + y[0]
    gap = y[1] - x[1]
    return [n, x[1] + gap * (y[0] / n), x[2] + y[2] + gap ** 2 * (x[0] * y[0] / n)]


def _inverse_transpose(r: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of the transpose of a triangular factor, which few rows make flat; directions below rounding are left out."""
    r = np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    u, s, vt = np.linalg.svd(r)
    keep = s > s[0] * max(r.shape) * np.finfo(float).eps if s[0] > 0 else np.zeros(len(s), bool)
    return (u[:, keep] / s[keep]) @ vt[keep]


def principal_components(vectors: DataFrame, k: int, column: str = "vec", passes: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, ``k`` components by falling variance, their variances, and the variance of all dimensions.

    A random subspace of ``k + 10`` dimensions is sharpened by passes over the rows. A pass
    multiplies rows with the subspace, factors the product by a tree of QR steps and sums its products
    with the rows; the range it finds gives the next subspace. A last factor turns the subspace so that
    its images are uncorrelated, whatever the passes have reached. The largest entry of a component
    is positive. Directions without variance are zero.
    """
    moments = tree_fold(vectors, [column], _moments, _merged_moments)
    if moments is None:
        return np.zeros(0), np.zeros((k, 0)), np.zeros(k), 0.0
    n, mean, spread = int(moments[0][0]), moments[1], moments[2]
    width = len(mean)
    rank = min(width, k + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, rank)))[0]

    def factor(blocks: list[np.ndarray], basis: np.ndarray) -> Parts:
        a = blocks[0] - mean
        y = a @ basis
        return [triangular(y), y.T @ a]

    for _ in range(passes if rank < width else 0):
        r, product = tree_fold(vectors, [column], lambda blocks, basis=basis: factor(blocks, basis), lambda x, y: [triangular(np.vstack([x[0], y[0]])), x[1] + y[1]])
        basis = np.linalg.qr((_inverse_transpose(r) @ product).T)[0]
    r, = tree_fold(vectors, [column], lambda blocks: factor(blocks, basis)[:1], lambda x, y: [triangular(np.vstack([x[0], y[0]]))])
    _, s, turn = np.linalg.svd(r, full_matrices=False)
    rows = turn @ basis.T
    components, variances = np.zeros((k, width)), np.zeros(k)
    top = min(k, len(s))
    variances[:top] = s[:top] ** 2 / max(n - 1, 1)
    components[:top] = rows[:top] * np.sign(rows[np.arange(top), np.abs(rows[:top]).argmax(axis=1)])[:, None]
    components[variances <= variances[0] * 1e-24] = 0.0
    return mean, components, variances, float(spread.sum() / max(n - 1, 1))


def times(rows: DataFrame, weight: np.ndarray, column: str = "vec", shift: np.ndarray | None = None) -> DataFrame:
    """The rows with ``column`` replaced by its product with ``weight``, after ``shift`` is taken away; null stays null."""
    names = rows.columns

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old = batch.column(column)
            full = old.is_valid()
            out = np.zeros((0, weight.shape[1]))
            if old.null_count < len(old):
                a = matrix(old.filter(full))
                out = (a if shift is None else a - shift) @ weight
            at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int32) * weight.shape[1]
            new = pa.ListArray.from_arrays(pa.array(at, mask=np.append(~full.to_numpy(zero_copy_only=False), False)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([new if c == column else batch.column(c) for c in names], names)

    kinds = dict(rows.dtypes) | {column: "array<double>"}
    return rows.mapInArrow(multiply, ", ".join(f"`{c}` {kinds[c]}" for c in names))


#: Vectors of one column block, cells of one task, and row numbers of one task that adds up.
BLOCK_ROWS, TASK_CELLS, PART_ROWS = 16_384, 1_000_000, 8_192
#: Most cells are in the first blocks, whose vectors go to many tasks. After so many blocks they are so much larger: a row then gets fewer sums.
NARROW, WIDER = 4, 4
#: Cells multiplied at a time.
CHUNK = 1 << 13
_SUMS = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("vec", pa.list_(pa.float64()))])


def numbered_ids(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """The rows with numbers ``no`` from 0 by falling ``weight``, so that the columns most cells use share few blocks."""
    return cut_lineage(dense_number(rows, [], [F.col(weight).desc(), F.col(key)], "no"))


def _column_block(no: str) -> Column:
    rest = F.col(no) - NARROW * BLOCK_ROWS
    return F.when(rest < 0, F.floor(F.col(no) / BLOCK_ROWS)).otherwise(NARROW + F.floor(rest / (WIDER * BLOCK_ROWS))).cast("int")


def deal_cells(cells: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``cells(a, b, v)`` with their column block and a share of it by row, and how many shares a block has.

    One number a block of columns reaches the driver.
    """
    cells = cut_lineage(cells.select("a", "b", "v", _column_block("b").alias("col")))
    shares = {r[0]: -(-r[1] // TASK_CELLS) for r in cells.groupBy("col").count().collect()}
    return cells.withColumn("share", F.pmod(F.xxhash64("a"), _share_count(shares)).cast("int")), shares


def _share_count(shares: dict[int, int]) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(shares.get(i, 0)) for i in range(max(shares, default=0) + 1)]), F.col("col")), F.lit(0))


def _row_sums(at: np.ndarray, rows: Callable[[slice], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of the ordered ``at``, and the sums of the rows of each, ``CHUNK`` rows at a time."""
    first = np.append(True, at[1:] != at[:-1])
    place = np.cumsum(first) - 1
    out = np.zeros((place[-1] + 1, width))
    for start in range(0, len(at), CHUNK):
        own = slice(start, start + CHUNK)
        ids = place[own]
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out[ids[begin]] += np.add.reduceat(rows(own), begin, axis=0)
    return at[first], out


def _listed(no: np.ndarray, vecs: np.ndarray) -> pa.Table:
    at = np.arange(len(no) + 1, dtype=np.int32) * vecs.shape[1]
    return pa.table([pa.array(no // PART_ROWS), pa.array(no), pa.ListArray.from_arrays(pa.array(at), pa.array(vecs.ravel()))], schema=_SUMS)


def sparse_times(dealt: tuple[DataFrame, dict[int, int]], vectors: DataFrame) -> DataFrame:
    """``(no, vec)``: for each row ``a`` of the dealt cells the sum of ``v`` times the vector whose ``no`` is ``b``.

    A task has one block of vectors and a share of the cells in its columns, and sends on one sum a
    row, so vectors are sent once a share, not once a cell. Sums of one row meet in the task of its part.
    """
    cells, shares = dealt

    def multiply(own: pa.Table, held: pa.Table) -> pa.Table:
        if not (own.num_rows and held.num_rows):
            return _SUMS.empty_table()
        held = held.sort_by("no").combine_chunks()
        own = own.sort_by([("a", "ascending"), ("b", "ascending")])
        vecs, at, v = matrix(held["vec"].combine_chunks()), np.searchsorted(held["no"].to_numpy(), own["b"].to_numpy()), own["v"].to_numpy()

        def products(rows: slice) -> np.ndarray:
            out = vecs[at[rows]]
            out *= v[rows, None]
            return out

        return _listed(*_row_sums(own["a"].to_numpy(), products, vecs.shape[1]))

    def together(own: pa.Table) -> pa.Table:
        # Addends in order of value, so that sums do not depend on which task was done first.
        no, vecs = own["no"].to_numpy(), matrix(own["vec"].combine_chunks())
        order = np.lexsort((vecs[:, 0], no))
        return _listed(*_row_sums(no[order], lambda rows: vecs[order[rows]], vecs.shape[1]))

    copies = vectors.withColumn("col", _column_block("no")).where(_share_count(shares) > 0).withColumn(
        "share", F.explode(F.sequence(F.lit(0), _share_count(shares) - 1)))
    parts = cells.groupBy("col", "share").cogroup(copies.groupBy("col", "share")).applyInArrow(multiply, "part bigint, no bigint, vec array<double>")
    return parts.groupBy("part").applyInArrow(together, "part bigint, no bigint, vec array<double>").select("no", "vec")


def symmetric_vectors(cells: DataFrame, dim: int, passes: int = 3, seed: int = 42, spent: bool = False) -> DataFrame:
    """``(id, vec)`` from a symmetric sparse table ``cells(a, b, v)``: leading eigenvectors times roots of their values.

    The subspace is a table like any other: a pass multiplies it with the cells, block by block, and a tree of
    QR steps gives the weight that makes the columns orthonormal. That weight is applied as the next pass reads, so
    one subspace is kept and one is written at a time. The values come from a matrix of the rank's size.
    ``cells`` is read several times: hand over a written table where it is costly to make. ``spent``: it is such a
    table, and goes when it has been dealt.
    """
    rank, spark = dim + EXTRA, cells.sparkSession
    with owned_tables(spark):
        names = numbered_ids(cells.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "n").select("id", "no")
        numbered = spread_join(spread_join(cells, names.select(F.col("id").alias("a"), F.col("no").alias("_a")), ["a"]), names.select(F.col("id").alias("b"), F.col("no").alias("_b")), ["b"])
        dealt = deal_cells(numbered.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "v"))
        basis = names.select("no", F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda i: hashed_uniform(seed, F.col("id"), i) - 0.5).alias("vec"))
        del numbered
        if spent:
            discard(cells)
        image = None

        for _ in range(passes):
            image, old = cut_lineage(sparse_times(dealt, basis)), image
            r = tree_fold(image, ["vec"], lambda blocks: [triangular(blocks[0])], lambda x, y: [triangular(np.vstack([x[0], y[0]]))])
            if r is None:
                return handed_on(names.select("id", F.array().cast("array<double>").alias("vec")))
            basis = times(image, _inverse_transpose(r[0]).T)
            if old is not None:
                drop_tables(spark, tables_of(old))
            release_shuffles(spark)
        turned = cut_lineage(sparse_times(dealt, basis).withColumnRenamed("vec", "image"))
        release_shuffles(spark)
        found = tree_fold(basis.join(turned, "no"), ["vec", "image"], lambda blocks: [blocks[0].T @ blocks[1]], lambda x, y: [x[0] + y[0]])[0]
        values, vectors = np.linalg.eigh((found + found.T) / 2)
        order = np.argsort(-np.abs(values))[:dim]
        weight = np.zeros((len(values), dim))
        weight[:, :len(order)] = vectors[:, order] * np.sqrt(np.abs(values[order]))
        discard(turned)
        return handed_on(names.join(times(basis, weight), "no").select("id", "vec"))
