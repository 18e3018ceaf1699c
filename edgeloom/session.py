"""Session set-up and lineage control."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "edgeloom", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and side tables, as the session names it.

    Only a local session without the setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_OWNED: list[list[str]] = []


def side_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one written table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


@contextlib.contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the side tables of a job when its block ends.

    Results must be written or collected inside the block, since frames that read
    side tables are of no use after it. Blocks nest; each deletes its own.
    """
    _OWNED.append([])
    try:
        yield
    finally:
        drop_tables(spark, _OWNED.pop())


def handed_on(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for the result of an ``owned_tables`` block: its table belongs to the block around that one, if any."""
    own = _OWNED.pop() if _OWNED else None
    try:
        return cut_lineage(df)
    finally:
        if own is not None:
            _OWNED.append(own)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``cut_lineage`` that no frame in use reads, and shuffle files of frames out of use."""
    spark = tables[0].sparkSession
    drop_tables(spark, tables_of(*tables))
    release_shuffles(spark)


def tables_of(*tables: DataFrame) -> list[str]:
    """The folders that the frames read."""
    return sorted({file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()})


def drop_tables(spark: SparkSession, tables: list[str]) -> None:
    """Deletes side tables that no frame in use reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver collect frames out of use, so that Spark drops their shuffle files and broadcasts.

    It does so by itself when its heap fills; a loop of many small jobs fills disks first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder and read back.

    It survives executor loss like a reliable checkpoint, and the optimizer
    sees its true size: a checkpoint keeps the estimate of the plan it came
    from, which grows without bound in iterative jobs.
    """
    path = side_table(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input that one explicit partition should take (packed; some million narrow rows), and sizes that are estimates without ground.
PIECE_BYTES, UNKNOWN_BYTES = 16 << 20, 1 << 60


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables a plan reads, from the optimizer's statistics; None where it knows none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    try:
        total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except ValueError:  # an estimate too long to read
        return None
    return total if total < UNKNOWN_BYTES else None


def parallelism(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """Partition count for explicit partitioning: the session's, or more where ``rows`` reads more than that many pieces."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = None if rows is None else input_bytes(rows)
    return least if size is None else max(least, -(-size // PIECE_BYTES))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to as many tasks as their size asks for; unchanged where the session's count is enough.

    A grouping by these keys or more needs no further shuffle, and what a task holds does not grow with the input.
    """
    n = parallelism(rows.sparkSession, rows)
    return rows if n <= parallelism(rows.sparkSession) else rows.repartition(n, *keys)
