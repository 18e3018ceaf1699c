"""Runs registered queries against their SQL twins and prints differences.

Usage: python tests/check_queries.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "" if value is None else str(value)


def compare(spark_df, rel) -> str | None:
    """None when both results agree in columns, types, row count and values."""
    names = sorted(spark_df.columns)
    other = sorted(rel.columns)
    if names != other:
        return f"columns {names} vs {other}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "int": "INTEGER", "date": "DATE"}
    stypes = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in spark_df.schema.fields}
    dtypes = {n: str(k) for n, k in zip(rel.columns, rel.types)}
    wrong = {n: (stypes[n], dtypes[n]) for n in names if stypes[n] != dtypes[n]}
    got = sorted(tuple(_plain(r[n]) for n in names) for r in spark_df.collect())
    want = sorted(tuple(_plain(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if got != want:
        only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{len(only_got)} rows differ in {names}: {only_got[:2]} vs {only_want[:2]}"
    if wrong:
        return f"types {wrong}"
    return None if got else "EMPTY"


def main() -> int:
    from edgeloom.queries import all_queries, all_sql
    from edgeloom.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", {"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), all_sql(), 0
    for name, fn in all_queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            verdict = compare(df, con.sql(sql[name])) if name in sql else f"rows only: {df.count()}"
        except Exception as err:  # report and go on
            verdict = f"ERROR {str(err)[:700]}"
        if verdict is not None and not verdict.startswith("rows only"):
            bad += 1
        print(f"{name:40s} {time.time() - start:6.1f}s {verdict or 'ok'}", flush=True)
        spark.catalog.clearCache()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
