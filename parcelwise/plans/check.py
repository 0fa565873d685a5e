"""Local correctness check: every registered Spark query against its DuckDB SQL.

    python -m parcelwise.plans.check [sf_dir] [name ...]

Compares column names, row counts and an order-insensitive digest of values
(floats rounded to 6 decimals, temporal values as ISO text).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from parcelwise.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_value(x):
    if x is None:
        return None
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return round(x, 6) + 0.0
    if isinstance(x, (pd.Timestamp,)):
        return x.isoformat()
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if hasattr(x, "tolist"):
        return str(x.tolist())
    if isinstance(x, (list, tuple)):
        return str(list(x))
    if isinstance(x, bool):
        return int(x)
    return x


def normalise(rows: list[tuple]) -> list[tuple]:
    out = [tuple(_norm_value(v) for v in r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


SPARK_TO_DUCK = {
    "StringType": "VARCHAR", "LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE",
    "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP", "TimestampType": "TIMESTAMP",
    "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT",
}


def type_mismatches(spark_df, con, sql: str) -> list[str]:
    """Columns whose Spark type does not map to the DuckDB result type."""
    rel = con.sql(f"SELECT * FROM ({sql}) LIMIT 0")
    duck_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    out = []
    for f in spark_df.schema.fields:
        want = SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
        got = duck_types.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} vs duck {got}")
    return out


def compare(spark_df, con, sql: str):
    cols = sorted(spark_df.columns)
    s_rows = [tuple(r[c] for c in cols) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_raw = rel.fetchall()
    if sorted(d_cols) != cols:
        return False, f"columns differ: spark={cols} duck={sorted(d_cols)}"
    idx = [d_cols.index(c) for c in cols]
    d_rows = [tuple(r[i] for i in idx) for r in d_raw]
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = normalise(s_rows), normalise(d_rows)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff: spark={x} duck={y}"
    bad_types = type_mismatches(spark_df, con, sql)
    if bad_types:
        return False, "types differ: " + "; ".join(bad_types)
    return True, f"{len(a)} rows"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from parcelwise.plans.registry import ORACLE, QUERIES, load_all
    from parcelwise.session import get_spark
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                ok, msg = compare(df, con, ORACLE[name])
            else:
                ok, msg = True, f"{df.count()} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(names or QUERIES) - bad} ok, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
