"""Comparison of a Spark result with DuckDB's over the same Parquet tables."""

import datetime
import math
from pathlib import Path

import duckdb


def connect(root: str):
    con = duckdb.connect()
    for f in Path(root).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def table(rows, cols):
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def same_as_sql(df, con, sql):
    cur = con.execute(sql)
    theirs, names = cur.fetchall(), [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    mine = table([tuple(r) for r in df.collect()], df.columns)
    assert mine == table(theirs, names)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
