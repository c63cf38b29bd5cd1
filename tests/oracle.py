"""Order-insensitive comparison of a Spark query with its SQL in DuckDB."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 9)) if not float(v).is_integer() else str(int(v)) if abs(v) < 1e15 else repr(float(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False))


def same(spark_df, sql, con):
    got, want = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    assert not wrong, wrong[:3]
