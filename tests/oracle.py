"""Compare a query with its SQL twin on the same files."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else f"{v:.9g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))


def same(spark_df, con, sql):
    a, b = rows(spark_df.toPandas()), rows(con.sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    differ = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not differ, differ[:3]
