"""Compares a Spark result with its DuckDB twin, whatever the order of rows and columns."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def canonical(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = (out[c].dt.tz_localize(None) if out[c].dt.tz is not None else out[c]).astype("datetime64[us]").astype(str)
    return sorted(tuple("NULL" if x is None or x != x else repr(x.item()) if hasattr(x, "item") else str(x) for x in r) for r in out.itertuples(index=False, name=None))


def check(spark, c, name, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), c.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns), name
    assert canonical(mine) == canonical(theirs), name
