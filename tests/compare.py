"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if pd.api.types.is_numeric_dtype(df[k]) and not pd.api.types.is_bool_dtype(df[k]):
            df[k] = df[k].astype(float).fillna(-9e99)
        else:
            df[k] = df[k].map(lambda v: "~" if v is None or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, sql_df):
    pd.testing.assert_frame_equal(normal(spark_df), normal(sql_df), check_dtype=False, rtol=1e-7, atol=2e-6)
