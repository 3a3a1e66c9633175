"""Compares a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and df[c].map(lambda v: hasattr(v, "as_tuple")).any():
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(spark_df, sql, c):
    a, b = _plain(c.execute(sql).df()), _plain(spark_df.toPandas())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for k in a.columns:
        same = (a[k] == b[k]) | (a[k].isna() & b[k].isna())
        if not same.all() and a[k].dtype.kind == "f":
            same = same | ((a[k] - b[k]).abs() <= 1e-6 * (1 + a[k].abs()))
        assert same.all(), f"{k}: {a[k][~same].head(3).tolist()} {b[k][~same].head(3).tolist()}"
