"""Runs queries and their SQL on the same tables and compares the rows."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "quantize"):
        return round(float(v), 9)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=str)


def compare(spark, c, query, sql, sf):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = c.execute(sql)
    return got, rows([d[0] for d in want.description], want.fetchall())
