"""Side-by-side comparison of a query with its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(c, sql, cols):
    rel = c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in cols)} FROM ({sql}) AS q")
    return Counter(tuple(map(plain, r)) for r in rel.fetchall())
