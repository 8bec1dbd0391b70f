"""Comparison of a query's rows with those of its SQL in DuckDB."""
import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    return sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def check(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns, want = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
