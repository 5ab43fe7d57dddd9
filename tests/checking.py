"""Compare a query's rows with those of its SQL."""

import os

import duckdb


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names))) for r in df.collect())


def rows_of_sql(sql: str, folder: str) -> list[str]:
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    relation = con.sql(sql)
    names = sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in at))) for r in relation.fetchall())
