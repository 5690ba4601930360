"""Compares a Spark result with the same query in DuckDB: columns by name, types by kind, rows in any order."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, dict) or hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted((x if isinstance(x, dict) else x.asDict()).items()))
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(name):
    name = name.lower().replace("[]", "").split("(")[0]
    return {"tinyint": "int", "smallint": "int", "integer": "int", "bigint": "long", "hugeint": "huge", "varchar": "string", "float": "float"}.get(name, name)


def same(df, sql, sf_dir):
    found = duck(sf_dir).execute(sql)
    columns, types = [d[0] for d in found.description], [str(d[1]) for d in found.description]
    expected = bag(columns, found.fetchall())
    got = bag(df.columns, df.collect())
    assert sorted(df.columns) == sorted(columns)
    spark_types = {name: {"bigint": "long"}.get(t, t) for name, t in df.dtypes}
    for c, t in zip(columns, types, strict=True):
        if "[" not in t and "STRUCT" not in t:
            assert spark_types[c] == kind(t), f"{c}: {spark_types[c]} here, {t} there"
    assert len(got) == len(expected), f"{len(got)} rows, not {len(expected)}"
    for a, b in zip(got, expected, strict=True):
        assert a == b
    return len(got)
