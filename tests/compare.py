"""Run registered queries in Spark and in DuckDB and compare the values."""

import math

import duckdb


def connect(sf_dir):
    from cinderview.plans.fixtures import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return ("f", str(v))
        return ("f", repr(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_plain(x) for x in v))
    return ("s", str(v))


def rows_of_spark(df):
    cols = sorted(df.columns)
    picked = df.select(*[f"`{c}`" for c in cols])
    return cols, [tuple(_plain(x) for x in r) for r in picked.collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]


def differences(spark_df, con, sql):
    """Empty text when equal, else a short description."""
    sc, sr = rows_of_spark(spark_df)
    dc, dr = rows_of_duck(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    a, b = sorted(map(repr, sr)), sorted(map(repr, dr))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        return f"{len(sa - sb)} rows differ, e.g.\n  {sorted(sa - sb)[:2]}\n  {sorted(sb - sa)[:2]}"
    return ""
