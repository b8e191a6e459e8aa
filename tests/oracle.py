"""Run a query and its SQL on a data folder and compare the rows."""

import math
from pathlib import Path

import duckdb


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return str(v)


def same(spark, folder, query, sql):
    db = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    r = db.execute(sql)
    there = [c[0] for c in r.description]
    order = sorted(df.columns)
    assert order == sorted(there)
    mine = sorted([canon(x[c]) for c in order].__repr__() for x in df.collect())
    other = sorted([canon(x[there.index(c)]) for c in order].__repr__() for x in r.fetchall())
    assert mine == other
