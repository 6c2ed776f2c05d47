"""Row-by-row comparison of a Spark result with DuckDB's, whatever their order."""

import collections
import datetime
import decimal

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, list | tuple):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), canon(x)) for k, x in v.items()))
    if isinstance(v, bool | str):
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v if isinstance(v, int) else str(v)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in RAW:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = collections.Counter(tuple(canon(r[c]) for c in columns) for r in df.collect())
    got = con.sql(sql)
    names = list(got.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = collections.Counter(tuple(canon(r[i]) for i in at) for r in got.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return sum(ours.values())
