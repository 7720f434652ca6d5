"""Compares a query with its SQL: names, row count and values, order aside."""

import datetime
import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return str(v)


def same(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
