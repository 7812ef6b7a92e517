"""Every query of the core runs on the smallest tables, and equals its SQL twin where it has one."""

import math
from collections import Counter

import pandas as pd
import pytest

from bankspark.plans import registry

QUERIES = {k: f for m in registry.modules() for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in registry.modules() for k, q in m.ORACLE.items()}


def plain(v):
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, pd.Timestamp):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    rows = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLE:
        twin = duck.sql(ORACLE[name])
        assert sorted(twin.columns) == columns
        where = [twin.columns.index(c) for c in columns]
        assert rows == Counter(repr([plain(r[i]) for i in where]) for r in twin.fetchall())


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
