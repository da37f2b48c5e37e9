"""Every query that SQL can state, against its DuckDB twin on the smallest tables; every other query runs."""

import math

import pytest

from citeloom.plans import registry

NAMES = sorted(registry.QUERIES)
SLOW: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", [n for n in NAMES if registry.QUERIES[n][1]])
def test_twin(spark, duck, sf, name):
    query, sql = registry.QUERIES[name]
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) < 2e-6), (g, w)


@pytest.mark.parametrize("name", [n for n in NAMES if not registry.QUERIES[n][1] and n not in SLOW])
def test_runs(spark, sf, name):
    df = registry.QUERIES[name][0](spark, sf)
    assert df.columns and df.limit(5).collect() is not None
