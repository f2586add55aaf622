"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from orrery.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(v) if math.isinf(v) else round(v, 5) + 0.0
    return v


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_sorted_results_are_sorted(spark, small):
    q = catalog.queries()
    rows = [tuple(r) for r in q["sort_stable"](spark, small).select("o_orderpriority", "o_orderkey").collect()]
    assert rows == sorted(rows, key=lambda r: ([-ord(c) for c in r[0]], r[1]))
    top = [r.o_totalprice for r in q["topk"](spark, small).collect()]
    assert top == sorted(top, reverse=True)


def test_plans_prune_and_push(spark, small):
    df = catalog.queries()["flagship_pricing_summary"](spark, small)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_tax" not in plan.split("== Physical Plan ==")[1]
    for name in catalog.queries():
        if not name.startswith("csv"):
            assert "Python" not in catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString(), name
