"""Every registered query against its DuckDB oracle (sf0.001: fast)."""

import os
import sys

import pytest

from paths import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import check_oracle as C  # noqa: E402
import __spark_entry__ as E  # noqa: E402
from cartwheel.plans.registry import registered  # noqa: E402

QUERIES = registered()
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return C.duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert C.digest(df.columns, srows)[0] == C.digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "n_lines", "n_units", "subtotal", "tax", "total"]


@pytest.fixture(scope="module")
def entity_tables(spark):
    from cartwheel.plans.registry import given_shop, use_entity_tables
    from cartwheel.session import scratch_path
    from cartwheel.sources.entities import write_entities
    path = scratch_path(spark, "test-oracle-tables")
    write_entities(given_shop(spark, SF_SMALL), path)
    use_entity_tables(path)
    yield path
    use_entity_tables(None)


def test_all_queries_on_entity_tables_match_oracle(spark, con, entity_tables):
    """The same queries over entity tables written once (bench default mode)."""
    bad = []
    for name, fn in QUERIES.items():
        df = fn(spark, SF_SMALL)
        s = C.digest(df.columns, [tuple(r) for r in df.collect()])[0]
        cur = con.execute(SQL[name])
        d = C.digest([x[0] for x in cur.description], cur.fetchall())[0]
        if s != d:
            bad.append(name)
    assert bad == []


def test_all_queries_on_bucketed_catalog_match_oracle(spark, con):
    from cartwheel.plans.registry import given_shop, use_entity_catalog
    from cartwheel.session import scratch_path
    from cartwheel.sources.entities import save_bucketed_entities
    save_bucketed_entities(given_shop(spark, SF_SMALL), "cw_oracle_catalog",
                           scratch_path(spark, "test-oracle-catalog"), buckets=4)
    use_entity_catalog("cw_oracle_catalog")
    try:
        bad = []
        for name, fn in QUERIES.items():
            df = fn(spark, SF_SMALL)
            s = C.digest(df.columns, [tuple(r) for r in df.collect()])[0]
            cur = con.execute(SQL[name])
            d = C.digest([x[0] for x in cur.description], cur.fetchall())[0]
            if s != d:
                bad.append(name)
        assert bad == []
    finally:
        use_entity_catalog(None)
