"""Small helpers: integer parsing with rejects, cluster sizing, money text."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from cartwheel.functions.keys import dense_ids
from cartwheel.functions.money import money_text, tax_amount, total_with_tax
from cartwheel.operators.ingest import parse_int
from cartwheel.session import recommended_conf


def test_parse_int_routes_bad_text_to_null_or_default(spark):
    df = spark.createDataFrame([("5",), (" 7 ",), ("x",), ("2.5",), (None,)], "q string")
    got = [tuple(r) for r in df.select(parse_int("q").alias("a"), parse_int("q", 1).alias("b")).collect()]
    assert got == [(5, 5), (7, 7), (None, 1), (None, 1), (None, 1)]


def test_recommended_conf_sizes_partitions():
    conf = recommended_conf(100 * 2 ** 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert recommended_conf(1 << 20, 64)["spark.sql.shuffle.partitions"] == "128"
    assert conf["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"


def test_money_rounding_half_up(spark):
    df = spark.createDataFrame([(D("1799.98"),), (D("2.675"),), (D("0.05"),)], "s decimal(18,3)")
    rows = df.select(tax_amount(F.col("s")).alias("t"), total_with_tax(F.col("s")).alias("g"),
                     money_text("s").alias("m")).collect()
    assert [(r.t, r.g, r.m) for r in rows] == [
        (D("180.00"), D("1979.98"), "₹1799.98"), (D("0.27"), D("2.94"), "₹2.68"), (D("0.01"), D("0.06"), "₹0.05")]


def test_cart_event_rejects_flag_unparsable_products(spark):
    import datetime as dt
    from cartwheel.sources.feeds import cart_event_rejects, cart_events_from_raw
    from cartwheel.sources.raw import RAW_SCHEMAS
    t = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(1, t, 5, "click", 1.0, '{"k": 3}'), (2, t, 5, "click", 1.0, '{"k": "x"}'),
                                 (3, t, 5, "view", 2.0, "not json"), (4, t, 5, "purchase", 0.0, "not json")],
                                RAW_SCHEMAS["events"])
    assert sorted(r.event_id for r in cart_event_rejects(raw).collect()) == [2, 3]
    assert sorted((r.event_id, r.product_id) for r in cart_events_from_raw(raw).collect()) == \
        [(1, 3), (2, None), (3, None), (4, None)]


def test_every_constraint_is_broken_somewhere():
    """The reports would be green on clean data whatever they did. (That the
    engine reports the same rows is what the oracle test checks.)"""
    import os
    import sys
    from paths import ROOT, SF_MID
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    import check_oracle
    from cartwheel.plans.oracle import SQL
    con = check_oracle.duck(SF_MID)
    for query in ("dq_unique", "dq_foreign_keys", "dq_not_null", "dq_domain"):
        assert all(row[-1] > 0 for row in con.execute(SQL[query]).fetchall()), query
    classes = {row[-1] for row in con.execute(SQL["dq_order_totals"]).fetchall()}
    assert {"equal", "with_tax", "mismatch"} <= classes


def test_ids_join_on_no_computed_key(spark):
    """A join key computed from the id column let the optimizer derive a filter for the side without that column."""
    rows = spark.range(100).select(F.when(F.col("id") >= 0, F.col("id")).alias("k"))
    ids = dense_ids(rows, "k", F.lit(0), "n", bucket_width=30)
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Filter isnotnull(aggregate" not in plan
    assert sorted(map(tuple, ids.collect())) == [(k, k + 1) for k in range(100)]
