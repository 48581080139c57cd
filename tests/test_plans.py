"""Physical plan shape: pushdown, pruning, no cartesian products, pre-aggregation."""

import re

from pyspark.sql import functions as F

from paths import SF_MID
from cartwheel.operators import cart, catalog, orders, sellers
from cartwheel.plans import registry
from cartwheel.sources.entities import Shop


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_filter_reaches_the_scan(spark):
    s = Shop.from_raw(spark, SF_MID)
    p = plan(orders.order_history(s.orders, s.payments, user_id=42))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,42)]" in p


def test_scan_reads_only_needed_columns(spark):
    s = Shop.from_raw(spark, SF_MID)
    p = plan(orders.orders_unpaid(s.orders, s.payments).select("order_id"))
    assert "ReadSchema: struct<o_orderkey:bigint>" in p


def test_no_cartesian_products_in_registry(spark):
    skip = {"product_search", "product_search_catalogue"}  # terms without a literal character match by wildcards alone
    for name, fn in registry.QUERIES.items():
        if name in skip:
            continue
        p = plan(fn(spark, SF_MID))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_search_joins_literal_terms_on_grams(spark):
    s = Shop.from_raw(spark, SF_MID)
    literal = s.search_terms.where(F.length("term") > 0)
    p = plan(catalog.product_search(s.products, literal))
    assert "HashJoin" in p or "SortMergeJoin" in p


def test_cart_fold_uses_no_window(spark):
    p = plan(cart.fold_cart_events(Shop.from_raw(spark, SF_MID).cart_events))
    assert "Window" not in p
    assert "partial_max" in p or "partial_max_by" in p


def test_stock_update_pre_aggregates(spark):
    p = plan(registry._checkout(spark, SF_MID).stock)
    assert "partial_sum" in p


def test_seller_orders_aggregates_before_join(spark):
    s = Shop.from_raw(spark, SF_MID)
    df = sellers.seller_orders_view(s.orders, s.payments, s.order_items, s.products, s.users)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in logical


def test_hot_pair_join_is_salted(spark):
    """One (user, product) pair holding a third of the events: its adds are
    joined by (pair, salt), whatever the skew settings, and the fold is
    unchanged."""
    from test_model import replay
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ev = Shop.from_raw(spark, SF_MID).cart_events
        third = F.col("event_id") % 3 == 0
        hot = (ev.withColumn("user_id", F.when(third, F.lit(7).cast("long")).otherwise(F.col("user_id")))
                 .withColumn("product_id", F.when(third, F.lit(5).cast("long")).otherwise(F.col("product_id")))
                 .repartition(16))
        df = cart.fold_cart_events(hot)
        got = {(r.user_id, r.product_id): r.quantity for r in df.collect()}
        assert re.search(r"SortMergeJoin[^\n]*_salt", plan(df))
        rows = [tuple(r) for r in hot.select("event_id", "ts", "user_id", "product_id", "op", "value").collect()]
        assert got == replay(rows)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_single_user_page_cuts_payments_first(spark):
    s = Shop.from_raw(spark, SF_MID)
    uid = 42
    page = orders.order_payment(s.orders, s.payments, user_id=uid)
    assert "LeftSemi" in plan(page)
    full = {r.order_id: tuple(r) for r in orders.order_payment(s.orders, s.payments).collect()}
    got = {r.order_id: tuple(r) for r in page.collect()}
    assert got and all(full[k] == v for k, v in got.items())
