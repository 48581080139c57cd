"""Materialised entity tables and the all-or-nothing checkout writer."""

import os

import pytest

from paths import SF_SMALL
from cartwheel.operators import checkout, orders
from cartwheel.plans import registry
from cartwheel.session import local_fs_path, scratch_path
from cartwheel.sources.entities import Shop, write_entities


def test_materialised_entities_answer_the_same(spark):
    raw = Shop.from_raw(spark, SF_SMALL)
    out = scratch_path(spark, "test-entities")
    write_entities(raw, out)
    stored = Shop.from_tables(spark, out, SF_SMALL)
    for name in ("users", "products", "orders", "payments", "cart"):
        a = sorted(map(tuple, getattr(raw, name).collect()))
        b = sorted(map(tuple, getattr(stored, name).collect()))
        assert a == b, name
    q_raw = orders.order_history(raw.orders, raw.payments)
    q_stored = orders.order_history(stored.orders, stored.payments)
    assert sorted(map(tuple, q_raw.collect())) == sorted(map(tuple, q_stored.collect()))
    assert "PushedFilters" in q_stored._jdf.queryExecution().executedPlan().toString()


def test_checkout_writer_publishes_all_or_nothing(spark):
    s = Shop.from_raw(spark, SF_SMALL)
    r = checkout.checkout(s.cart, s.products, s.orders, s.order_items, s.payments, s.checkout_requests,
                          registry.BATCH_TS, s.users)
    out = scratch_path(spark, "test-checkout")
    first, run = checkout.write_checkout(r, out), checkout.write_checkout(r, out)      # a retry doesn't meet the first run
    assert first != run and set(os.listdir(local_fs_path(run))) >= {*checkout.CHECKOUT_TABLES, "_PUBLISHED"}
    tables = checkout.read_checkout(spark, run)
    assert tables["lines"].columns == ["item_id", "order_id", "product_id", "quantity", "subtotal"]
    assert tables["orders"].count() == r.orders.count()
    os.rename(os.path.join(local_fs_path(first), "_PUBLISHED"), os.path.join(local_fs_path(first), "x"))
    with pytest.raises(Exception):
        checkout.read_checkout(spark, first)


def test_bucketed_tables_join_without_shuffle(spark):
    from cartwheel.sources.entities import save_bucketed_entities
    raw = Shop.from_raw(spark, SF_SMALL)
    location = scratch_path(spark, "test-bucketed")
    save_bucketed_entities(raw, "cw_bucketed_test", location, buckets=8)
    shop = Shop.from_catalog(spark, "cw_bucketed_test", SF_SMALL)
    joined = shop.orders.join(shop.payments, "order_id").join(shop.order_items, "order_id")
    # at test size Spark would broadcast; turn that off to see the big-table plan
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning" not in plan
    want = raw.orders.join(raw.payments, "order_id").join(raw.order_items, "order_id")
    assert joined.count() == want.count()
    q = orders.order_payment(shop.orders, shop.payments)
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, orders.order_payment(raw.orders, raw.payments).collect()))
