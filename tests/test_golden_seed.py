"""Hand-computed results on the shop's seed rows (FIXTURES.md §2)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

import seed
from cartwheel.functions import text as tx
from cartwheel.operators import cart, catalog, checkout, quality, sellers


def _lines(spark, c):
    return cart.cart_lines(c, seed.products(spark))


def test_cart_totals(spark):
    c = seed.cart(spark).where("user_id = 1")
    r = cart.cart_totals(_lines(spark, c)).collect()[0]
    assert (r.subtotal, r.tax, r.total) == (D("1799.98"), D("180.00"), D("1979.98"))


def test_upsert_then_set(spark):
    ev = seed.events(spark, [(1, 1, 3, "add", 2), (2, 1, 3, "set", 5)])
    nxt = cart.apply_cart_batch(seed.cart(spark), ev)
    q = {(r.user_id, r.product_id): r.quantity for r in nxt.collect()}
    assert q[(1, 3)] == 5
    t = cart.cart_totals(_lines(spark, nxt.where("user_id = 1"))).collect()[0]
    assert (t.subtotal, t.tax, t.total) == (D("8299.93"), D("829.99"), D("9129.92"))


def test_upsert_twice_adds(spark):
    ev = seed.events(spark, [(1, 1, 3, "add", 2), (2, 1, 3, "add", 2)])
    q = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    assert q[(1, 3)] == 4


def test_set_zero_removes_and_set_missing_inserts_nothing(spark):
    ev = seed.events(spark, [(1, 1, 3, "add", 2), (2, 1, 3, "set", 0), (3, 1, 5, "set", 5)])
    keys = {(r.user_id, r.product_id) for r in cart.fold_cart_events(ev).collect()}
    assert (1, 3) not in keys and (1, 5) not in keys


def test_negative_add_keeps_line(spark):
    ev = seed.events(spark, [(1, 1, 3, "add", 2), (2, 1, 3, "add", -5)])
    q = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    assert q[(1, 3)] == -3


def test_clear_then_add(spark):
    ev = seed.events(spark, [(1, 1, 3, "add", 2), (2, 1, 4, "add", 1), (3, 1, None, "clear", None),
                             (4, 1, 4, "add", 7)])
    q = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    assert q == {(1, 4): 7}


def _checkout(spark, tax=D("0.1")):
    # user 2's cart and request are there, but no such user: no order
    req = spark.createDataFrame([(1, 1, "PayPal"), (2, 1, None), (3, 2, None)], "request_id long, user_id long, payment_method string")
    return checkout.checkout(seed.cart(spark), seed.products(spark), seed.orders(spark), seed.order_items(spark),
                             seed.payments(spark), req, dt.datetime(2024, 3, 6), seed.users(spark), tax_rate=tax)


def test_checkout_user_1(spark):
    r = _checkout(spark)
    o = r.orders.collect()
    assert [(x.order_id, x.user_id, x.total_amount, x.order_status) for x in o] == [(3, 1, D("1979.98"), "Processing")]
    assert sorted((x.order_id, x.subtotal) for x in r.lines.collect()) == [(3, D("799.99")), (3, D("999.99"))]
    p = r.payments.collect()
    assert [(x.payment_id, x.order_id, x.amount, x.payment_status, x.payment_method) for x in p] == \
        [(3, 3, D("1979.98"), "Pending", "Not Specified")]
    stock = {x.product_id: x.stock for x in r.stock.collect()}
    assert stock[1] == 49 and stock[2] == 44 and stock[4] == 60
    assert {x.user_id for x in r.cart_after.collect()} == {2}


def test_checkout_without_tax(spark):
    assert _checkout(spark, D("0")).orders.collect()[0].total_amount == D("1799.98")


def test_order_totals_check(spark):
    r = {x.order_id: x.total_check for x in quality.dq_order_totals(seed.orders(spark), seed.order_items(spark)).collect()}
    assert r == {1: "equal", 2: "equal"}


def _search(spark, term):
    terms = spark.createDataFrame([(term,)], "term string")
    return sorted(r.product_id for r in catalog.product_search(seed.products(spark), terms).collect())


def test_search(spark):
    assert _search(spark, "pro") == [1, 3, 8, 11]
    assert _search(spark, "phone") == [1, 2, 4]
    assert _search(spark, "") == list(range(1, 13))


def test_seller_1_pending_orders(spark):
    users = seed.users(spark).unionByName(spark.createDataFrame(
        [(2, "Bob", "bob@example.com", "x", "1", None)], seed.S.USERS))
    r = sellers.seller_pending_orders(seed.orders(spark), seed.order_items(spark), seed.products(spark), users, 1)
    assert sorted(x.order_id for x in r.collect()) == [1, 2]
    r1 = sellers.seller_pending_orders(seed.orders(spark), seed.order_items(spark), seed.products(spark),
                                       seed.users(spark), 1)
    assert sorted(x.order_id for x in r1.collect()) == [1]


def test_delivery_estimate_text(spark):
    df = spark.createDataFrame([(seed.T0,)], "ts timestamp_ntz")
    r = df.select(tx.long_datetime("ts").alias("a"), tx.delivery_estimate("ts").alias("b")).collect()[0]
    assert (r.a, r.b) == ("March 05, 2024 02:07 PM", "March 08, 2024")


def test_foreign_keys_and_unique_cart(spark):
    tables = {"users": seed.users(spark), "sellers": seed.sellers(spark), "products": seed.products(spark),
              "cart": seed.cart(spark, with_repeat=True), "orders": seed.orders(spark),
              "order_items": seed.order_items(spark), "payments": seed.payments(spark)}
    fk = {r.rule: r.orphan_rows for r in quality.dq_foreign_keys(tables).collect()}
    assert fk["cart_user"] == 2 and fk["orders_user"] == 1 and fk["payments_user"] == 1
    uq = {r.rule: (r.duplicate_keys, r.excess_rows) for r in quality.dq_unique(tables).collect()}
    assert uq["cart_user_product"] == (3, 3)


def test_product_changes_owner_rules(spark):
    ch = spark.createDataFrame([
        (1, "edit", 1, 1, "iPhone 14", None, D("1099.99"), None, None),
        (2, "edit", 2, 2, "hijack", None, None, None, None),
        (3, "delete", 3, 1, None, None, None, None, None),
        (4, "delete", 4, 2, None, None, None, None, None),
        (5, "add", 13, 1, "Pixel", "phone", D("499.00"), "Electronics", None),
        (6, "add", 14, 1, "NoCat", "x", D("1.00"), None, None),
        (7, "add", None, 1, "Keyless", "x", D("2.00"), "Home", None),
        (8, "add", 13, 1, "Pixel again", "phone", D("1.00"), "Electronics", None),
        (9, "EDIT", 1, 1, "shouted", None, None, None, None),
        (10, "edit", 3, 1, "deleted anyway", None, None, None, None),
    ], seed.S.PRODUCT_CHANGES)
    nxt, rej = sellers.apply_product_changes(seed.products(spark), ch)
    rows = {r.product_id: r for r in nxt.collect()}
    assert rows[1].name == "iPhone 14" and rows[1].price == D("1099.99")
    assert rows[2].name == "Samsung Galaxy S21"
    assert 3 not in rows and 4 in rows
    assert rows[13].stock == 0 and rows[13].name == "Pixel" and rows[15].name == "Keyless" and len(rows) == 13
    assert {(r.change_id, r.reason) for r in rej.collect()} == {
        (2, "not_owner_or_missing"), (4, "not_owner_or_missing"), (6, "missing_category"),
        (8, "duplicate_key"), (9, "unknown_op")}


def test_literal_seller_assign(spark):
    p = seed.products(spark).withColumn("seller_id", F.lit(None).cast("long"))
    r = sellers.assign_seller_to_listed(p, [1, 2, 3, 4], 1)
    assert sorted(x.product_id for x in r.where("seller_id = 1").collect()) == [1, 2, 3, 4]
