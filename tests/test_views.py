"""SQL access through temp views and bound parameters; defaults filling."""

import datetime as dt

from paths import SF_SMALL
from pyspark.sql import functions as F

from cartwheel.operators import orders, sellers
from cartwheel.plans.views import register_views, rows_of
from cartwheel.sources.entities import Shop, with_defaults


def test_views_and_bound_parameters(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    names = register_views(shop)
    assert {"seller_orders", "order_history", "cart_lines", "users"} <= set(names)
    assert rows_of(spark, "products").count() == shop.products.count()
    assert [r.product_id for r in rows_of(spark, "products", product_id=5).collect()] == [5]
    uid = shop.orders.select("user_id").first().user_id
    raw = rows_of(spark, "order_payment_raw", user_id=uid).count()
    assert raw == orders.order_payment_raw(shop.orders, shop.payments, user_id=uid).count()
    history = rows_of(spark, "order_history", user_id=uid)
    assert history.count() == shop.orders.where(shop.orders.user_id == uid).count()
    # a value is a value, whatever it looks like
    assert rows_of(spark, "users", name="x' OR '1'='1").count() == 0


def test_sort_orders(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    history = [(r.user_id, -r.created_at.timestamp(), -r.order_id) for r in orders.order_history(shop.orders, shop.payments).collect()]
    assert history == sorted(history)
    dated = shop.products.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("product_id") % 7 * 86400))
    rows = [(r.seller_id, -r.created_at.timestamp(), -r.product_id) for r in sellers.seller_products(dated).collect()]
    assert rows == sorted(rows) and len({t for _, t, _ in rows}) > 1
    pending = sellers.seller_pending_orders(shop.orders, shop.order_items, shop.products, shop.users).collect()
    keys = [(r.seller_id, -r.created_at.timestamp(), -r.order_id) for r in pending]
    assert keys == sorted(keys)


def test_with_defaults(spark):
    df = spark.createDataFrame([(1, "x", "d", 1.5, "c", None)],
                               "product_id long, name string, description string, price double, "
                               "category string, image_url string")
    r = with_defaults(df, "products", now=dt.datetime(2024, 1, 1)).collect()[0]
    assert r.stock == 0 and r.image_url == "" and r.created_at == dt.datetime(2024, 1, 1)
    assert r.seller_id is None and str(r.price) == "1.50"


def test_key_lookups_for_any_entity(spark):
    from cartwheel.operators import catalog
    shop = Shop.from_raw(spark, SF_SMALL)
    keys = spark.createDataFrame([(1,), (1,), (2,), (10 ** 9,)], "user_id long")
    found = catalog.rows_by_keys(shop.users, keys, "user_id")
    assert sorted(r.user_id for r in found.collect()) == [1, 2]
    assert [r.user_id for r in catalog.missing_keys(shop.users, keys, "user_id").collect()] == [10 ** 9]
    email = shop.sellers.first().email
    assert catalog.row_by_email(shop.sellers, "  " + email.upper()).count() == 1
