"""SQL access: the entity tables and the engine's own operators as temp views,
read with ``spark.sql`` or, for one key, through ``rows_of`` (a bound parameter,
never a value formatted into the text). Catalyst pushes the key filter through
the operator's plan into the scans.

``store_view`` and ``refresh_view`` keep a seller view as a stored table: after a
batch of changes the rows of the orders it concerns are taken back and put in
again; no other order is read or worked out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.operators import cart, catalog, orders, sellers
from cartwheel.sources import tables
from cartwheel.sources.entities import Shop

TABLES = ("users", "sellers", "products", "cart", "orders", "order_items", "payments")


def operator_views(shop: Shop) -> dict[str, DataFrame]:
    """The operators that answer page reads, by view name."""
    return {
        "seller_dashboard": sellers.seller_dashboard_view(shop.orders, shop.payments, shop.users),
        "seller_orders": sellers.seller_orders_view(shop.orders, shop.payments, shop.order_items, shop.products, shop.users),
        "cart_lines": cart.cart_lines(shop.cart, shop.products),
        "order_payment_raw": orders.order_payment_raw(shop.orders, shop.payments),
        "order_history": orders.order_history(shop.orders, shop.payments),
        "seller_products": sellers.seller_products(shop.products),
        "product_cards": catalog.product_cards(shop.products),
    }


def register_views(shop: Shop) -> list[str]:
    """Register the tables and ``operator_views`` as temp views."""
    frames = {name: getattr(shop, name) for name in TABLES} | operator_views(shop)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


def rows_of(spark: SparkSession, view: str, **keys) -> DataFrame:
    """Rows of a registered view for given key values."""
    where = " AND ".join(f"IDENTIFIER(:col_{k}) = :{k}" for k in keys) or "true"
    return spark.sql(f"SELECT * FROM IDENTIFIER(:view) WHERE {where}",
                     args={"view": view} | {f"col_{k}": k for k in keys} | keys)


# Stored views -------------------------------------------------------------------

def _dashboard(t: dict[str, DataFrame]) -> DataFrame:
    return sellers.seller_dashboard_view(t["orders"], t["payments"], t["users"])


def _seller_orders(t: dict[str, DataFrame]) -> DataFrame:
    return sellers.seller_orders_view(t["orders"], t["payments"], t["order_items"], t["products"], t["users"])


#: Views with one or more rows per order, by name.
ORDER_VIEWS = {"seller_dashboard": _dashboard, "seller_orders": _seller_orders}


def concerned_orders(entities: dict[str, DataFrame], changed: dict[str, DataFrame]) -> DataFrame:
    """order_id of every order that a view row may have to change for. ``changed``:
    per table the keys of its changed rows: order_id for orders, order_items and
    payments, user_id for users, product_id for products."""
    direct = [changed[t].select("order_id") for t in ("orders", "order_items", "payments") if t in changed]
    if "users" in changed:
        direct.append(entities["orders"].join(changed["users"].select("user_id").distinct(), "user_id", "left_semi").select("order_id"))
    if "products" in changed:
        direct.append(entities["order_items"].join(changed["products"].select("product_id").distinct(), "product_id", "left_semi")
                      .select("order_id"))
    return reduce(DataFrame.unionByName, direct).where(F.col("order_id").isNotNull()).distinct()


def store_view(name: str, entities: dict[str, DataFrame], path: str, buckets: int) -> None:
    """Work the view out and store it by order."""
    tables.save_table(ORDER_VIEWS[name](entities), path, "order_id", buckets)


def refresh_view(name: str, entities: dict[str, DataFrame], changed: dict[str, DataFrame], path: str, buckets: int) -> list[int]:
    """Bring a stored view up to ``entities`` (the tables as they are now, by name)
    after the rows in ``changed``; returns the buckets written. Only the concerned
    orders' rows of orders, payments and lines go through the view's joins."""
    spark = entities["orders"].sparkSession
    concerned = concerned_orders(entities, changed)
    part = dict(entities) | {t: entities[t].join(concerned, "order_id", "left_semi") for t in ("orders", "payments", "order_items") if t in entities}
    fresh = ORDER_VIEWS[name](part)
    return tables.change_table(spark, path, fresh.schema, "order_id", buckets, concerned,
                               lambda old: old.join(concerned, "order_id", "left_anti").unionByName(fresh))
