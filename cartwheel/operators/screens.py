"""One call per screen of the shop, built from the set-based operators with a
key filter (pushed into the scans). These are what a user of the shop runs
for one user, order or seller; the registered queries run the same
operators over all keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.money import DEFAULT_TAX_RATE
from cartwheel.operators import cart as C
from cartwheel.operators import catalog, orders, sellers
from cartwheel.sources.entities import Shop


def home(shop: Shop, n: int = 4) -> DataFrame:
    """Featured products with their card fields."""
    top = catalog.featured_products(shop.products, n).select("product_id")
    return catalog.product_cards(shop.products).join(top, "product_id", "left_semi")


def search(shop: Shop, term: str) -> DataFrame:
    """Product list for one search term (empty term: every product)."""
    terms = shop.spark.range(1).select(F.lit(term or "").alias("term"))
    hits = catalog.product_search(shop.products, terms, shop.search_index).select("product_id")
    return catalog.product_cards(shop.products).join(hits, "product_id", "left_semi")


def product_page(shop: Shop, product_id: int) -> DataFrame:
    return catalog.product_cards(catalog.product_by_id(shop.products, product_id))


def cart_page(shop: Shop, user_id: int, tax_rate: Decimal = DEFAULT_TAX_RATE) -> tuple[DataFrame, DataFrame]:
    """(lines, totals) of one user's cart."""
    lines = C.cart_lines(shop.cart.where(F.col("user_id") == F.lit(user_id)), shop.products)
    return lines, C.cart_totals(lines, tax_rate)


def checkout_preview(shop: Shop, user_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, totals, customer) shown before placing the order."""
    lines, totals = cart_page(shop, user_id)
    return lines, totals, shop.users.where(F.col("user_id") == F.lit(user_id))


def order_confirmation(shop: Shop, order_id: int, user_id: int) -> tuple[DataFrame, DataFrame]:
    """(header with latest payment, lines) of one order of one user."""
    header = orders.order_payment(shop.orders, shop.payments, order_id=order_id, user_id=user_id)
    lines = orders.order_items_detail(shop.order_items, shop.products, order_id=order_id) \
        .join(header.select("order_id"), "order_id", "left_semi")
    return header, lines


def order_history_page(shop: Shop, user_id: int) -> DataFrame:
    """A user's orders, newest first, each with its lines."""
    nested = orders.order_history_nested(shop.orders, shop.order_items, shop.products, user_id=user_id)
    hist = orders.order_history(shop.orders, shop.payments, user_id=user_id)
    return hist.join(nested.select("order_id", "items"), "order_id", "left") \
        .orderBy(F.desc("created_at"), F.desc("order_id"))


def seller_dashboard(shop: Shop, seller_id: int) -> tuple[DataFrame, DataFrame]:
    """(own products newest first, pending orders containing them)."""
    return (sellers.seller_products(shop.products, seller_id=seller_id),
            sellers.seller_pending_orders(shop.orders, shop.order_items, shop.products, shop.users,
                                          seller_id=seller_id))


def seller_order_page(shop: Shop, order_id: int) -> tuple[DataFrame, DataFrame]:
    """(order with customer and latest payment, lines) for the seller page."""
    header = sellers.order_customer_detail(shop.orders, shop.users, shop.payments, order_id=order_id)
    lines = orders.order_items_detail(shop.order_items, shop.products, order_id=order_id)
    return header, lines
