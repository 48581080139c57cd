"""Registered queries: one per operator group of the blueprint.

Each query takes (spark, sf_dir), builds a ``Shop`` over the raw tables and
returns a DataFrame over the whole tables. ``portable`` is the last step of
every query: it emits money as DOUBLE (computed exactly as DECIMAL and
rounded before the cast) so the cross-engine comparison sees one numeric
representation on both sides.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.operators import cart, catalog, checkout, ingest, orders, quality, sellers
from cartwheel.functions.money import DEFAULT_TAX_RATE
from cartwheel.functions.text import wall_clock
from cartwheel import schemas as S
from cartwheel.plans import views
from cartwheel.session import scratch_path, written
from cartwheel.sources import feeds, tables
from cartwheel.sources.entities import Shop
from cartwheel.sources.incoming import arrivals, incoming_tables, retotalled

# Fixed run parameters: the batch clock of set-based jobs (CURRENT_TIMESTAMP
# as a parameter, so reruns are identical) and the point where the stored
# cart state ends and the next batch of cart events begins.
BATCH_TS = dt.datetime(2024, 2, 1, 0, 0, 0)
CART_SPLIT_TS = dt.datetime(2024, 1, 16, 0, 0, 0)


def portable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(c.cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else c)
    return df.select(*cols)


# Where entity tables come from: nothing set = derive them from the raw
# tables in every query; a path = parquet entity tables written once by
# ``write_entities``; a database = bucketed catalog tables saved by
# ``save_bucketed_entities``. The change feeds always derive from raw tables.
_ENTITY_SOURCE: dict[str, str | None] = {"path": None, "database": None}


def use_entity_tables(path: str | None) -> None:
    _ENTITY_SOURCE.update(path=path, database=None)


def use_entity_catalog(database: str | None) -> None:
    _ENTITY_SOURCE.update(path=None, database=database)


def given_shop(spark: SparkSession, sf_dir: str) -> Shop:
    """The shop over the given tables, its events damaged as the queries expect."""
    return Shop.from_raw(spark, sf_dir, incoming=feeds.dirty_events)


def _shop(spark: SparkSession, sf_dir: str) -> Shop:
    if _ENTITY_SOURCE["database"]:
        return Shop.from_catalog(spark, _ENTITY_SOURCE["database"], sf_dir, incoming=feeds.dirty_events)
    if _ENTITY_SOURCE["path"]:
        return Shop.from_tables(spark, _ENTITY_SOURCE["path"], sf_dir, incoming=feeds.dirty_events)
    return given_shop(spark, sf_dir)


def _tables(shop: Shop) -> dict[str, DataFrame]:
    return {"users": shop.users, "sellers": shop.sellers, "products": shop.products,
            "cart": shop.cart, "orders": shop.orders, "order_items": shop.order_items,
            "payments": shop.payments}


ORDER_OUT = ["order_id", "user_id", "total_amount", "order_status", "created_at",
             "seller_approval_status", "seller_id"]


# Catalogue ------------------------------------------------------------------

def q_products_all(spark, sf):
    return catalog.products_all(_shop(spark, sf).products)


def q_table_counts(spark, sf):
    return catalog.table_counts(_tables(_shop(spark, sf)))


def q_product_lookup(spark, sf):
    s = _shop(spark, sf)
    return catalog.product_lookup(s.products, s.product_changes)


def q_product_search(spark, sf):
    s = _shop(spark, sf)
    return catalog.product_search(s.products, s.search_terms, s.search_index)


def q_featured_products(spark, sf):
    return catalog.featured_products(_shop(spark, sf).products)


def q_product_cards(spark, sf):
    return catalog.product_cards(_shop(spark, sf).products)


# Cart ------------------------------------------------------------------------

def q_cart_state_fold(spark, sf):
    """Always folds the events, also where a folded cart table exists."""
    return cart.with_cart_ids(cart.fold_cart_events(_shop(spark, sf).cart_events), F.lit(0))


def q_cart_lines(spark, sf):
    s = _shop(spark, sf)
    return cart.cart_lines(s.cart, s.products)


def q_cart_totals(spark, sf):
    s = _shop(spark, sf)
    return cart.cart_totals(cart.cart_lines(s.cart, s.products))


def q_cart_upsert(spark, sf):
    """Stored state = fold of the events before the split; the later events
    are applied to it as one batch of upserts / sets / removes / clears."""
    events = _shop(spark, sf).cart_events
    ts = wall_clock(CART_SPLIT_TS)
    state = written(cart.with_cart_ids(cart.fold_cart_events(events.where(F.col("ts") < ts)), F.lit(0)), "cart-state")
    return cart.apply_cart_batch(state, events.where(F.col("ts") >= ts))


def q_cart_stock_check(spark, sf):
    s = _shop(spark, sf)
    return cart.stock_check(s.cart_events.where(F.col("op") == "add"), feeds.listed_products(s.products), s.cart)


def q_cart_event_rejects(spark, sf):
    return feeds.cart_event_rejects(_shop(spark, sf).events)


def q_cart_cascade(spark, sf):
    s = _shop(spark, sf)
    return cart.cascade_cart(s.cart, feeds.known_users(s.users), feeds.listed_products(s.products)).select("user_id", "product_id", "quantity")


# Checkout ----------------------------------------------------------------------

def _checkout(spark, sf, tax_rate=DEFAULT_TAX_RATE) -> checkout.CheckoutResult:
    s = _shop(spark, sf)
    return checkout.checkout(s.cart, s.products, s.orders, s.order_items, s.payments,
                             s.checkout_requests, BATCH_TS, feeds.known_users(s.users), tax_rate)


def q_checkout_orders(spark, sf):
    return _checkout(spark, sf).orders.select(*ORDER_OUT)


def q_checkout_orders_untaxed(spark, sf):
    return _checkout(spark, sf, Decimal(0)).orders.select(*ORDER_OUT)


def q_checkout_lines(spark, sf):
    return _checkout(spark, sf).lines.select("item_id", "order_id", "user_id", "product_id", "quantity", "subtotal")


def q_payments_autocreate(spark, sf):
    s = _shop(spark, sf)
    r = _checkout(spark, sf)
    return checkout.autocreate_payments(r.orders, s.payments, BATCH_TS,
                                        order_base=checkout.max_key(s.orders, "order_id"))


def q_checkout_payments(spark, sf):
    return _checkout(spark, sf).payments


def q_stock_after_checkout(spark, sf):
    return _checkout(spark, sf).stock.select("product_id", "stock")


def q_checkout_cart_after(spark, sf):
    return _checkout(spark, sf).cart_after.select("user_id", "product_id", "quantity")


# Orders --------------------------------------------------------------------------

def q_order_payment_raw(spark, sf):
    s = _shop(spark, sf)
    return orders.order_payment_raw(s.orders, s.payments)


def q_order_payment(spark, sf):
    s = _shop(spark, sf)
    return orders.order_payment(s.orders, s.payments)


def q_order_history(spark, sf):
    s = _shop(spark, sf)
    return orders.order_history(s.orders, s.payments)


def q_order_items_detail(spark, sf):
    s = _shop(spark, sf)
    return orders.order_items_detail(s.order_lines, s.products)


def q_order_history_nested(spark, sf):
    s = _shop(spark, sf)
    n = orders.order_history_nested(s.orders, s.order_lines, s.products)
    return n.select("order_id", "user_id",
                    # size(NULL) is -1 when ANSI mode is off: test for NULL first
                    F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items"))
                     .cast("long").alias("n_items"),
                    orders.items_text("items").alias("items_text"))


def q_orders_unpaid(spark, sf):
    s = _shop(spark, sf)
    return orders.orders_unpaid(s.orders, s.payments).select(*ORDER_OUT)


def q_payments_backfill(spark, sf):
    s = _shop(spark, sf)
    return orders.payments_backfill(s.orders, s.payments, BATCH_TS)


def q_orders_purged(spark, sf):
    s = _shop(spark, sf)
    return orders.orders_purged(s.orders, s.payments).select(*ORDER_OUT)


def q_payment_method_update(spark, sf):
    s = _shop(spark, sf)
    return orders.update_payment_method(s.payments, s.payment_method_changes)


def q_order_status_latest(spark, sf):
    s = _shop(spark, sf)
    return orders.order_status_latest(s.orders, s.status_events)


def _decisions(shop: Shop) -> DataFrame:
    return shop.status_events.where(F.col("kind") == "approval").select(
        "event_id", "ts", "order_id", F.lit(None).cast("long").alias("seller_id"), "value")


def q_seller_decisions(spark, sf):
    s = _shop(spark, sf)
    return orders.seller_decisions(s.orders, _decisions(s))


# Sellers --------------------------------------------------------------------------

def q_seller_products(spark, sf):
    return sellers.seller_products(_shop(spark, sf).products)


def q_seller_pending_orders(spark, sf):
    s = _shop(spark, sf)
    return sellers.seller_pending_orders(s.orders, s.order_lines, s.products, s.users)


def q_seller_dashboard_view(spark, sf):
    s = _shop(spark, sf)
    return sellers.seller_dashboard_view(s.orders, s.payments, s.users)


def q_seller_orders_view(spark, sf):
    s = _shop(spark, sf)
    return sellers.seller_orders_view(s.orders, s.payments, s.order_lines, s.products, s.users)


def q_order_customer_detail(spark, sf):
    s = _shop(spark, sf)
    return sellers.order_customer_detail(s.orders, s.users, s.payments)


def q_product_changes(spark, sf):
    s = _shop(spark, sf)
    return sellers.apply_product_changes(s.products, s.product_changes)[0]


def q_product_change_rejects(spark, sf):
    s = _shop(spark, sf)
    return sellers.apply_product_changes(s.products, s.product_changes)[1]


def q_seller_assign(spark, sf):
    s = _shop(spark, sf)
    sold = s.raw("lineitem").select(F.col("l_partkey").alias("product_id"),
                                    F.col("l_suppkey").alias("seller_id"),
                                    F.col("l_quantity").alias("quantity"))
    return sellers.assign_sellers(s.products, sellers.top_supplier_assignments(sold)) \
        .select("product_id", "seller_id", "previous_seller_id")


def q_registration_ingest(spark, sf):
    s = _shop(spark, sf)
    return ingest.registration_ingest(s.users, s.registrations)[0]


def q_registration_rejects(spark, sf):
    return ingest.registration_rejects(q_registration_ingest(spark, sf))


def q_new_users(spark, sf):
    s = _shop(spark, sf)
    return ingest.registration_ingest(s.users, s.registrations)[1]


def q_user_credentials(spark, sf):
    """The login lookup for every e-mail of the registration feed."""
    s = _shop(spark, sf)
    return catalog.rows_by_email(s.users, s.registrations.select("email")).select("email_key", "user_id", "name")


def q_change_conservation(spark, sf):
    """Rows of each feed and rows accounted for in its outputs."""
    s = _shop(spark, sf)
    report, new_users = (written(df, "conservation") for df in ingest.registration_ingest(s.users, s.registrations))
    outcomes = written(sellers.product_change_outcomes(s.products, s.product_changes), "conservation")
    nxt, rejects = sellers.apply_product_changes(s.products, s.product_changes, outcomes)
    added = nxt.join(s.products.select("product_id"), "product_id", "left_anti")
    kept = outcomes.where(~((F.col("op") == "add") & (F.col("outcome") == "applied"))
                          & F.col("outcome").isin("applied", "superseded"))
    events = s.events
    return quality.conservation({
        "registrations": (s.registrations, [new_users, ingest.registration_rejects(report)]),
        "product_changes": (s.product_changes, [added, kept, rejects]),
        "cart_events": (events.where(F.col("event_type").isin(*feeds.CART_OP_BY_EVENT)),
                        [s.cart_events.where(F.col("product_id").isNotNull() | (F.col("op") == "clear")),
                         feeds.cart_event_rejects(events)])})


def q_orders_of_requesters(spark, sf):
    """Key-filter form for a table of keys: the orders of all users in the
    checkout feed, with their payment."""
    s = _shop(spark, sf)
    return orders.order_payment(catalog.rows_by_keys(s.orders, s.checkout_requests, "user_id"), s.payments)


def q_orders_after_payment_update(spark, sf):
    s = _shop(spark, sf)
    return orders.orders_after_payment_update(s.orders, s.payments, s.payment_method_changes)


def q_seller_assign_listed(spark, sf):
    return sellers.assign_seller_to_listed(_shop(spark, sf).products, (1, 2, 3, 4), 1).select("product_id", "seller_id")


def q_product_search_catalogue(spark, sf):
    """Several hundred terms taken from the catalogue itself."""
    s = _shop(spark, sf)
    return catalog.product_search(s.products, feeds.catalogue_terms(s.raw("part")), s.search_index)


# Data quality --------------------------------------------------------------------

def q_dq_unique(spark, sf):
    return quality.dq_unique(incoming_tables(_tables(_shop(spark, sf))))


def q_dq_foreign_keys(spark, sf):
    return quality.dq_foreign_keys(incoming_tables(_tables(_shop(spark, sf))))


def q_dq_not_null(spark, sf):
    return quality.dq_not_null(incoming_tables(_tables(_shop(spark, sf))))


def q_dq_domain(spark, sf):
    return quality.dq_domain(incoming_tables(_tables(_shop(spark, sf))))


def q_dq_order_totals(spark, sf):
    s = _shop(spark, sf)
    return quality.dq_order_totals(retotalled(s.orders, s.order_lines), s.order_lines)


def _stored_keys(shop: Shop) -> dict[str, DataFrame]:
    """The key columns of the arrivals, stored: every rule reads its tables several times,
    and numbering order items or folding the cart is no part of that."""
    columns = {t: set() for t in quality.PRIMARY_KEYS}
    for _, table, keys in quality.UNIQUE_RULES:
        columns[table].update(keys)
    for _, child, column, parent, key in quality.FOREIGN_KEYS:
        columns[child].add(column)
        columns[parent].add(key)
    return {t: written(df.select(*sorted(columns[t]), "batch_id"), f"arrived-{t}") for t, df in arrivals(_tables(shop)).items()}


def q_dq_unique_batch(spark, sf):
    return quality.dq_unique_batch(_stored_keys(_shop(spark, sf)), 3)


def q_dq_foreign_keys_batch(spark, sf):
    return quality.dq_foreign_keys_batch(_stored_keys(_shop(spark, sf)), 3)


# Stored tables and views that change in place ---------------------------------------

TABLE_BUCKETS = 32


def _stored(spark, df, key) -> str:
    path = scratch_path(spark, "stored-table")
    tables.save_table(df, path, key, TABLE_BUCKETS)
    return path


def q_payment_method_update_in_place(spark, sf):
    s = _shop(spark, sf)
    path, changes = _stored(spark, s.payments, "order_id"), written(s.payment_method_changes, "method-changes")
    tables.change_table(spark, path, S.PAYMENTS, "order_id", TABLE_BUCKETS, changes,
                        lambda payments: orders.update_payment_method(payments, changes))
    return tables.read_table(spark, path, S.PAYMENTS)


def q_product_changes_in_place(spark, sf):
    s = _shop(spark, sf)
    path, changes = _stored(spark, s.products, "product_id"), s.product_changes
    outcomes = written(sellers.product_change_outcomes(s.products, changes), "product-outcomes")
    tables.change_table(spark, path, S.PRODUCTS, "product_id", TABLE_BUCKETS, outcomes,
                        lambda products: sellers.apply_product_changes(products, changes, outcomes)[0])
    return tables.read_table(spark, path, S.PRODUCTS)


def q_seller_dashboard_refreshed(spark, sf):
    """The stored view after the payment method changes: only their orders' rows are
    worked out again."""
    s = _shop(spark, sf)
    entities = {"orders": s.orders, "payments": s.payments, "users": s.users}
    path, changes = scratch_path(spark, "stored-view"), written(s.payment_method_changes, "method-changes")
    views.store_view("seller_dashboard", entities, path, TABLE_BUCKETS)
    entities["payments"] = orders.update_payment_method(s.payments, changes)
    views.refresh_view("seller_dashboard", entities, {"payments": changes.select("order_id")}, path, TABLE_BUCKETS)
    return tables.read_table(spark, path, views.ORDER_VIEWS["seller_dashboard"](entities).schema)


def q_order_history_first_page(spark, sf):
    """Every user's newest three orders."""
    s = _shop(spark, sf)
    return orders.order_history(s.orders, s.payments, last=3)


def q_order_history_parts(spark, sf):
    """Orders' lines in parts of two, in line order."""
    s = _shop(spark, sf)
    n = orders.order_history_nested(s.orders, s.order_lines, s.products, max_items_per_row=2)
    return n.select("order_id", "user_id", "part", orders.items_text("items").alias("items_text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dq_foreign_keys_batch": q_dq_foreign_keys_batch,
    "dq_unique_batch": q_dq_unique_batch,
    "order_history_first_page": q_order_history_first_page,
    "order_history_parts": q_order_history_parts,
    "payment_method_update_in_place": q_payment_method_update_in_place,
    "product_changes_in_place": q_product_changes_in_place,
    "seller_dashboard_refreshed": q_seller_dashboard_refreshed,
    "change_conservation": q_change_conservation,
    "checkout_orders_untaxed": q_checkout_orders_untaxed,
    "new_users": q_new_users,
    "orders_after_payment_update": q_orders_after_payment_update,
    "orders_of_requesters": q_orders_of_requesters,
    "product_search_catalogue": q_product_search_catalogue,
    "registration_rejects": q_registration_rejects,
    "seller_assign_listed": q_seller_assign_listed,
    "user_credentials": q_user_credentials,
    "products_all": q_products_all,
    "table_counts": q_table_counts,
    "product_lookup": q_product_lookup,
    "product_search": q_product_search,
    "featured_products": q_featured_products,
    "product_cards": q_product_cards,
    "cart_state_fold": q_cart_state_fold,
    "cart_lines": q_cart_lines,
    "cart_totals": q_cart_totals,
    "cart_upsert": q_cart_upsert,
    "cart_stock_check": q_cart_stock_check,
    "cart_cascade": q_cart_cascade,
    "cart_event_rejects": q_cart_event_rejects,
    "checkout_orders": q_checkout_orders,
    "checkout_lines": q_checkout_lines,
    "payments_autocreate": q_payments_autocreate,
    "checkout_payments": q_checkout_payments,
    "stock_after_checkout": q_stock_after_checkout,
    "checkout_cart_after": q_checkout_cart_after,
    "order_payment_raw": q_order_payment_raw,
    "order_payment": q_order_payment,
    "order_history": q_order_history,
    "order_items_detail": q_order_items_detail,
    "order_history_nested": q_order_history_nested,
    "orders_unpaid": q_orders_unpaid,
    "payments_backfill": q_payments_backfill,
    "orders_purged": q_orders_purged,
    "payment_method_update": q_payment_method_update,
    "order_status_latest": q_order_status_latest,
    "seller_decisions": q_seller_decisions,
    "seller_products": q_seller_products,
    "seller_pending_orders": q_seller_pending_orders,
    "seller_dashboard_view": q_seller_dashboard_view,
    "seller_orders_view": q_seller_orders_view,
    "order_customer_detail": q_order_customer_detail,
    "product_changes": q_product_changes,
    "product_change_rejects": q_product_change_rejects,
    "seller_assign": q_seller_assign,
    "registration_ingest": q_registration_ingest,
    "dq_unique": q_dq_unique,
    "dq_foreign_keys": q_dq_foreign_keys,
    "dq_not_null": q_dq_not_null,
    "dq_domain": q_dq_domain,
    "dq_order_totals": q_dq_order_totals,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query, batch and stream, wrapped with ``portable``."""
    from cartwheel.streaming.twins import STREAM_QUERIES
    return {name: (lambda spark, sf, f=fn: portable(f(spark, sf))) for name, fn in (QUERIES | STREAM_QUERIES).items()}
