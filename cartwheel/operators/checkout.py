"""Checkout as one set-based dataflow.

The shop checks out one user per request with 2n+5 statements. Here every
requesting user checks out at once: a shared priced-lines DataFrame feeds five
outputs -- new orders, their lines, their payments, product stock and the
remaining cart. Order, line and payment ids continue the existing key ranges
(AUTO_INCREMENT) via ``dense_ids``; the batch timestamp is a parameter so a
rerun reproduces the same rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions.keys import dense_ids, max_key
from cartwheel.functions.money import DEFAULT_TAX_RATE, total_with_tax
from cartwheel.functions.text import wall_clock
from cartwheel.operators.cart import cart_lines


CHECKOUT_TABLES = ("orders", "lines", "payments", "stock", "cart_after")


@dataclass
class CheckoutResult:
    priced: DataFrame
    orders: DataFrame
    lines: DataFrame
    payments: DataFrame
    stock: DataFrame
    cart_after: DataFrame


def new_orders(priced: DataFrame, orders: DataFrame, batch_ts: dt.datetime,
               tax_rate: Decimal = DEFAULT_TAX_RATE, order_items: DataFrame | None = None) -> DataFrame:
    """One order per user with priced lines: total = subtotal * (1 + tax),
    status Processing, ids after max(order_id) in user order. With
    ``order_items`` the same pass also yields ``_first_item``: the item id
    before the order's first line (line ids continue max(item_id))."""
    buyers = priced.groupBy("user_id").agg(
        F.sum("line_subtotal").cast(S.MONEY_CALC).alias("subtotal"),
        F.min("seller_id").alias("seller_id"), F.count(F.lit(1)).alias("_n_lines"))
    sums = {"_first_item": (max_key(order_items, "item_id"), "_n_lines")} if order_items is not None else {}
    with_ids = dense_ids(buyers, "user_id", max_key(orders, "order_id"), "order_id", sums=sums)
    extra = ["_first_item"] if sums else []
    return with_ids.select(
        "order_id", "user_id", total_with_tax(F.col("subtotal"), tax_rate).alias("total_amount"),
        F.lit(S.CHECKOUT_ORDER_STATUS).alias("order_status"), wall_clock(batch_ts).alias("created_at"),
        F.lit(S.DEFAULT_APPROVAL_STATUS).alias("seller_approval_status"), "seller_id", *extra)


def new_order_lines(priced: DataFrame, placed: DataFrame) -> DataFrame:
    """Lines of the new orders; item ids continue after each order's
    ``_first_item`` in product order (a window per order, no global pass)."""
    lines = priced.join(placed.select("user_id", "order_id", "_first_item"), "user_id")
    in_order = Window.partitionBy("order_id").orderBy("product_id")
    return lines.select(
        (F.col("_first_item") + F.row_number().over(in_order)).cast("long").alias("item_id"),
        "order_id", "product_id", "quantity", F.col("line_subtotal").alias("subtotal"),
        # user_id rides along for reporting; ORDER_ITEMS columns are the first five
        "user_id")


def autocreate_payments(placed: DataFrame, payments: DataFrame | None, batch_ts=None,
                        order_base: F.Column | None = None) -> DataFrame:
    """AFTER INSERT ON orders: a Pending / Not Specified payment per new order.
    Payment ids continue after max(payment_id). When the new orders' ids are
    known to be dense after ``order_base`` (checkout), the payment id follows
    by arithmetic; otherwise a dense-id pass over order_id assigns them."""
    base = max_key(payments, "payment_id") if payments is not None else F.lit(0).cast("long")
    ts = wall_clock(batch_ts) if batch_ts is not None else F.col("created_at")
    cols = placed.select("order_id", "user_id", "total_amount", "created_at")
    if order_base is not None:
        keyed = cols.withColumn("payment_id", (base + F.col("order_id") - order_base).cast("long"))
    else:
        keyed = dense_ids(cols, "order_id", base, "payment_id")
    return keyed.select("payment_id", "order_id", "user_id", F.col("total_amount").alias("amount"),
                        F.lit(S.DEFAULT_PAYMENT_STATUS).alias("payment_status"),
                        F.lit(S.DEFAULT_PAYMENT_METHOD).alias("payment_method"), ts.alias("created_at"))


def stock_after(products: DataFrame, priced: DataFrame) -> DataFrame:
    """stock - ordered quantity, pre-aggregated per product so many buyers of
    one product all count (a joined UPDATE would apply only one of them)."""
    ordered = priced.groupBy("product_id").agg(F.sum("quantity").alias("_ordered"))
    return (products.join(ordered, "product_id", "left")
            .withColumn("stock", (F.col("stock") - F.coalesce(F.col("_ordered"), F.lit(0))).cast("int"))
            .drop("_ordered"))


def checkout(cart: DataFrame, products: DataFrame, orders: DataFrame, order_items: DataFrame,
             payments: DataFrame, requests: DataFrame, batch_ts: dt.datetime, users: DataFrame,
             tax_rate: Decimal = DEFAULT_TAX_RATE) -> CheckoutResult:
    """``requests``: (request_id, user_id, payment_method) of users submitting
    checkout; a user's last request counts. Users that don't exist, and users
    whose cart has no priced line (empty cart), place no order."""
    req = requests.groupBy("user_id").agg(F.max_by("payment_method", "request_id").alias("payment_method")) \
        .join(users.select("user_id"), "user_id", "left_semi")
    wanted = cart.join(req.select("user_id"), "user_id", "left_semi")
    priced = cart_lines(wanted, products, extra=("seller_id",))
    placed = new_orders(priced, orders, batch_ts, tax_rate, order_items=order_items)
    lines = new_order_lines(priced, placed)
    created = autocreate_payments(placed, payments, batch_ts, order_base=max_key(orders, "order_id"))
    chosen = (created.drop("payment_method").join(req, "user_id", "left")
              .withColumn("payment_method", F.coalesce(F.col("payment_method"), F.lit(S.DEFAULT_PAYMENT_METHOD)))
              .select(*S.PAYMENTS.names))
    stock = stock_after(products, priced)
    # users who placed an order = users with at least one priced line (no ids needed)
    cart_after = cart.join(priced.select("user_id"), "user_id", "left_anti")
    return CheckoutResult(priced, placed.drop("_first_item"), lines, chosen, stock, cart_after)


def write_checkout(result: CheckoutResult, out_dir: str) -> str:
    """All-or-nothing publish: every output goes to a fresh run folder below
    ``out_dir`` and a marker is written last; a run that died leaves a folder no
    reader looks at, and can simply be repeated. Returns the run's folder."""
    run = f"{out_dir}/run-{uuid.uuid4().hex[:12]}"
    result.priced.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name in CHECKOUT_TABLES:
            df = getattr(result, name)
            if name == "lines":
                df = df.select(*S.ORDER_ITEMS.names)
            df.write.mode("error").parquet(f"{run}/{name}")
        spark = result.priced.sparkSession
        spark.range(1).select(F.lit("complete").alias("state")).write.mode("error").json(f"{run}/_PUBLISHED")
    finally:
        result.priced.unpersist()
    return run


def read_checkout(spark: SparkSession, run: str) -> dict[str, DataFrame]:
    """The tables of a published run; an unfinished one is refused."""
    if spark.read.schema("state string").json(f"{run}/_PUBLISHED").where("state = 'complete'").isEmpty():
        raise ValueError(f"not published: {run}")
    return {name: spark.read.parquet(f"{run}/{name}") for name in CHECKOUT_TABLES}
