"""Seller reporting (dashboard, the two seller views, order detail) and
seller-side table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions import status as st
from cartwheel.functions import text as tx
from cartwheel.functions.keys import dense_ids, max_key, newest, ranked
from cartwheel.functions.money import money_text
from cartwheel.operators.orders import latest_payment
from cartwheel.session import written
from cartwheel.sources.entities import with_defaults


def seller_products(products: DataFrame, seller_id=None, last: int | None = None) -> DataFrame:
    """Each seller's products, newest first (global range-partitioned sort,
    so one big seller is split across tasks). ``last``: each seller's newest so
    many only."""
    p = products.where(F.col("seller_id").isNotNull())
    if seller_id is not None:
        p = p.where(F.col("seller_id") == F.lit(seller_id))
    if last is not None:
        p = newest(p, "seller_id", ["created_at", "product_id"], last)
    return (p.select("seller_id", "product_id", "name", "price", "stock", "category", "created_at",
                     tx.excerpt("description", 100).alias("excerpt"),
                     money_text("price").alias("price_text"))
            .orderBy("seller_id", F.desc("created_at"), F.desc("product_id")))


def seller_pending_orders(orders: DataFrame, order_items: DataFrame, products: DataFrame,
                          users: DataFrame, seller_id=None) -> DataFrame:
    """Orders awaiting approval that contain a product of the seller, once per
    (seller, order). The four-table join + GROUP BY order_id of the shop is a
    de-duplication; here lines are first cut to pending orders (semi join),
    reduced to distinct (order, seller) pairs, then joined to orders/users."""
    pending = orders.where(st.is_status("seller_approval_status", "pending"))
    owners = products.where(F.col("seller_id").isNotNull()).select("product_id", "seller_id")
    if seller_id is not None:
        owners = owners.where(F.col("seller_id") == F.lit(seller_id))
    pairs = (order_items.select("order_id", "product_id")
             .join(pending.select("order_id"), "order_id", "left_semi")
             .join(owners, "product_id")
             .select("order_id", "seller_id").distinct())
    customers = users.select("user_id", F.col("name").alias("customer_name"))
    o = pending.select("order_id", "user_id", "total_amount", "order_status",
                       "seller_approval_status", "created_at")
    return (pairs.join(o, "order_id").join(customers, "user_id")
            .select("seller_id", "order_id", "user_id", "total_amount", "order_status",
                    "seller_approval_status", "created_at", "customer_name",
                    tx.short_datetime("created_at").alias("created_text"),
                    tx.title_case("order_status").alias("status_title"),
                    st.approval_badge("seller_approval_status").alias("approval_badge"))
            .orderBy("seller_id", F.desc("created_at"), F.desc("order_id")))


def seller_dashboard_view(orders: DataFrame, payments: DataFrame, users: DataFrame) -> DataFrame:
    """View seller_dashboard: orders JOIN payments JOIN users, seller set."""
    o = orders.where(F.col("seller_id").isNotNull()).select(
        "order_id", "user_id", "seller_id", "created_at", "total_amount", "order_status",
        "seller_approval_status")
    p = payments.select("order_id", "payment_status", "payment_method")
    u = users.select("user_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email"),
                     F.col("phone").alias("customer_phone"), F.col("address").alias("customer_address"))
    return o.join(p, "order_id").join(u, "user_id").drop("user_id")


def order_labels(order_items: DataFrame, products: DataFrame,
                 max_labels_per_row: int | None = None) -> DataFrame:
    """GROUP_CONCAT(CONCAT(name,' (',qty,')') SEPARATOR ', ') per order, in
    label order and without the 1024-byte cut.

    Default: one string per order. With ``max_labels_per_row`` an order of n
    lines comes as ceil(n / max) rows (column ``part``, from 0), each a range of
    its labels: the parts joined in order are the whole string. Labels are put in
    order by ``ranked``, so no task sorts or concatenates a huge order whole.
    """
    label = F.concat(F.col("name"), F.lit(" ("), F.col("quantity").cast("string"), F.lit(")"))
    lab = order_items.select("order_id", "product_id", "quantity") \
        .join(products.select("product_id", "name"), "product_id").select("order_id", label.alias("label"))
    joined = F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("products")
    if max_labels_per_row is None:
        return lab.groupBy("order_id").agg(joined)
    placed = ranked(written(lab, "order-labels"), ["order_id"], ["label"], "order-labels-sorted")
    part = F.floor(F.col("rank") / int(max_labels_per_row)).cast("int")
    return placed.withColumn("part", part).groupBy("order_id", "part").agg(joined)


def seller_orders_view(orders: DataFrame, payments: DataFrame, order_items: DataFrame,
                       products: DataFrame, users: DataFrame,
                       max_labels_per_row: int | None = None) -> DataFrame:
    """View seller_orders. Lines are aggregated per order before the join;
    the payment columns come from the latest payment (the SQL view leaves
    them undetermined). ``max_labels_per_row``: see ``order_labels``."""
    o = orders.where(F.col("seller_id").isNotNull()).select(
        "order_id", "user_id", "seller_id", "created_at", "total_amount", "order_status",
        "seller_approval_status")
    items = order_items.join(o.select("order_id"), "order_id", "left_semi")
    labels = order_labels(items, products, max_labels_per_row)
    pay = latest_payment(payments).select("order_id", "payment_status", "payment_method")
    u = users.select("user_id", F.col("name").alias("customer_name"))
    return o.join(pay, "order_id").join(u, "user_id").join(labels, "order_id").drop("user_id")


def order_customer_detail(orders: DataFrame, users: DataFrame, payments: DataFrame,
                          order_id=None) -> DataFrame:
    """Seller's order page: order + customer name/e-mail + latest payment."""
    o = orders if order_id is None else orders.where(F.col("order_id") == F.lit(order_id))
    u = users.select("user_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email"))
    pay = latest_payment(payments).select("order_id", "payment_status", "payment_method")
    return (o.select("order_id", "user_id", "seller_id", "total_amount", "order_status",
                     "seller_approval_status", "created_at")
            .join(u, "user_id").join(pay, "order_id", "left")
            .select("order_id", "user_id", "seller_id", "customer_name", "customer_email", "total_amount",
                    "order_status", "seller_approval_status", "created_at",
                    F.coalesce("payment_status", F.lit(S.DEFAULT_PAYMENT_STATUS)).alias("payment_status"),
                    F.coalesce("payment_method", F.lit(S.DEFAULT_PAYMENT_METHOD)).alias("payment_method"),
                    st.payment_badge(F.coalesce("payment_status", F.lit(S.DEFAULT_PAYMENT_STATUS)))
                      .alias("payment_badge")))


def product_change_outcomes(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change with its ``outcome`` and, for adds, the key it gets.

    delete and edit apply only when the sender owns the product (else
    ``not_owner_or_missing``); an edit or a repeated delete is ``superseded``
    when a later edit or a delete of the product by its owner is in the batch.
    An add needs a category (``missing_category``; the shop's INSERT omits it
    though it is NOT NULL); with a key that exists or that an earlier add of the
    batch took it is a ``duplicate_key``; without a key it gets the next one
    after all others. Any other operation is ``unknown_op``. One batch applies
    to the table as it stood before: an edit of a product added in the same batch
    is rejected, and an add may not reuse a key deleted in it.
    """
    owner = products.select("product_id", F.col("seller_id").alias("_owner"), F.lit(True).alias("_exists"))
    op, last = F.col("op"), F.struct(F.col("op") == "delete", F.col("change_id"))
    owned = op.isin("edit", "delete") & (F.col("_owner") == F.col("seller_id"))
    addable = (op == "add") & F.col("category").isNotNull()
    changes = written(changes, "product-changes")            # read five times
    looked = changes.join(owner, "product_id", "left")
    winners = looked.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.max(F.when(owned, last)).alias("_last"), F.min(F.when(addable, F.col("change_id"))).alias("_first_add"))
    judged = written(looked.join(winners, "product_id", "left").withColumn("outcome", (
        F.when(op == "add", F.when(F.col("category").isNull(), F.lit("missing_category"))
                             .when(F.col("_exists") | (F.col("_first_add") < F.col("change_id")), F.lit("duplicate_key"))
                             .otherwise(F.lit("applied")))
         .when(op.isin("edit", "delete"), F.when(F.coalesce(owned, F.lit(False)),
               F.when(F.col("_last") == last, F.lit("applied")).otherwise(F.lit("superseded")))
               .otherwise(F.lit("not_owner_or_missing")))
         .otherwise(F.lit("unknown_op")))), "product-judged")
    base = F.greatest(max_key(products, "product_id"), max_key(changes.where(op == "add"), "product_id"))
    new = dense_ids(judged.where((F.col("outcome") == "applied") & F.col("product_id").isNull()).select("change_id"),
                    "change_id", base, "_new_key")
    return judged.join(new, "change_id", "left").withColumn("product_id", F.coalesce("product_id", "_new_key")) \
        .select(*changes.columns, "outcome")


def apply_product_changes(products: DataFrame, changes: DataFrame, outcomes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Seller product edits as (current, changes) -> (next, rejects), by
    ``product_change_outcomes``. An edit replaces name, description, price and
    image_url (NULL keeps the old value); an add starts with stock 0. ``outcomes``:
    the judged changes, where they are known already (a written table: each output
    takes its part of them)."""
    outcomes = written(product_change_outcomes(products, changes), "product-outcomes") if outcomes is None else outcomes
    applied = outcomes.where(F.col("outcome") == "applied")
    fields = ("name", "description", "price", "image_url")
    deletes = applied.where(F.col("op") == "delete").select("product_id")
    edits = applied.where(F.col("op") == "edit").select("product_id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    edited = products.join(deletes, "product_id", "left_anti").join(edits, "product_id", "left")
    for c in fields:
        edited = edited.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c)))
    # declared defaults (stock 0, empty image) fill what the change leaves out
    new_rows = with_defaults(applied.where(F.col("op") == "add").select(
        "product_id", "name", "description", "price", "category", "image_url", "seller_id"), "products")
    rejects = outcomes.where(~F.col("outcome").isin("applied", "superseded")).select("change_id", F.col("outcome").alias("reason"))
    return edited.select(*S.PRODUCTS.names).unionByName(new_rows), rejects


def top_supplier_assignments(lineitem_like: DataFrame) -> DataFrame:
    """(product_id, seller_id): for each product the seller that supplied the
    largest quantity (ties: lowest seller id). Input: product_id, seller_id,
    quantity rows; pre-aggregated per (product, seller)."""
    per = lineitem_like.groupBy("product_id", "seller_id").agg(F.sum("quantity").alias("_q"))
    return per.groupBy("product_id").agg(
        F.max_by("seller_id", F.struct(F.col("_q"), -F.col("seller_id"))).alias("seller_id"))


def assign_sellers(products: DataFrame, assignments: DataFrame) -> DataFrame:
    """UPDATE products SET seller_id = v WHERE product_id IN (...), for any
    number of (product_id, seller_id) pairs (a join, not a literal list)."""
    a = assignments.select("product_id", F.col("seller_id").alias("_new"))
    return (products.join(a, "product_id", "left")
            .withColumn("previous_seller_id", F.col("seller_id"))
            .withColumn("seller_id", F.coalesce(F.col("_new"), F.col("seller_id")))
            .drop("_new"))


def assign_seller_to_listed(products: DataFrame, product_ids, seller_id: int) -> DataFrame:
    """The literal-list form (IN (1,2,3,4)) for short, fixed lists."""
    ids = list(product_ids)
    return products.withColumn(
        "seller_id", F.when(F.col("product_id").isin(ids), F.lit(seller_id).cast("long"))
                      .otherwise(F.col("seller_id")))
