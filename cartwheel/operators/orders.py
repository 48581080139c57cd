"""Order and payment reporting, repair jobs and status propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions import status as st
from cartwheel.functions import text as tx
from cartwheel.functions.keys import dense_ids, latest_per_key, max_key, newest, ranked
from cartwheel.session import written

ORDER_COLS = ["order_id", "user_id", "created_at", "total_amount", "order_status"]
PAY_COLS = ["payment_id", "payment_status", "payment_method"]


def _filter(df: DataFrame, **keys) -> DataFrame:
    """Optional key filters (FLT-1/FLT-2); None means all keys."""
    for k, v in keys.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df


def latest_payment(payments: DataFrame) -> DataFrame:
    """payments.order_id is not unique: keep the newest (created_at, payment_id)."""
    return latest_per_key(payments.select("order_id", "created_at", *PAY_COLS),
                          ["order_id"], ["created_at", "payment_id"]).drop("created_at")


def _payments_for(payments: DataFrame, o: DataFrame, filtered: bool) -> DataFrame:
    """With a key filter, cut payments to the selected orders first (a small
    semi join) so one user's page does not aggregate every payment."""
    return payments.join(o.select("order_id"), "order_id", "left_semi") if filtered else payments


def order_payment_raw(orders: DataFrame, payments: DataFrame, order_id=None, user_id=None) -> DataFrame:
    """orders LEFT JOIN payments, every payment kept (fan-out as in SQL)."""
    o = _filter(orders.select(*ORDER_COLS), order_id=order_id, user_id=user_id)
    p = _payments_for(payments, o, order_id is not None or user_id is not None)
    return o.join(p.select("order_id", *PAY_COLS), "order_id", "left")


def order_payment(orders: DataFrame, payments: DataFrame, order_id=None, user_id=None) -> DataFrame:
    """One row per order with its latest payment (NULLs when none)."""
    o = _filter(orders.select(*ORDER_COLS), order_id=order_id, user_id=user_id)
    p = _payments_for(payments, o, order_id is not None or user_id is not None)
    return o.join(latest_payment(p), "order_id", "left")


def order_history(orders: DataFrame, payments: DataFrame, user_id=None, last: int | None = None) -> DataFrame:
    """A user's (or every user's) orders, newest first, with payment defaults
    and the display dates (placed at, estimated delivery = +3 days). ``last``: each
    user's newest so many only (the first page); older ones are left behind before
    the shuffle, and payments are cut to the orders kept."""
    if last is not None:
        orders = newest(_filter(orders.select(*ORDER_COLS), user_id=user_id), "user_id", ["created_at", "order_id"], last)
        payments = _payments_for(payments, orders, True)
    base = order_payment(orders, payments, user_id=user_id)
    return (base.select(
        "order_id", "user_id", "created_at", "total_amount", "order_status",
        F.coalesce("payment_status", F.lit(S.DEFAULT_PAYMENT_STATUS)).alias("payment_status"),
        F.coalesce("payment_method", F.lit(S.DEFAULT_PAYMENT_METHOD)).alias("payment_method"),
        tx.long_datetime("created_at").alias("placed_text"),
        tx.delivery_estimate("created_at").alias("delivery_text"))
        # newest first within each user's history (range-partitioned sort,
        # so one heavy user is split across tasks)
        .orderBy("user_id", F.desc("created_at"), F.desc("order_id")))


def order_items_detail(order_items: DataFrame, products: DataFrame, order_id=None) -> DataFrame:
    """Order lines with product name, current price and image."""
    i = _filter(order_items.select("order_id", "product_id", "quantity", "subtotal"), order_id=order_id)
    p = products.select("product_id", "name", "price", "image_url")
    return i.join(p, "product_id")


ITEM_FIELDS = ["product_id", "quantity", "subtotal", "name", "price"]


def order_history_nested(orders: DataFrame, order_items: DataFrame, products: DataFrame,
                         user_id=None, max_items_per_row: int | None = None) -> DataFrame:
    """Orders with their lines as sorted array<struct>: one join plus one
    aggregate instead of a query per order.

    Default: one row per order (the shop's page). With ``max_items_per_row``
    an order of n lines comes as ceil(n / max) rows (column ``part``, from 0), each
    a range of its sorted lines: the parts joined in order are the whole array.
    Lines are put in order by ``ranked``, so no task gathers a huge order.
    """
    o = _filter(orders.select(*ORDER_COLS), user_id=user_id)
    lines = order_items.join(o.select("order_id"), "order_id", "left_semi") if user_id is not None \
        else order_items
    items = order_items_detail(lines, products)
    line = F.struct(*ITEM_FIELDS)
    if max_items_per_row is None:
        nested = items.groupBy("order_id").agg(F.sort_array(F.collect_list(line)).alias("items"))
        return o.join(nested, "order_id", "left")
    placed = ranked(written(items.select("order_id", *ITEM_FIELDS), "order-items"), ["order_id"], ITEM_FIELDS, "order-items-sorted")
    part = F.floor(F.col("rank") / int(max_items_per_row)).cast("int")
    nested = placed.withColumn("part", part).groupBy("order_id", "part").agg(F.sort_array(F.collect_list(line)).alias("items"))
    return o.join(nested, "order_id", "left").withColumn("part", F.coalesce(F.col("part"), F.lit(0)))


def items_text(items_col) -> F.Column:
    """Flatten the nested lines to one comparable string."""
    c = F.col(items_col) if isinstance(items_col, str) else items_col
    fmt = F.transform(c, lambda x: F.concat_ws(
        "|", x["product_id"].cast("string"), x["quantity"].cast("string"),
        x["subtotal"].cast("string"), x["name"], x["price"].cast("string")))
    return F.coalesce(F.array_join(fmt, "; "), F.lit(""))


def orders_unpaid(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """LEFT JOIN .. IS NULL, written as the anti join it is."""
    return orders.join(payments.select("order_id"), "order_id", "left_anti")


def orders_purged(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """DELETE orders without payment == keep orders with one (semi join)."""
    return orders.join(payments.select("order_id"), "order_id", "left_semi")


def payments_backfill(orders: DataFrame, payments: DataFrame, batch_ts) -> DataFrame:
    """A Pending / Pay on Delivery payment for each order that has none."""
    missing = orders_unpaid(orders, payments).select("order_id", "user_id", "total_amount")
    keyed = dense_ids(missing, "order_id", max_key(payments, "payment_id"), "payment_id")
    return keyed.select("payment_id", "order_id", "user_id", F.col("total_amount").alias("amount"),
                        F.lit(S.DEFAULT_PAYMENT_STATUS).alias("payment_status"),
                        F.lit(S.BACKFILL_PAYMENT_METHOD).alias("payment_method"),
                        tx.wall_clock(batch_ts).alias("created_at"))


def update_payment_method(payments: DataFrame, changes: DataFrame) -> DataFrame:
    """UPDATE payments SET payment_method WHERE order_id: every payment of a
    changed order takes the new method; an order's last change (ts, event_id)
    wins."""
    ch = changes.groupBy("order_id").agg(F.max_by("payment_method", F.struct("ts", "event_id")).alias("_new"))
    return (payments.join(ch, "order_id", "left")
            .withColumn("payment_method", F.coalesce(F.col("_new"), F.col("payment_method")))
            .select(*S.PAYMENTS.names))


def orders_after_payment_update(orders: DataFrame, payments: DataFrame, changes: DataFrame) -> DataFrame:
    """The next ``orders`` table after ``update_payment_method``: the payment
    trigger looks at the new row on every update, whatever was updated, so an
    order with a Completed payment among the updated ones goes to Processing."""
    updated = payments.where(st.is_status("payment_status", "completed")).select("order_id") \
        .join(changes.select("order_id"), "order_id", "left_semi").distinct().withColumn("_paid", F.lit(True))
    status = F.when(F.col("_paid"), F.lit("Processing")).otherwise(F.col("order_status"))
    return orders.join(updated, "order_id", "left").withColumn("order_status", status).select(*S.ORDERS.names)


def _status_effects(events: DataFrame) -> DataFrame:
    """Trigger bodies as data: what each status event sets on its order.
    payment Completed -> Processing; approval Approved -> Processing;
    approval Rejected -> Cancelled; anything else changes nothing."""
    kind, low = F.col("kind"), F.lower(F.col("value"))
    new_status = (F.when((kind == "payment") & (low == "completed"), F.lit("Processing"))
                   .when((kind == "approval") & (low == "approved"), F.lit("Processing"))
                   .when((kind == "approval") & (low == "rejected"), F.lit("Cancelled")))
    new_approval = F.when(kind == "approval", st.canonical_approval(F.col("value")))
    return (events.select("event_id", "ts", "order_id", new_status.alias("new_status"),
                          new_approval.alias("new_approval"))
            .where(F.col("new_status").isNotNull()))


def latest_status_effects(events: DataFrame) -> DataFrame:
    """Per order: status from the latest effective event, approval from the
    latest approval event. max_by over (ts, event_id) does not depend on
    arrival order, so late events need no watermark for correctness."""
    eff = _status_effects(events)
    seq = F.struct("ts", "event_id")
    is_appr = F.col("new_approval").isNotNull()
    return eff.groupBy("order_id").agg(
        F.max_by("new_status", seq).alias("new_status"),
        F.max_by(F.col("event_id"), seq).alias("status_event_id"),
        F.max_by(F.when(is_appr, F.col("new_approval")), F.when(is_appr, seq)).alias("new_approval"))


def order_status_latest(orders: DataFrame, status_events: DataFrame) -> DataFrame:
    """The next ``orders`` table after the status triggers have fired for all
    events, with the id of each order's deciding event."""
    eff = latest_status_effects(status_events)
    return orders_with_effects(orders, eff)


def orders_with_effects(orders: DataFrame, effects: DataFrame) -> DataFrame:
    """``orders`` with status and approval replaced where ``effects`` has some."""
    return (orders.join(effects, "order_id", "left")
            .withColumn("order_status", st.canonical_order_status(F.coalesce("new_status", "order_status")))
            .withColumn("seller_approval_status", st.canonical_approval(F.coalesce("new_approval", "seller_approval_status")))
            .select(*S.ORDERS.names, "status_event_id"))


def seller_decisions(orders: DataFrame, decisions: DataFrame, enforce_owner: bool = False) -> DataFrame:
    """The next ``orders`` table after approvals and rejections: approval and
    order status set together, last decision per order wins. ``decisions``:
    event_id, ts, order_id, seller_id, value (Approved / Rejected). The shop does
    not check ownership (default)."""
    d = decisions
    if enforce_owner:
        d = d.join(orders.select("order_id", "seller_id"), ["order_id", "seller_id"], "left_semi")
    d = d.where(F.lower("value").isin("approved", "rejected"))
    latest = d.groupBy("order_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("_decision"))
    approved, none = F.lower(F.col("_decision")) == "approved", F.col("_decision").isNull()
    return (orders.join(latest, "order_id", "left")
            .withColumn("seller_approval_status", F.when(none, st.canonical_approval("seller_approval_status"))
                        .when(approved, F.lit("Approved")).otherwise(F.lit("Rejected")))
            .withColumn("order_status", F.when(none, st.canonical_order_status("order_status"))
                        .when(approved, F.lit("Processing")).otherwise(F.lit("Cancelled")))
            .select(*S.ORDERS.names))
