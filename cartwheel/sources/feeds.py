"""Change feeds (inputs of the mutation operators), derived from raw tables.

Each is one DataFrame expression with a DuckDB twin in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel import schemas as S

# How raw event types map to cart operations and status events.
CART_OP_BY_EVENT = {"click": "add", "view": "set", "error": "remove", "purchase": "clear"}
STATUS_BY_EVENT = {
    "purchase": ("payment", "Completed"),
    "click": ("approval", "Approved"),
    "error": ("approval", "Rejected"),
}
EVENTS_PER_ORDER = 3
# Checkout form choice per market segment; MACHINERY does not check out.
CHECKOUT_METHOD_BY_SEGMENT = {
    "AUTOMOBILE": "Credit Card", "BUILDING": "Debit Card",
    "FURNITURE": "PayPal", "HOUSEHOLD": "Pay on Delivery",
}
REGISTRATION_EVERY = 7          # customers re-sending a registration
REPEATED_NEW_EVERY = 14         # of those, the ones sending the new e-mail twice
EDIT_EVERY, DELETE_EVERY, ADD_EVERY = 11, 13, 17
BAD_PRODUCT_EVERY, BAD_QUANTITY_EVERY = 97, 89
NO_EMAIL_EVERY, UNKNOWN_OP_EVERY, NO_KEY_EVERY, REPEATED_ADD_EVERY = 21, 19, 34, 51
UNKNOWN_USER_EVERY, WITHDRAWN_EVERY, SOLD_OUT_EVERY = 10, 10, 5
NO_EMAIL_OFFSET = 1_000_000_000_000
CHANGE_OFFSET = 1_000_000_000_000
MAX_INT = 2147483647
REOPENED_PAYMENT_METHOD = "PayPal"
# Search terms (empty term, case variants, a '_' wildcard, '#', no match).
SEARCH_TERMS = ("", "widget", "WIDGET", "r_d", "brand#1", "zzz")


def dirty_events(events: DataFrame) -> DataFrame:
    """The given events with damage: some with an unreadable product id, some with a
    quantity no cart can hold. What the registered queries take in, so that their
    rejects aren't empty; no adapter applies it by itself."""
    bad_id = F.concat(F.lit('{"k": "x'), F.col("event_id").cast("string"), F.lit('"}'))
    return events.withColumn("props", F.when(F.col("event_id") % BAD_PRODUCT_EVERY == 0, bad_id).otherwise(F.col("props"))) \
        .withColumn("value", F.when(F.col("event_id") % BAD_QUANTITY_EVERY == 0, F.col("value") * 1e12).otherwise(F.col("value")))


def _cart_fields(events: DataFrame) -> DataFrame:
    """Cart events with parsed fields and ``reason`` (null: accepted). A
    malformed product id or a quantity out of range is a reject, never an error."""
    et = F.col("event_type")
    op = F.when(et == "click", "add").when(et == "view", "set") \
          .when(et == "error", "remove").when(et == "purchase", "clear")
    whole = F.when(F.abs("value") < MAX_INT, F.floor(F.col("value")).cast("int"))
    product = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    reason = (F.when((et != "purchase") & product.isNull(), F.lit("bad_product_id"))
               .when((et == "view") & F.col("value").isNotNull() & whole.isNull(), F.lit("bad_quantity")))
    return events.where(et.isin(*CART_OP_BY_EVENT)).select(
        "event_id", "ts", "user_id", "event_type", product.alias("product_id"), op.alias("op"),
        F.when(et == "click", F.lit(1)).when(et == "view", whole).alias("value"), reason.alias("reason"))


def cart_events_from_raw(events: DataFrame) -> DataFrame:
    """Accepted cart events, and those without a readable product id (the stock
    check answers them; the fold passes over them)."""
    return _cart_fields(events).where(F.col("reason").isNull() | (F.col("reason") == "bad_product_id")) \
        .select("event_id", "ts", "user_id", "product_id", "op", "value")


def cart_event_rejects(events: DataFrame) -> DataFrame:
    """Cart events that can't be applied, with the reason."""
    return _cart_fields(events).where(F.col("reason").isNotNull()).select("event_id", "user_id", "event_type", "reason")


def status_events_from_raw(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    kind = F.when(et == "purchase", "payment").otherwise(F.lit("approval"))
    value = F.when(et == "purchase", "Completed").when(et == "click", "Approved").otherwise(F.lit("Rejected"))
    return (events.where(et.isin(*STATUS_BY_EVENT))
            .select("event_id", "ts", F.floor(F.col("event_id") / EVENTS_PER_ORDER).cast("long").alias("order_id"),
                    kind.alias("kind"), value.alias("value")))


def checkout_requests_from_raw(customer: DataFrame) -> DataFrame:
    """One request per customer of the segments that check out; some customers
    send a second one later, and some requests come from users that don't exist
    (a cart can outlive its user)."""
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    method = None
    for name, v in CHECKOUT_METHOD_BY_SEGMENT.items():
        method = F.when(seg == name, F.lit(v)) if method is None else method.when(seg == name, F.lit(v))
    base = customer.where(seg.isin(*CHECKOUT_METHOD_BY_SEGMENT))
    first = base.select((k * 2).alias("request_id"), k.alias("user_id"), method.alias("payment_method"))
    second = base.where(k % REPEATED_NEW_EVERY == 0).select(
        (k * 2 + 1).alias("request_id"), k.alias("user_id"), F.lit("Credit Card").alias("payment_method"))
    return first.unionByName(second)


def known_users(users: DataFrame) -> DataFrame:
    """The users left when some accounts have been closed."""
    return users.where(F.col("user_id") % UNKNOWN_USER_EVERY != 3)


def listed_products(products: DataFrame) -> DataFrame:
    """The catalogue after some products have been withdrawn and some sold out."""
    return products.where(F.col("product_id") % WITHDRAWN_EVERY != 4) \
        .withColumn("stock", F.when(F.col("product_id") % SOLD_OUT_EVERY == 1, 0).otherwise(F.col("stock")))


def registrations_from_raw(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@example.com"))
    new_email = F.replace(email, F.lit("@"), F.lit("+new@"))
    base = customer.where(k % REGISTRATION_EVERY == 0)
    cols = [F.col("c_name").alias("name")]
    tail = [F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
            F.lpad(k.cast("string"), 10, "0").alias("phone")]
    again = base.select((k * 3).alias("request_id"), *cols, F.upper(email).alias("email"), *tail)
    fresh = base.select((k * 3 + 1).alias("request_id"), *cols, new_email.alias("email"), *tail)
    twice = base.where(k % REPEATED_NEW_EVERY == 0).select(
        (k * 3 + 2).alias("request_id"), *cols, F.upper(new_email).alias("email"), *tail)
    nameless = base.where(k % NO_EMAIL_EVERY == 0).select(
        (k * 3 + NO_EMAIL_OFFSET).alias("request_id"), *cols, F.lit(None).cast("string").alias("email"), *tail)
    return again.unionByName(fresh).unionByName(twice).unionByName(nameless)


def product_changes_from_raw(part: DataFrame, products: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    cur = products.select(F.col("product_id").alias("p_partkey"), "description", "price",
                          F.coalesce("seller_id", F.lit(0).cast("long")).alias("owner"))
    base = part.join(cur, "p_partkey")
    sender = F.when(k % 2 == 0, F.col("owner")).otherwise(F.col("owner") + 1)
    top = part.select(F.max("p_partkey")).scalar()
    null_s = F.lit(None).cast("string")
    edits = base.where((k % EDIT_EVERY == 0) & (k % DELETE_EVERY != 0)).select(
        (k * 3).alias("change_id"), F.lit("edit").alias("op"), k.alias("product_id"), sender.alias("seller_id"),
        F.concat(F.col("p_name"), F.lit(" v2")).alias("name"), F.col("description"),
        (F.col("price") + F.lit(1)).cast(S.MONEY).alias("price"), null_s.alias("category"),
        F.lit("").alias("image_url"))
    deletes = base.where(k % DELETE_EVERY == 0).select(
        (k * 3 + 1).alias("change_id"), F.lit("delete").alias("op"), k.alias("product_id"),
        sender.alias("seller_id"), null_s.alias("name"), null_s.alias("description"),
        F.lit(None).cast(S.MONEY).alias("price"), null_s.alias("category"), null_s.alias("image_url"))
    adds = base.where(k % ADD_EVERY == 0).select(
        (k * 3 + 2).alias("change_id"), F.lit("add").alias("op"), (k + top + 1).alias("product_id"),
        F.col("owner").alias("seller_id"), F.concat(F.lit("new "), F.col("p_name")).alias("name"),
        F.col("description"), F.col("price"),
        F.when(k % 2 == 0, F.col("p_type")).otherwise(null_s).alias("category"),
        F.lit("").alias("image_url"))
    # adds without a key (the shop assigns one), adds sent twice, unknown operations
    fresh = base.where(k % NO_KEY_EVERY == 0).select(
        (k * 3 + CHANGE_OFFSET).alias("change_id"), F.lit("add").alias("op"), F.lit(None).cast("long").alias("product_id"),
        F.col("owner").alias("seller_id"), F.concat(F.lit("keyless "), F.col("p_name")).alias("name"),
        F.col("description"), F.col("price"), F.col("p_type").alias("category"), F.lit("").alias("image_url"))
    again = base.where(k % REPEATED_ADD_EVERY == 0).select(
        (k * 3 + 1 + CHANGE_OFFSET).alias("change_id"), F.lit("add").alias("op"), (k + top + 1).alias("product_id"),
        F.col("owner").alias("seller_id"), F.concat(F.lit("again "), F.col("p_name")).alias("name"),
        F.col("description"), F.col("price"), F.col("p_type").alias("category"), F.lit("").alias("image_url"))
    unknown = base.where(k % UNKNOWN_OP_EVERY == 0).select(
        (k * 3 + 2 + CHANGE_OFFSET).alias("change_id"), F.lit("EDIT").alias("op"), k.alias("product_id"), sender.alias("seller_id"),
        null_s.alias("name"), null_s.alias("description"), F.lit(None).cast(S.MONEY).alias("price"), null_s.alias("category"),
        null_s.alias("image_url"))
    for more in (deletes, adds, fresh, again, unknown):
        edits = edits.unionByName(more)
    return edits


def payment_method_changes_from_raw(orders: DataFrame) -> DataFrame:
    """Open orders change to PayPal and, some, back to a card afterwards."""
    k = F.col("o_orderkey")
    base = orders.where(F.col("o_orderstatus") == "O")
    first = base.select((k * 2).alias("event_id"), F.col("o_orderdate").alias("ts"), k.alias("order_id"),
                        F.lit(REOPENED_PAYMENT_METHOD).alias("payment_method"))
    back = base.where(k % REPEATED_NEW_EVERY == 0).select(
        (k * 2 + 1).alias("event_id"), F.col("o_orderdate").alias("ts"), k.alias("order_id"),
        F.lit("Credit Card").alias("payment_method"))
    return first.unionByName(back)


def search_terms(spark: SparkSession, terms=SEARCH_TERMS) -> DataFrame:
    """A small constant table built JVM-side (no Python worker round trip)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))


def catalogue_terms(part: DataFrame) -> DataFrame:
    """Search terms people take from what they see: names, brands, types, their
    words, and the same with wildcards."""
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    terms = F.array(name, brand, kind, F.concat_ws(" ", brand, kind), F.replace(name, F.lit(" "), F.lit("_")),
                    F.upper(F.concat_ws("%", brand, name)))
    return part.select(F.explode(F.concat(terms, F.split(name, " "))).alias("term")).distinct()


def empty_frame(spark: SparkSession, schema) -> DataFrame:
    """An empty DataFrame of ``schema`` planned as a JVM-side relation."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
