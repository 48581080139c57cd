"""Entity schemas (the seven shop tables) and the change-feed schemas.

Keys are bigint, stored money is decimal(10,2), computed money decimal(18,2),
timestamps are wall-clock (TIMESTAMP_NTZ) as in the source tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEY = T.LongType()
MONEY = T.DecimalType(10, 2)          # stored money, DECIMAL(10,2)
MONEY_CALC = T.DecimalType(18, 2)     # computed money before final rounding
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


USERS = T.StructType([
    _f("user_id", KEY), _f("name", T.StringType()), _f("email", T.StringType()),
    _f("address", T.StringType()), _f("phone", T.StringType()), _f("created_at", TS, True),
])

SELLERS = T.StructType([
    _f("seller_id", KEY), _f("name", T.StringType()), _f("email", T.StringType()),
    _f("phone", T.StringType()), _f("created_at", TS, True),
])

PRODUCTS = T.StructType([
    _f("product_id", KEY), _f("name", T.StringType()), _f("description", T.StringType()),
    _f("price", MONEY), _f("stock", T.IntegerType()), _f("category", T.StringType()),
    _f("image_url", T.StringType()), _f("created_at", TS, True), _f("seller_id", KEY, True),
])

CART = T.StructType([
    _f("cart_id", KEY, True), _f("user_id", KEY), _f("product_id", KEY),
    _f("quantity", T.IntegerType()), _f("added_at", TS, True),
])

ORDERS = T.StructType([
    _f("order_id", KEY), _f("user_id", KEY), _f("total_amount", MONEY),
    _f("order_status", T.StringType()), _f("created_at", TS, True),
    _f("seller_approval_status", T.StringType(), True), _f("seller_id", KEY, True),
])

ORDER_ITEMS = T.StructType([
    _f("item_id", KEY, True), _f("order_id", KEY), _f("product_id", KEY),
    _f("quantity", T.IntegerType()), _f("subtotal", MONEY),
])

PAYMENTS = T.StructType([
    _f("payment_id", KEY), _f("order_id", KEY), _f("user_id", KEY), _f("amount", MONEY),
    _f("payment_status", T.StringType()), _f("payment_method", T.StringType()),
    _f("created_at", TS, True),
])

ENTITY_SCHEMAS = {
    "users": USERS, "sellers": SELLERS, "products": PRODUCTS, "cart": CART,
    "orders": ORDERS, "order_items": ORDER_ITEMS, "payments": PAYMENTS,
}

# Change feeds ---------------------------------------------------------------

CART_EVENTS = T.StructType([
    _f("event_id", KEY), _f("ts", TS), _f("user_id", KEY), _f("product_id", KEY, True),
    _f("op", T.StringType()), _f("value", T.IntegerType(), True),
])

STATUS_EVENTS = T.StructType([
    _f("event_id", KEY), _f("ts", TS), _f("order_id", KEY),
    _f("kind", T.StringType()), _f("value", T.StringType()),
])

REGISTRATIONS = T.StructType([
    _f("request_id", KEY), _f("name", T.StringType()), _f("email", T.StringType()),
    _f("address", T.StringType()), _f("phone", T.StringType()),
])

PRODUCT_CHANGES = T.StructType([
    _f("change_id", KEY), _f("op", T.StringType()), _f("product_id", KEY, True),
    _f("seller_id", KEY), _f("name", T.StringType(), True),
    _f("description", T.StringType(), True), _f("price", MONEY, True),
    _f("category", T.StringType(), True), _f("image_url", T.StringType(), True),
])

CHECKOUT_REQUESTS = T.StructType([
    _f("request_id", KEY), _f("user_id", KEY), _f("payment_method", T.StringType(), True),
])

PAYMENT_METHOD_CHANGES = T.StructType([
    _f("event_id", KEY), _f("ts", TS), _f("order_id", KEY), _f("payment_method", T.StringType()),
])

SEARCH_TERMS = T.StructType([_f("term", T.StringType())])

# Column defaults declared by the shop's DDL.
DEFAULT_STOCK = 0
DEFAULT_CART_QUANTITY = 1
DEFAULT_ORDER_STATUS = "Pending"
DEFAULT_APPROVAL_STATUS = "Pending"
DEFAULT_PAYMENT_STATUS = "Pending"
DEFAULT_PAYMENT_METHOD = "Not Specified"
BACKFILL_PAYMENT_METHOD = "Pay on Delivery"
CHECKOUT_ORDER_STATUS = "Processing"

# Declared VARCHAR lengths, used by the domain checks.
VARCHAR_LIMITS = {
    "users": {"name": 100, "email": 100, "phone": 20},
    "products": {"name": 200, "category": 50, "image_url": 255},
    "orders": {"order_status": 20, "seller_approval_status": 20},
    "payments": {"payment_status": 20, "payment_method": 50},
    "sellers": {"name": 100, "email": 100, "phone": 20},
}
