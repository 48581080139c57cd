"""Entity tables of the shop.

Two ways in:

* ``Shop.from_raw``: derive the seven entities and the change feeds from the
  driver's TPC-H-like tables (the adapters below, one DataFrame expression
  each; the DuckDB oracle re-derives them independently in SQL).
* ``Shop.from_tables``: read entity tables already written as parquet by
  ``write_entities`` (how a production deployment would run: the adapters
  are an ingest job, queries read typed tables with pushdown).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.functions.keys import dense_ids
from cartwheel import schemas as S
from cartwheel.sources import feeds
from cartwheel.sources.raw import read_raw

# The adapter's status/priority mappings (FIXTURES.md §3).
ORDER_STATUS_BY_CODE = {"F": "Shipped", "O": "Pending", "P": "Processing"}
APPROVAL_BY_PRIORITY = {"1-URGENT": "approved", "5-LOW": "Rejected", "2-HIGH": "Pending"}
APPROVAL_OTHERWISE = "pending"
NO_SELLER_PRIORITY = "4-NOT SPECIFIED"
PAYMENT_METHOD_BY_PRIORITY = {
    "1-URGENT": "Credit Card", "2-HIGH": "Debit Card", "3-MEDIUM": "PayPal",
    "4-NOT SPECIFIED": "Pay on Delivery", "5-LOW": "Not Specified",
}
EMAIL_DOMAIN = "@example.com"
NO_PAYMENT_EVERY = 10      # orders with key % 10 = 0 have no payment
SECOND_PAYMENT_EVERY = 25  # orders with key % 25 = 1 have a second, later payment
SECOND_PAYMENT_METHOD = "Credit Card"


def _map(col, mapping: dict, otherwise=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(otherwise) if otherwise is not None else F.lit(None).cast("string"))


def email_from_name(name_col):
    return F.concat(F.lower(F.replace(name_col, F.lit("#"), F.lit(""))), F.lit(EMAIL_DOMAIN))


def phone_from_key(key_col):
    return F.lpad(key_col.cast("string"), 10, "0")


def _null_ts():
    return F.lit(None).cast(S.TS)


def users_from_raw(customer: DataFrame, nation: DataFrame) -> DataFrame:
    nations = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return (customer.join(nations, "c_nationkey", "left")
            .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                    email_from_name(F.col("c_name")).alias("email"),
                    F.col("n_name").alias("address"),
                    phone_from_key(F.col("c_custkey")).alias("phone"),
                    _null_ts().alias("created_at")))


def sellers_from_raw(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("name"),
                           email_from_name(F.col("s_name")).alias("email"),
                           phone_from_key(F.col("s_suppkey")).alias("phone"),
                           _null_ts().alias("created_at"))


def products_from_raw(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    # Owner of a part = lowest supplier key that sold it (pre-aggregated per part).
    owner = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("seller_id"))
    return (part.join(owner, "p_partkey", "left")
            .select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
                    F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("description"),
                    F.col("p_retailprice").cast(S.MONEY).alias("price"),
                    F.col("p_size").alias("stock"), F.col("p_type").alias("category"),
                    F.lit("").alias("image_url"), _null_ts().alias("created_at"), "seller_id"))


def orders_from_raw(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    first_seller = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("_s"))
    prio = F.col("o_orderpriority")
    return (orders.join(first_seller, "o_orderkey", "left")
            .select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_totalprice").cast(S.MONEY).alias("total_amount"),
                    _map(F.col("o_orderstatus"), ORDER_STATUS_BY_CODE).alias("order_status"),
                    F.col("o_orderdate").alias("created_at"),
                    _map(prio, APPROVAL_BY_PRIORITY, APPROVAL_OTHERWISE).alias("seller_approval_status"),
                    F.when(prio == F.lit(NO_SELLER_PRIORITY), F.lit(None).cast("long"))
                     .otherwise(F.col("_s")).alias("seller_id")))


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def order_lines_from_raw(lineitem: DataFrame) -> DataFrame:
    """ORDER_ITEMS rows without their key."""
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(S.MONEY).alias("subtotal"))


def order_items_from_raw(lineitem: DataFrame) -> DataFrame:
    """lineitem has no key ((orderkey, linenumber) repeats): item ids number its
    rows by order, then by everything else, so equal rows have ids of their own."""
    keyed = dense_ids(lineitem.select(*LINE_ORDER), "l_orderkey", F.lit(0), "item_id", order=LINE_ORDER)
    return keyed.select(
        "item_id", F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(S.MONEY).alias("subtotal"))


def payments_from_raw(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    base = orders.select(
        k, F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast(S.MONEY).alias("amount"),
        "o_orderstatus", "o_orderpriority", "o_orderdate")
    first = base.where(k % NO_PAYMENT_EVERY != 0).select(
        (k * 2).alias("payment_id"), k.alias("order_id"), "user_id", "amount",
        F.when(F.col("o_orderstatus") == "F", F.lit("Completed")).otherwise(F.lit("Pending")).alias("payment_status"),
        _map(F.col("o_orderpriority"), PAYMENT_METHOD_BY_PRIORITY, "Not Specified").alias("payment_method"),
        F.col("o_orderdate").alias("created_at"))
    second = base.where(k % SECOND_PAYMENT_EVERY == 1).select(
        (k * 2 + 1).alias("payment_id"), k.alias("order_id"), "user_id", "amount",
        F.lit("Completed").alias("payment_status"), F.lit(SECOND_PAYMENT_METHOD).alias("payment_method"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAYS")).alias("created_at"))
    return first.unionByName(second)


# Declared column defaults per table (DDL DEFAULT clauses).
def _defaults():
    return {
        "products": {"stock": F.lit(S.DEFAULT_STOCK), "image_url": F.lit("")},
        "cart": {"quantity": F.lit(S.DEFAULT_CART_QUANTITY)},
        "orders": {"order_status": F.lit(S.DEFAULT_ORDER_STATUS),
                   "seller_approval_status": F.lit(S.DEFAULT_APPROVAL_STATUS)},
        "payments": {"payment_status": F.lit(S.DEFAULT_PAYMENT_STATUS)},
    }


def with_defaults(df: DataFrame, table: str, now=None) -> DataFrame:
    """Conform rows to a table: add missing columns, fill declared defaults
    for missing or NULL values, created_at/added_at = ``now`` when given
    (CURRENT_TIMESTAMP as a parameter), and cast to the declared types."""
    schema = S.ENTITY_SCHEMAS[table]
    defaults = _defaults().get(table, {})
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, defaults[f.name])
        if f.name in ("created_at", "added_at") and now is not None:
            c = F.coalesce(c, F.lit(now.isoformat(sep=" ") if hasattr(now, "isoformat") else str(now))
                           .cast(S.TS))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


ENTITY_NAMES = ("users", "sellers", "products", "orders", "order_items", "payments")


# Bucket key per entity: the key its big joins use, so joins between tables
# bucketed the same way need no shuffle (orders, lines and payments meet on
# order_id; carts are read per user).
BUCKET_KEYS = {"users": "user_id", "sellers": "seller_id", "products": "product_id",
               "orders": "order_id", "order_items": "order_id", "payments": "order_id", "cart": "user_id"}


class Shop:
    """The shop's entity DataFrames and change feeds for one data set.

    Attributes are built lazily, once per ``Shop``; every query function takes
    a ``Shop`` so the same code runs on raw-derived or materialised tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, tables_dir: str | None = None,
                 database: str | None = None, incoming=None):
        """``incoming``: applied to the raw events before anything reads them."""
        self.spark = spark
        self.incoming = incoming or (lambda events: events)
        self.sf_dir = sf_dir
        self.tables_dir = tables_dir
        self.database = database

    @classmethod
    def from_raw(cls, spark: SparkSession, sf_dir: str, incoming=None) -> "Shop":
        return cls(spark, sf_dir=sf_dir, incoming=incoming)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, sf_dir: str, incoming=None) -> "Shop":
        """Entities from catalog tables saved by ``save_bucketed_entities``."""
        return cls(spark, sf_dir=sf_dir, database=database, incoming=incoming)

    @classmethod
    def from_tables(cls, spark: SparkSession, tables_dir: str, sf_dir: str, incoming=None) -> "Shop":
        """Entities from parquet written by ``write_entities``; feeds still
        derive from the raw tables under ``sf_dir``."""
        return cls(spark, sf_dir=sf_dir, tables_dir=tables_dir, incoming=incoming)

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    def _entity(self, name: str, build) -> DataFrame:
        if self.database:
            return self.spark.table(f"{self.database}.{name}")
        if self.tables_dir:
            return self.spark.read.schema(S.ENTITY_SCHEMAS[name]).parquet(f"{self.tables_dir}/{name}")
        return build()

    @cached_property
    def users(self) -> DataFrame:
        return self._entity("users", lambda: users_from_raw(self.raw("customer"), self.raw("nation")))

    @cached_property
    def sellers(self) -> DataFrame:
        return self._entity("sellers", lambda: sellers_from_raw(self.raw("supplier")))

    @cached_property
    def products(self) -> DataFrame:
        return self._entity("products", lambda: products_from_raw(self.raw("part"), self.raw("lineitem")))

    @cached_property
    def orders(self) -> DataFrame:
        return self._entity("orders", lambda: orders_from_raw(self.raw("orders"), self.raw("lineitem")))

    @cached_property
    def order_items(self) -> DataFrame:
        return self._entity("order_items", lambda: order_items_from_raw(self.raw("lineitem")))

    @cached_property
    def order_lines(self) -> DataFrame:
        """order_items without item_id, for reports that don't need the key."""
        return (self.order_items if self.database or self.tables_dir else order_lines_from_raw(self.raw("lineitem"))) \
            .select("order_id", "product_id", "quantity", "subtotal")

    @cached_property
    def payments(self) -> DataFrame:
        return self._entity("payments", lambda: payments_from_raw(self.raw("orders")))

    @cached_property
    def cart(self) -> DataFrame:
        """Current cart lines = fold of all cart events."""
        if self.database:
            return self.spark.table(f"{self.database}.cart")
        if self.tables_dir:
            return self.spark.read.schema(S.CART).parquet(f"{self.tables_dir}/cart")
        from cartwheel.operators.cart import fold_cart_events, with_cart_ids
        return with_cart_ids(fold_cart_events(self.cart_events), F.lit(0))

    @cached_property
    def search_index(self):
        """The stored index of the catalogue, where there is one, else a new one."""
        from cartwheel.operators.catalog import build_search_index, read_search_index
        if self.tables_dir:
            return read_search_index(self.spark, f"{self.tables_dir}/search")
        return build_search_index(self.products)

    # Change feeds (always derived from the raw tables) ------------------------
    @property
    def events(self) -> DataFrame:
        return self.incoming(self.raw("events"))

    @cached_property
    def cart_events(self) -> DataFrame:
        return feeds.cart_events_from_raw(self.events)

    @cached_property
    def status_events(self) -> DataFrame:
        return feeds.status_events_from_raw(self.events)

    @cached_property
    def checkout_requests(self) -> DataFrame:
        return feeds.checkout_requests_from_raw(self.raw("customer"))

    @cached_property
    def registrations(self) -> DataFrame:
        return feeds.registrations_from_raw(self.raw("customer"))

    @cached_property
    def product_changes(self) -> DataFrame:
        return feeds.product_changes_from_raw(self.raw("part"), self.products)

    @cached_property
    def payment_method_changes(self) -> DataFrame:
        return feeds.payment_method_changes_from_raw(self.raw("orders"))

    @cached_property
    def search_terms(self) -> DataFrame:
        return feeds.search_terms(self.spark)


def write_entities(shop: Shop, out_dir: str, mode: str = "overwrite") -> None:
    """Materialise the entities, the folded cart and the catalogue's search index
    as parquet tables."""
    from cartwheel.operators.catalog import build_search_index
    for name in ENTITY_NAMES:
        getattr(shop, name).write.mode(mode).parquet(f"{out_dir}/{name}")
    shop.cart.write.mode(mode).parquet(f"{out_dir}/cart")
    products = shop.spark.read.schema(S.PRODUCTS).parquet(f"{out_dir}/products")
    build_search_index(products, f"{out_dir}/search")


def save_bucketed_entities(shop: Shop, database: str, location: str, buckets: int,
                           mode: str = "overwrite") -> None:
    """Save the entities (and the folded cart) as catalog tables bucketed and
    sorted on ``BUCKET_KEYS`` with the same bucket count, in a database whose
    files live at ``location`` (a folder in the shared storage). Joins on the
    bucket key between these tables then read co-located buckets instead of
    shuffling both sides."""
    spark = shop.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}'")
    for name in ENTITY_NAMES + ("cart",):
        key = BUCKET_KEYS[name]
        (getattr(shop, name).write.mode(mode).format("parquet")
         .bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{database}`.`{name}`"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, properties: dict | None = None) -> DataFrame:
    """Optional source for a live shop database: a partitioned JDBC scan on an
    integral key so the read is split across executors."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})
