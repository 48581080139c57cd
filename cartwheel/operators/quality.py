"""The DDL's integrity rules (keys, uniques, foreign keys, NOT NULL, lengths,
ranges) and the forms' rules, as data-quality reports over whole tables.
Each report is a small DataFrame of counts; every check is one aggregate or
one anti join, never a driver-side loop over rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions.money import DEFAULT_TAX_RATE, total_with_tax
from cartwheel.functions.text import email_key

# Uniqueness constraints (name, table, key expressions).
UNIQUE_RULES = (
    ("users_pk", "users", ("user_id",)),
    ("users_email", "users", ("email",)),
    ("sellers_pk", "sellers", ("seller_id",)),
    ("sellers_email", "sellers", ("email",)),
    ("products_pk", "products", ("product_id",)),
    ("cart_pk", "cart", ("cart_id",)),
    ("cart_user_product", "cart", ("user_id", "product_id")),
    ("orders_pk", "orders", ("order_id",)),
    ("order_items_pk", "order_items", ("item_id",)),
    ("payments_pk", "payments", ("payment_id",)),
)

# Primary keys.
PRIMARY_KEYS = {"users": "user_id", "sellers": "seller_id", "products": "product_id", "cart": "cart_id",
                "orders": "order_id", "order_items": "item_id", "payments": "payment_id"}

# The nine declared foreign keys (name, child, column, parent, key).
FOREIGN_KEYS = (
    ("products_seller", "products", "seller_id", "sellers", "seller_id"),
    ("cart_user", "cart", "user_id", "users", "user_id"),
    ("cart_product", "cart", "product_id", "products", "product_id"),
    ("orders_user", "orders", "user_id", "users", "user_id"),
    ("orders_seller", "orders", "seller_id", "sellers", "seller_id"),
    ("order_items_order", "order_items", "order_id", "orders", "order_id"),
    ("order_items_product", "order_items", "product_id", "products", "product_id"),
    ("payments_order", "payments", "order_id", "orders", "order_id"),
    ("payments_user", "payments", "user_id", "users", "user_id"),
)

# NOT NULL columns per table (passwords are not carried).
NOT_NULL = {
    "users": ("user_id", "name", "email", "address", "phone"),
    "sellers": ("seller_id", "name", "email", "phone"),
    "products": ("product_id", "name", "description", "price", "stock", "category", "image_url"),
    "cart": ("cart_id", "user_id", "product_id", "quantity"),
    "orders": ("order_id", "user_id", "total_amount", "order_status"),
    "order_items": ("item_id", "order_id", "product_id", "quantity", "subtotal"),
    "payments": ("payment_id", "order_id", "user_id", "amount", "payment_status", "payment_method"),
}

# DECIMAL(10,2) columns (|x| must stay below 10^8).
MONEY_COLUMNS = {"products": ("price",), "orders": ("total_amount",),
                 "order_items": ("subtotal",), "payments": ("amount",)}
DECIMAL_LIMIT = Decimal("100000000")


def conservation(feeds: dict[str, tuple[DataFrame, list[DataFrame]]]) -> DataFrame:
    """(feed, input_rows, accounted_rows): every input row must be in exactly one
    of the outputs."""
    out = []
    for name, (given, outputs) in feeds.items():
        n = given.groupBy().agg(F.count(F.lit(1)).alias("input_rows"))
        parts = _union([o.groupBy().agg(F.count(F.lit(1)).alias("n")) for o in outputs])
        out.append(n.select(F.lit(name).alias("feed"), "input_rows",
                            parts.agg(F.sum("n")).scalar().alias("accounted_rows")))
    return _union(out)


def _union(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def dq_unique(tables: dict[str, DataFrame]) -> DataFrame:
    """Per constraint: keys that occur more than once and the surplus rows.
    E-mails compare case-insensitively; NULL keys are left to dq_not_null."""
    frames = []
    for name, table, cols in UNIQUE_RULES:
        df = tables[table]
        keys = [email_key(c).alias(c) if c == "email" else F.col(c) for c in cols]
        k = df.select(*keys).dropna()
        dup = k.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        frames.append(dup.groupBy().agg(
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("excess_rows"))
            .select(F.lit(name).alias("rule"), F.lit(table).alias("table_name"),
                    "duplicate_keys", "excess_rows"))
    return _union(frames)


def dq_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key: child rows with a non-NULL key and those without a
    parent row. Children are counted per key before the join, so a key in many
    rows is one row of it."""
    frames = []
    for name, child, col, parent, pkey in FOREIGN_KEYS:
        c = tables[child].select(F.col(col).alias("_k")).where(F.col("_k").isNotNull()) \
            .groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        p = tables[parent].select(F.col(pkey).alias("_k")).distinct().withColumn("_hit", F.lit(1))
        frames.append(c.join(p, "_k", "left").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("child_rows"),
            F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("orphan_rows"))
            .select(F.lit(name).alias("rule"), F.lit(child).alias("table_name"), "child_rows", "orphan_rows"))
    return _union(frames)


# Reports of one batch ----------------------------------------------------------
#
# ``arrivals``: the tables with the number of the batch each row came in
# (``batch_id``). A batch's report is the difference it makes to the full one. Stored
# rows count only where they have a key of the batch: a semi join, for which Spark
# builds a Bloom filter from the batch's keys and applies it in the scan of the stored
# ones (``spark.sql.optimizer.runtime.bloomFilter``; a filter on ``batch_id`` makes the
# batch the selective side).

def _keys(df: DataFrame, cols) -> DataFrame:
    return df.select(*[email_key(c).alias(c) if c == "email" else F.col(c) for c in cols]).dropna()


def dq_unique_batch(arrivals: dict[str, DataFrame], batch: int) -> DataFrame:
    """``dq_unique`` over the batches up to ``batch`` less the same before it."""
    frames = []
    for name, table, cols in UNIQUE_RULES:
        df = arrivals[table]
        new = _keys(df.where(F.col("batch_id") == batch), cols)
        old = _keys(df.where(F.col("batch_id") < batch), cols).join(new, list(cols), "left_semi")
        counts = new.groupBy(*cols).agg(F.count(F.lit(1)).alias("_new")).join(
            old.groupBy(*cols).agg(F.count(F.lit(1)).alias("_stored")), list(cols), "left").select("_new", F.coalesce("_stored", F.lit(0)).alias("_old"))
        both = F.col("_old") + F.col("_new")
        frames.append(counts.agg(
            F.count_if((both > 1) & (F.col("_old") <= 1)).alias("duplicate_keys"),
            F.coalesce(F.sum(both - 1 - F.greatest(F.col("_old") - 1, F.lit(0))), F.lit(0)).cast("long").alias("excess_rows"))
            .select(F.lit(name).alias("rule"), F.lit(table).alias("table_name"), "duplicate_keys", "excess_rows"))
    return _union(frames)


def dq_foreign_keys_batch(arrivals: dict[str, DataFrame], batch: int) -> DataFrame:
    """``dq_foreign_keys`` over the batches up to ``batch`` less the same before it:
    the batch's children without a parent, and, taken off, stored children whose
    parent has come with the batch."""
    def counted(df: DataFrame, col: str) -> DataFrame:
        return df.select(F.col(col).alias("_k")).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))

    frames = []
    for name, child, col, parent, pkey in FOREIGN_KEYS:
        is_new, is_old = F.col("batch_id") == batch, F.col("batch_id") < batch
        children = counted(arrivals[child].where(is_new), col)
        parents = arrivals[parent].select(F.col(pkey).alias("_k"), "batch_id").where(F.col("_k").isNotNull())
        new_parents = parents.where(is_new).select("_k").distinct()
        known = parents.where(is_old).select("_k").join(children, "_k", "left_semi").unionByName(new_parents).distinct()
        first_seen = new_parents.join(parents.where(is_old).select("_k").join(new_parents, "_k", "left_semi"), "_k", "left_anti")
        healed = counted(arrivals[child].where(is_old).join(first_seen.withColumnRenamed("_k", col), col, "left_semi"), col)
        orphans = children.join(known, "_k", "left_anti").select("_n").unionByName(healed.select((-F.col("_n")).alias("_n")))
        frames.append(children.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("child_rows")).select(
            F.lit(name).alias("rule"), F.lit(child).alias("table_name"), "child_rows",
            orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long")).scalar().alias("orphan_rows")))
    return _union(frames)


def _stack(df: DataFrame, table: str, names: list[str], value_name: str, label: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.select(F.lit(table).alias("table_name"),
                     F.expr(f"stack({len(names)}, {pairs}) as ({label}, {value_name})"))


def dq_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL counts of every NOT NULL column: one pass per table."""
    frames = []
    for table, cols in NOT_NULL.items():
        agg = tables[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        frames.append(_stack(agg, table, list(cols), "null_rows", "column_name"))
    return _union(frames)


def _domain_rules(table: str) -> list[tuple[str, F.Column]]:
    rules = []
    for col, limit in S.VARCHAR_LIMITS.get(table, {}).items():
        rules.append((f"{col}_longer_than_{limit}", F.length(F.col(col)) > limit))
    for col in MONEY_COLUMNS.get(table, ()):
        rules.append((f"{col}_out_of_decimal_10_2", F.abs(F.col(col)) >= F.lit(float(DECIMAL_LIMIT))))
    if table == "products":
        rules += [("price_negative", F.col("price") < 0),
                  ("name_empty", F.length(F.trim(F.col("name"))) == 0),
                  ("description_empty", F.length(F.trim(F.col("description"))) == 0),
                  ("image_url_not_url", ~F.lower(F.col("image_url")).rlike("^https?://"))]
    if table == "cart":
        rules.append(("quantity_below_1", F.col("quantity") < 1))
    if table == "order_items":
        rules.append(("quantity_below_1", F.col("quantity") < 1))
    return rules


def dq_domain(tables: dict[str, DataFrame]) -> DataFrame:
    """Length limits, DECIMAL(10,2) range and the forms' rules, counted in one
    aggregate per table; plus cart lines above the product's stock."""
    frames = []
    for table in ("users", "sellers", "products", "orders", "order_items", "payments", "cart"):
        rules = _domain_rules(table)
        if not rules:
            continue
        agg = tables[table].agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(n) for n, cond in rules])
        frames.append(_stack(agg, table, [n for n, _ in rules], "violations", "rule"))
    stock = tables["products"].where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.max("stock").alias("stock"))
    over = (tables["cart"].select("product_id", "quantity").join(stock, "product_id").agg(F.count_if(F.col("quantity") > F.col("stock")).alias("quantity_above_stock")))
    frames.append(_stack(over, "cart", ["quantity_above_stock"], "violations", "rule"))
    return _union(frames)


def dq_order_totals(orders: DataFrame, order_items: DataFrame,
                    tax_rate: Decimal = DEFAULT_TAX_RATE) -> DataFrame:
    """Order total against the sum of its lines: equal (the SQL script's
    definition), with_tax (the web checkout's), mismatch, or no_lines."""
    lines = order_items.groupBy("order_id").agg(F.sum("subtotal").cast(S.MONEY_CALC).alias("lines_total"))
    total = F.col("total_amount").cast(S.MONEY_CALC)
    check = (F.when(F.col("lines_total").isNull(), F.lit("no_lines"))
              .when(total == F.col("lines_total"), F.lit("equal"))
              .when(total == total_with_tax(F.col("lines_total"), tax_rate), F.lit("with_tax"))
              .otherwise(F.lit("mismatch")))
    return (orders.select("order_id", "total_amount").join(lines, "order_id", "left")
            .select("order_id", "total_amount", "lines_total", check.alias("total_check")))
