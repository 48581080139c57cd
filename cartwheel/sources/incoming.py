"""The shop's tables as they arrive, before any constraint has been enforced: the
clean rows and, next to them, rows that break each rule of the DDL. The
data-quality reports run over these, with money as it was sent (DOUBLE), so a
value that no DECIMAL(10,2) holds is counted instead of failing a cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas as S

# Which rows (key modulo BAD_EVERY) are also sent in which bad form.
BAD_EVERY = 50
TWICE, NULLS, NO_KEY, LONG, RANGE, ORPHAN, NEGATIVE, TOO_MANY = 8, 12, 14, 16, 18, 22, 32, 34
EQUAL, TAXED = 21, 23
KEY_STEP = 1_000_000_000_000     # bad copies get keys of their own


def incoming(df: DataFrame, key: str, required: tuple[str, ...], text: dict[str, int], money: tuple[str, ...],
             references: tuple[str, ...]) -> DataFrame:
    """``df`` and its bad copies."""
    wide = df.withColumns({c: F.col(c).cast("double") for c in money})
    kinds, k = dict(wide.dtypes), F.col(key)
    changes: dict[int, dict[str, F.Column]] = {
        TWICE: {}, NO_KEY: {}, NULLS: {c: F.lit(None).cast(kinds[c]) for c in required if c != key},
        ORPHAN: {c: F.lit(-1).cast("long") for c in references}}
    if text:
        changes[LONG] = {c: F.repeat(F.lit("x"), n + 1) for c, n in text.items()}
    if money:
        changes[RANGE] = {c: F.lit(1e9) for c in money}
    if "quantity" in kinds:
        changes[NEGATIVE], changes[TOO_MANY] = {"quantity": F.lit(0)}, {"quantity": F.lit(1_000_000)}
    if "price" in kinds:
        changes[NEGATIVE] = {"price": F.lit(-1.0), "name": F.lit("  "), "description": F.lit(""),
                             "image_url": F.lit("https://example.com/x.jpg")}
    # One pass: a row comes out as it is and, by its key, once more in a bad form.
    form = (k % BAD_EVERY).cast("int")
    out = wide.withColumn("_form", F.explode(F.when(form.isin(list(changes)), F.array(F.lit(0), form)).otherwise(F.array(F.lit(0)))))

    def value(column: str) -> F.Column:
        c = F.col(column)
        if column == key:
            return F.when(F.col("_form") == NO_KEY, F.lit(None).cast("long")) \
                .when(F.col("_form").isin(0, TWICE), c).otherwise(c + F.col("_form") * F.lit(KEY_STEP))
        for number, put in changes.items():
            if column in put:
                c = F.when(F.col("_form") == number, put[column]).otherwise(c)
        return c.alias(column)

    return out.select(*[value(c).alias(c) for c in wide.columns])


def incoming_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All seven tables in their incoming form."""
    from cartwheel.operators.quality import FOREIGN_KEYS, MONEY_COLUMNS, NOT_NULL, PRIMARY_KEYS
    refs = {t: tuple(col for _, child, col, _, _ in FOREIGN_KEYS if child == t) for t in tables}
    return {t: incoming(df, PRIMARY_KEYS[t], NOT_NULL[t], S.VARCHAR_LIMITS.get(t, {}), MONEY_COLUMNS.get(t, ()), refs[t])
            for t, df in tables.items()}


def retotalled(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders of which some carry their lines' sum and some that sum with tax."""
    sums = lines.groupBy("order_id").agg(F.sum("subtotal").cast(S.MONEY_CALC).alias("_sum"))
    form = F.col("order_id") % BAD_EVERY
    total = F.when(form == EQUAL, F.col("_sum")).when(form == TAXED, F.round(F.col("_sum") * F.lit("1.1").cast("decimal(2,1)"), 2))
    return orders.join(sums, "order_id", "left").withColumn(
        "total_amount", F.coalesce(total.cast(S.MONEY_CALC), F.col("total_amount").cast(S.MONEY_CALC))).select(*orders.columns)


def arrivals(tables: dict[str, DataFrame], batches: int = 4) -> dict[str, DataFrame]:
    """The incoming tables, their rows dealt to ``batches`` by key (``batch_id``; rows
    without a key come with the last one)."""
    from cartwheel.operators.quality import PRIMARY_KEYS
    return {t: df.withColumn("batch_id", F.pmod(F.coalesce(F.col(PRIMARY_KEYS[t]), F.lit(-1)), F.lit(batches)).cast("int"))
            for t, df in incoming_tables(tables).items()}
