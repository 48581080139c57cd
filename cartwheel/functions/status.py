"""Case-insensitive status handling: compare on lower(), emit one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _canonical(col, spellings) -> Column:
    low = F.lower(F.trim(_c(col)))
    expr = None
    for s in spellings:
        cond = low == F.lit(s.lower())
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    return expr.otherwise(_c(col))


def canonical_order_status(col) -> Column:
    return _canonical(col, ("Pending", "Processing", "Shipped", "Cancelled"))


def canonical_approval(col) -> Column:
    return _canonical(col, ("Pending", "Approved", "Rejected"))


def is_status(col, value: str) -> Column:
    return F.lower(F.trim(_c(col))) == F.lit(value.lower())


def approval_badge(col) -> Column:
    return F.when(is_status(col, "approved"), F.lit("success")).otherwise(F.lit("warning"))


def payment_badge(col) -> Column:
    low = F.lower(_c(col))
    return F.when(low.isin("completed", "paid"), F.lit("success")).otherwise(F.lit("warning"))


def stock_badge(col) -> Column:
    """stock > 0 is in stock; zero or negative (oversold) is out of stock."""
    return F.when(_c(col) > 0, F.lit("in_stock")).otherwise(F.lit("out_of_stock"))
