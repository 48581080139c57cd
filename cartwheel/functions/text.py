"""Display fields the shop computed in its templates, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date-time layouts of the shop's pages, in Spark pattern letters.
LONG_DATETIME = "MMMM dd, yyyy hh:mm a"    # 'March 05, 2024 02:07 PM'
SHORT_DATETIME = "yyyy-MM-dd HH:mm"        # '2024-03-05 14:07'
LONG_DATE = "MMMM dd, yyyy"                # 'March 08, 2024'
DELIVERY_DAYS = 3
SKU_PREFIX = "PRD"
EXCERPT_SUFFIX = "..."


def wall_clock(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime (or ISO text), built from text
    so neither the Python process's nor the session's time zone shifts it."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def long_datetime(col) -> Column:
    return F.date_format(_c(col), LONG_DATETIME)


def short_datetime(col) -> Column:
    return F.date_format(_c(col), SHORT_DATETIME)


def delivery_estimate(col, days: int = DELIVERY_DAYS) -> Column:
    return F.date_format(_c(col) + F.expr(f"INTERVAL {int(days)} DAYS"), LONG_DATE)


def excerpt(col, n: int) -> Column:
    """First n characters, always followed by '...'."""
    return F.concat(F.substring(_c(col), 1, n), F.lit(EXCERPT_SUFFIX))


def sku(col) -> Column:
    return F.concat(F.lit(SKU_PREFIX), _c(col).cast("string"))


def title_case(col) -> Column:
    return F.initcap(_c(col))


def email_key(col) -> Column:
    """Normalised e-mail for uniqueness checks (case-insensitive collation)."""
    return F.lower(F.trim(_c(col)))


def like_contains_pattern(term_col) -> Column:
    """'%term%' with the term lower-cased. '%' and '_' in the term stay
    wildcards, as in the shop; backslashes are doubled so a stray one cannot
    act as an escape."""
    t = F.lower(F.coalesce(_c(term_col), F.lit("")))
    t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("%"), t, F.lit("%"))
