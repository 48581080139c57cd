"""Exact money arithmetic: decimals throughout, HALF_UP rounding once at the end."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwheel.schemas import MONEY_CALC

DEFAULT_TAX_RATE = Decimal("0.1")


def as_money(col) -> Column:
    """Cast to decimal(18,2); Spark rounds HALF_UP on the way down."""
    return F.col(col).cast(MONEY_CALC) if isinstance(col, str) else col.cast(MONEY_CALC)


def line_subtotal(price: str = "price", quantity: str = "quantity") -> Column:
    """price * quantity, exact, as decimal(18,2)."""
    return as_money(F.col(price) * F.col(quantity))


def tax_amount(subtotal: Column, rate: Decimal = DEFAULT_TAX_RATE) -> Column:
    return F.round(subtotal * F.lit(rate), 2).cast(MONEY_CALC)


def total_with_tax(subtotal: Column, rate: Decimal = DEFAULT_TAX_RATE) -> Column:
    """subtotal * (1 + rate), rounded once (1979.978 -> 1979.98)."""
    return F.round(subtotal * F.lit(Decimal(1) + rate), 2).cast(MONEY_CALC)


def money_text(col, symbol: str = "₹") -> Column:
    """'₹1234.50': two decimals via decimal->string, never through a float."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(symbol), c.cast(MONEY_CALC).cast("string"))
