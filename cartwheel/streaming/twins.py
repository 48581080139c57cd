"""Registered stream twins: run the stream over the raw table to completion,
read the sink back, and return the rows the batch twin returns."""

from __future__ import annotations

from cartwheel import schemas as S
from cartwheel.operators.orders import orders_with_effects
from cartwheel.sources import feeds
from cartwheel.streaming.streams import (read_cart, read_payments, read_status_table, run_cart_stream,
                                         run_payment_stream, run_status_stream)


def q_stream_cart(spark, sf):
    return read_cart(spark, run_cart_stream(spark, sf, prepare=feeds.dirty_events))


def q_stream_payments(spark, sf):
    return read_payments(spark, run_payment_stream(spark, sf)).select(*S.PAYMENTS.names)


def q_stream_order_status(spark, sf):
    from cartwheel.plans.registry import _shop
    return orders_with_effects(_shop(spark, sf).orders, read_status_table(spark, run_status_stream(spark, sf)))


STREAM_QUERIES = {
    "stream_cart": q_stream_cart,
    "stream_payments": q_stream_payments,
    "stream_order_status": q_stream_order_status,
}
