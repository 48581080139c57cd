"""Seed rows of the shop's SQL script, as typed DataFrames (golden fixtures)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from cartwheel import schemas as S

# The shop's seed catalogue (id, name, description, price, stock, category).
PRODUCTS = [
    (1, "iPhone 13 Pro", "Latest Apple iPhone with A15 Bionic chip, Pro camera system, and Super Retina XDR display.", "999.99", 50, "Electronics"),
    (2, "Samsung Galaxy S21", "Powerful Android smartphone with 5G capability, triple camera system, and 120Hz display.", "799.99", 45, "Electronics"),
    (3, "MacBook Pro M1", "Apple's revolutionary laptop with M1 chip, Retina display, and all-day battery life.", "1299.99", 30, "Electronics"),
    (4, "Sony WH-1000XM4", "Premium noise-cancelling headphones with exceptional sound quality and long battery life.", "349.99", 60, "Electronics"),
    (5, "Nike Air Max 270", "Comfortable and stylish sneakers with Air cushioning and breathable mesh upper.", "150.00", 100, "Fashion"),
    (6, "Adidas Ultraboost", "Responsive running shoes with Boost midsole and Primeknit upper.", "180.00", 75, "Fashion"),
    (7, "Levi's 501 Jeans", "Classic straight-leg jeans with button fly and iconic Levi's quality.", "59.99", 200, "Fashion"),
    (8, "The North Face Jacket", "Waterproof and insulated jacket perfect for outdoor adventures.", "199.99", 40, "Fashion"),
    (9, "Dyson V11 Vacuum", "Cordless vacuum cleaner with powerful suction and intelligent cleaning modes.", "599.99", 25, "Home"),
    (10, "Instant Pot Duo", "7-in-1 multi-cooker for pressure cooking, slow cooking, and more.", "89.99", 80, "Home"),
    (11, "KitchenAid Mixer", "Professional stand mixer with 10 speeds and multiple attachments.", "299.99", 35, "Home"),
    (12, "Philips Hue Starter Kit", "Smart lighting system with color-changing bulbs and bridge.", "199.99", 50, "Home"),
]
SELLER_1_PRODUCTS = (1, 2, 3, 4)
T0 = dt.datetime(2024, 3, 5, 14, 7)


def products(spark):
    rows = [(i, n, d, D(p), s, c, "https://example.com/img.jpg", T0, 1 if i in SELLER_1_PRODUCTS else None)
            for i, n, d, p, s, c in PRODUCTS]
    return spark.createDataFrame(rows, S.PRODUCTS)


def users(spark):
    return spark.createDataFrame(
        [(1, "Test User", "test@example.com", "123 Test Street, Test City, TC 12345", "1234567890", T0)], S.USERS)


def sellers(spark):
    return spark.createDataFrame([(1, "Test Seller", "seller@example.com", "9876543210", T0),
                                  (2, "Second Seller", "second@example.com", "0000000002", T0)], S.SELLERS)


def cart(spark, with_repeat=False):
    rows = [(1, 1, 1, 1, T0), (2, 1, 2, 1, T0), (3, 2, 4, 1, T0)]
    if with_repeat:
        rows += [(4, 1, 1, 1, T0), (5, 1, 2, 1, T0), (6, 2, 4, 1, T0)]
    return spark.createDataFrame(rows, S.CART)


def orders(spark):
    return spark.createDataFrame([(1, 1, D("95.49"), "Shipped", T0, "Pending", None),
                                  (2, 2, D("599.00"), "Pending", T0, "Pending", None)], S.ORDERS)


def order_items(spark):
    return spark.createDataFrame([(1, 1, 1, 1, D("25.99")), (2, 1, 2, 1, D("69.50")),
                                  (3, 2, 4, 1, D("599.00"))], S.ORDER_ITEMS)


def payments(spark):
    return spark.createDataFrame([(1, 1, 1, D("95.49"), "Completed", "Credit Card", T0),
                                  (2, 2, 2, D("599.00"), "Pending", "PayPal", T0)], S.PAYMENTS)


def events(spark, rows):
    """rows: (event_id, user_id, product_id, op, value); ts increases with event_id."""
    return spark.createDataFrame(
        [(e, T0 + dt.timedelta(minutes=e), u, p, op, v) for e, u, p, op, v in rows], S.CART_EVENTS)
