"""Screen-level calls on the seed rows."""

from decimal import Decimal as D

import seed
from cartwheel.operators import screens
from cartwheel.sources.entities import Shop


class SeedShop(Shop):
    def __init__(self, spark):
        super().__init__(spark)
        self.__dict__.update(users=seed.users(spark), sellers=seed.sellers(spark), products=seed.products(spark),
                             cart=seed.cart(spark), orders=seed.orders(spark),
                             order_items=seed.order_items(spark), payments=seed.payments(spark))


def test_screens_on_seed(spark):
    shop = SeedShop(spark)
    assert [r.product_id for r in screens.home(shop).orderBy("product_id").collect()] == [1, 2, 3, 4]
    assert sorted(r.product_id for r in screens.search(shop, "phone").collect()) == [1, 2, 4]
    assert screens.product_page(shop, 3).collect()[0].sku == "PRD3"
    lines, totals = screens.cart_page(shop, 1)
    assert lines.count() == 2 and totals.collect()[0].total == D("1979.98")
    _, _, customer = screens.checkout_preview(shop, 1)
    assert customer.collect()[0].email == "test@example.com"
    header, items = screens.order_confirmation(shop, 1, 1)
    assert header.collect()[0].payment_method == "Credit Card" and items.count() == 2
    header2, items2 = screens.order_confirmation(shop, 1, 2)   # someone else's order
    assert header2.count() == 0 and items2.count() == 0
    hist = screens.order_history_page(shop, 1).collect()
    assert [r.order_id for r in hist] == [1] and len(hist[0]["items"]) == 2
    own, pending = screens.seller_dashboard(shop, 1)
    assert own.count() == 4 and [r.order_id for r in pending.collect()] == [1]
    h, li = screens.seller_order_page(shop, 1)
    assert h.collect()[0].customer_email == "test@example.com" and li.count() == 2
