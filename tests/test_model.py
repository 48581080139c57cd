"""Model tests: the set-based jobs against brute-force replays and laws."""

import re
import datetime as dt
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from cartwheel.functions.keys import dense_ids
from cartwheel.operators import cart, catalog
from cartwheel.plans import registry
from cartwheel.session import scratch_path
from cartwheel.sources.entities import Shop
from cartwheel.streaming.streams import read_cart, run_cart_stream


def replay(rows):
    """Sequential reference semantics of the shop's cart handlers."""
    lines = {}
    for _, _, u, p, op, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "clear":
            for k in [k for k in lines if k[0] == u]:
                del lines[k]
        elif p is None:
            continue
        elif op == "add":
            lines[(u, p)] = lines.get((u, p), 0) + v
        elif op == "remove" or (op == "set" and (v is None or v <= 0)):
            lines.pop((u, p), None)
        elif op == "set" and (u, p) in lines:
            lines[(u, p)] = v
    return lines


def test_fold_equals_replay(spark):
    ev = Shop.from_raw(spark, SF_MID).cart_events
    rows = [tuple(r) for r in ev.select("event_id", "ts", "user_id", "product_id", "op", "value").collect()]
    got = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    assert got == replay(rows)


def test_fold_with_negative_adds_equals_replay(spark):
    ev = Shop.from_raw(spark, SF_MID).cart_events.withColumn(
        "value", F.when(F.col("op") == "add", F.when(F.col("event_id") % 3 == 0, F.lit(-2)).otherwise(F.lit(1)))
                  .otherwise(F.col("value")))
    rows = [tuple(r) for r in ev.select("event_id", "ts", "user_id", "product_id", "op", "value").collect()]
    got = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    want = replay(rows)
    assert got == want and any(v <= 0 for v in want.values())


def test_hot_user_fold(spark):
    """One user holding a third of all events folds the same as the replay."""
    ev = Shop.from_raw(spark, SF_MID).cart_events.withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("user_id")))
    rows = [tuple(r) for r in ev.select("event_id", "ts", "user_id", "product_id", "op", "value").collect()]
    got = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    assert got == replay(rows)


def test_dense_ids_equal_global_row_number(spark):
    keys = spark.read.parquet(f"{SF_MID}/orders.parquet").select(F.col("o_custkey").alias("k")).distinct()
    got = dense_ids(keys, "k", F.lit(100).cast("long"), "id", bucket_width=64)
    want = keys.withColumn("id", F.row_number().over(Window.orderBy("k")) + 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_ids_sparse_keys_two_levels(spark):
    keys = spark.range(0, 3000).select((F.col("id") * F.col("id") * 7 + 3).alias("k"))
    got = dense_ids(keys, "k", F.lit(0).cast("long"), "id", bucket_width=4)
    want = keys.withColumn("id", F.row_number().over(Window.orderBy("k")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_ids_running_sums(spark):
    keys = spark.range(0, 500).select((F.col("id") * 13 + 5).alias("k"), (F.col("id") % 7).alias("w"))
    got = dense_ids(keys, "k", F.lit(10).cast("long"), "id", bucket_width=8,
                    sums={"start": (F.lit(1000).cast("long"), "w")}).collect()
    rows = sorted((r.k, r.w, r.id, r.start) for r in got)
    acc = 1000
    for i, (k, w, ident, start) in enumerate(rows):
        assert ident == 10 + i + 1 and start == acc
        acc += w


def test_nested_history_in_bounded_parts(spark):
    from cartwheel.operators import orders as O
    shop = Shop.from_raw(spark, SF_SMALL)
    whole = O.order_history_nested(shop.orders, shop.order_items, shop.products)
    parts = O.order_history_nested(shop.orders, shop.order_items, shop.products, max_items_per_row=2)
    merged = (parts.groupBy("order_id").agg(F.flatten(F.collect_list(F.coalesce("items", F.array()))).alias("all"))
              .select("order_id", F.sort_array("all").alias("all")))
    want = whole.select("order_id", F.coalesce(F.col("items"), F.array()).alias("all"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect()))
    biggest = parts.select(F.max(F.size("items"))).collect()[0][0]
    assert biggest < whole.select(F.max(F.size("items"))).collect()[0][0]


def test_search_equals_a_plain_scan(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    extra = spark.createDataFrame([(t,) for t in ("red", "ring", "bolt", "brand#2", "r%g", "%", "_", "a_c",
                                                  "bra%1", "wid_et", "%ring%", "d wid", "ed", "re%bo", "__")],
                                  "term string")
    terms = shop.search_terms.unionByName(extra)
    want = set()
    for term in {r.term for r in terms.collect()}:
        pattern = re.compile(".*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in term.lower()) + ".*", re.DOTALL)
        want |= {(term, r.product_id) for r in shop.products.collect()
                 if pattern.fullmatch(r.name.lower()) or pattern.fullmatch(r.description.lower())}
    got = [tuple(r) for r in catalog.product_search(shop.products, terms).collect()]
    assert len(got) == len(want) and set(got) == want


def test_checkout_conservation(spark):
    r = registry._checkout(spark, SF_MID)
    lines = r.lines.agg(F.sum("quantity").alias("q")).collect()[0].q
    shop = Shop.from_raw(spark, SF_MID)
    before = shop.products.agg(F.sum("stock")).collect()[0][0]
    after = r.stock.agg(F.sum("stock")).collect()[0][0]
    assert before - after == lines
    ids = [x.order_id for x in r.orders.orderBy("order_id").collect()]
    top = shop.orders.agg(F.max("order_id")).collect()[0][0]
    assert ids == list(range(top + 1, top + 1 + len(ids)))
    assert r.cart_after.join(r.orders, "user_id", "left_semi").count() == 0
    known = {x.user_id for x in registry.feeds.known_users(shop.users).collect()}
    assert {x.user_id for x in r.orders.collect()} <= known
    items = [(x.order_id, x.product_id, x.item_id) for x in r.lines.collect()]
    top_item = shop.order_items.agg(F.max("item_id")).collect()[0][0]
    assert [i for _, _, i in sorted(items)] == list(range(top_item + 1, top_item + 1 + len(items)))
    pays = sorted((x.order_id, x.payment_id) for x in r.payments.collect())
    top_pay = shop.payments.agg(F.max("payment_id")).collect()[0][0]
    assert [p for _, p in pays] == list(range(top_pay + 1, top_pay + 1 + len(pays)))
    per_order = r.lines.groupBy("order_id").agg(F.sum("subtotal").alias("s")).join(r.orders, "order_id")
    bad = per_order.where(F.abs(F.col("s") * F.lit(1.1) - F.col("total_amount")) > F.lit(0.01)).count()
    assert bad == 0


def test_compacted_log_folds_the_same(spark):
    ev = Shop.from_raw(spark, SF_MID).cart_events
    full = {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(ev).collect()}
    compact = cart.compact_cart_log(ev)
    assert compact.count() < ev.count()
    assert {(r.user_id, r.product_id): r.quantity for r in cart.fold_cart_events(compact).collect()} == full


def test_cart_stream_in_event_order_equals_batch(spark):
    src = scratch_path(spark, "test-cart-source")
    from cartwheel.session import local_fs_path
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(6)]
    for i, (lo, hi) in enumerate(zip(days, days[1:])):
        part = ev.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        part.coalesce(1).write.parquet(f"{src}/slice{i}")
        produced = [f for f in os.listdir(local_fs_path(f"{src}/slice{i}")) if f.endswith(".parquet")]
        os.rename(os.path.join(local_fs_path(f"{src}/slice{i}"), produced[0]),
                  os.path.join(local_fs_path(src), f"events{i:03d}.parquet"))
    path = run_cart_stream(spark, src, max_files_per_trigger=1)
    got = {(r.user_id, r.product_id): r.quantity for r in read_cart(spark, path).collect()}
    want = {(r.user_id, r.product_id): r.quantity for r in Shop.from_raw(spark, SF_MID).cart.collect()}
    assert got == want


def test_order_labels_in_bounded_parts(spark):
    from cartwheel.operators import sellers as SL
    shop = Shop.from_raw(spark, SF_SMALL)
    whole = {r.order_id: sorted(r.products.split(", ")) for r in SL.order_labels(shop.order_items, shop.products).collect()}
    parts = SL.order_labels(shop.order_items, shop.products, max_labels_per_row=2).collect()
    merged = {}
    for r in parts:
        merged.setdefault(r.order_id, []).extend(r.products.split(", "))
    assert {k: sorted(v) for k, v in merged.items()} == whole
    assert max(len(r.products.split(", ")) for r in parts) < max(len(v) for v in whole.values())
