"""Tables, views and streams that cost what changes: what is written, what isn't
read again, and that the rows are those of the whole-table operators."""

import os
import random
import shutil

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions.keys import dense_ids, newest, range_number, ranked, splitters
from cartwheel.operators import catalog, orders, sellers
from cartwheel.plans import views
from cartwheel.session import local_fs_path, scratch_path, written
from cartwheel.sources import tables
from cartwheel.sources.entities import Shop
from cartwheel.streaming.streams import (compact_cart_stream, read_cart, read_payments, run_cart_stream, run_payment_stream)

BUCKETS = 16


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(local_fs_path(path)) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- tables that change in place ---------------------------------------------

def stored(spark, df, key):
    path = scratch_path(spark, "test-table")
    tables.save_table(df, path, key, BUCKETS)
    return path


def test_only_touched_buckets_are_rewritten(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    payments = written(shop.payments, "test-payments")
    path = stored(spark, payments, "order_id")
    changes = shop.payment_method_changes.where(F.col("order_id").isin([r[0] for r in shop.payment_method_changes.select("order_id").take(3)]))
    before = files(path)
    touched = tables.change_table(spark, path, S.PAYMENTS, "order_id", BUCKETS, changes,
                                  lambda p: orders.update_payment_method(p, changes))
    assert 0 < len(touched) <= 3
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept <= files(path) and not (before - kept) & files(path)
    assert rows(tables.read_table(spark, path, S.PAYMENTS)) == rows(orders.update_payment_method(payments, changes))


def test_status_decisions_and_purge_in_place(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    table = written(shop.orders, "test-orders")
    path = stored(spark, table, "order_id")
    decisions = shop.status_events.where("kind = 'approval' and order_id % 7 = 0").select(
        "event_id", "ts", "order_id", F.lit(None).cast("long").alias("seller_id"), "value")
    tables.change_table(spark, path, S.ORDERS, "order_id", BUCKETS, decisions, lambda o: orders.seller_decisions(o, decisions))
    now = tables.read_table(spark, path, S.ORDERS)
    decided = {r.order_id for r in decisions.select("order_id").collect()}
    want = {r.order_id: tuple(r) for r in orders.seller_decisions(table, decisions).collect()}
    old = {r.order_id: tuple(r) for r in table.collect()}
    got = {r.order_id: tuple(r) for r in now.collect()}
    assert got.keys() == old.keys() and all(got[i] == want[i] for i in decided & got.keys())
    tables.change_table(spark, path, S.ORDERS, "order_id", BUCKETS, now.select("order_id"), lambda o: orders.orders_purged(o, shop.payments))
    assert rows(tables.read_table(spark, path, S.ORDERS).select("order_id")) == rows(orders.orders_purged(table, shop.payments).select("order_id"))


def test_product_changes_in_place_with_adds_and_emptied_buckets(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    products = written(shop.products, "test-products")
    path = stored(spark, products, "product_id")
    changes = written(shop.product_changes, "test-changes")
    outcomes = written(sellers.product_change_outcomes(products, changes), "test-outcomes")
    tables.change_table(spark, path, S.PRODUCTS, "product_id", BUCKETS, outcomes,
                        lambda p: sellers.apply_product_changes(p, changes, outcomes)[0])
    assert rows(tables.read_table(spark, path, S.PRODUCTS)) == rows(sellers.apply_product_changes(products, changes)[0])
    gone = tables.read_table(spark, path, S.PRODUCTS).where(tables.bucket_of("product_id", BUCKETS) == 3)
    tables.change_table(spark, path, S.PRODUCTS, "product_id", BUCKETS, gone.limit(1), lambda p: p.where("false"))
    assert not [f for f in files(path) if "bucket=3/" in f]
    with pytest.raises(ValueError):
        tables.change_table(spark, path, S.PRODUCTS, "product_id", BUCKETS, products.limit(1), lambda p: products)


# ---- stored views -------------------------------------------------------------

@pytest.mark.parametrize("name", list(views.ORDER_VIEWS))
def test_view_after_batches_equals_the_recomputed_one(spark, name):
    shop, rng = Shop.from_raw(spark, SF_SMALL), random.Random(5)
    now = {t: written(getattr(shop, t), f"test-{t}") for t in ("orders", "payments", "order_items", "products", "users")}
    path = scratch_path(spark, "test-view")
    views.store_view(name, now, path, BUCKETS)
    for _ in range(3):
        some = [rng.randrange(1, 1500) for _ in range(4)]
        changed = {t: now[t].where(F.col(k).isin(some)).select(k) for t, k in (("orders", "order_id"), ("payments", "order_id"), ("users", "user_id"), ("products", "product_id"))}
        now |= {"orders": now["orders"].withColumn("order_status", F.when(F.col("order_id").isin(some), "Shipped").otherwise(F.col("order_status"))),
                "payments": now["payments"].where(~(F.col("order_id").isin(some[:2]))),
                "users": now["users"].withColumn("name", F.when(F.col("user_id").isin(some), F.concat("name", F.lit("!"))).otherwise(F.col("name"))),
                "products": now["products"].withColumn("name", F.when(F.col("product_id").isin(some), F.lit("renamed")).otherwise(F.col("name")))}
        now = {t: written(df, f"test-{t}") for t, df in now.items()}
        views.refresh_view(name, now, changed, path, BUCKETS)
        want = views.ORDER_VIEWS[name](now)
        assert rows(tables.read_table(spark, path, want.schema)) == rows(want)


# ---- streams ------------------------------------------------------------------

def one_file(df, folder, name):
    out = f"{folder}/tmp-{name}"
    df.coalesce(1).write.parquet(out)
    part = next(f for f in os.listdir(local_fs_path(out)) if f.endswith(".parquet"))
    shutil.copyfile(os.path.join(local_fs_path(out), part), os.path.join(local_fs_path(folder), f"{name}.parquet"))


def test_payments_are_not_read_again(spark):
    """With the earlier batches' payments out of reach, orders delivered again still
    get none, and ids go on: a batch doesn't read them."""
    src, work = scratch_path(spark, "test-orders-source"), scratch_path(spark, "test-payment-stream")
    raw = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    one_file(raw.where("o_orderkey % 3 = 0"), src, "orders000")
    first = read_payments(spark, run_payment_stream(spark, src, work)).count()
    shutil.move(f"{local_fs_path(work)}/payments", f"{local_fs_path(work)}/elsewhere")
    one_file(raw.where("o_orderkey % 3 = 0 or o_orderkey % 3 = 1"), src, "orders001")
    got = read_payments(spark, run_payment_stream(spark, src, work))
    assert got.where("order_id % 3 <> 1").count() == 0
    assert got.agg(F.min("payment_id"), F.count("*")).first()[:] == (first + 1, raw.where("o_orderkey % 3 = 1").count())
    state = [f for f in os.listdir(f"{local_fs_path(work)}/checkpoint/state/0/0")]
    assert any(f.endswith(".changelog") for f in state)


def test_a_cart_batch_writes_its_users_rows(spark):
    """200 of 5,000 users: about 200 users' lines and events are written."""
    src, work = scratch_path(spark, "test-events-source"), scratch_path(spark, "test-cart-stream")
    def events(ids, kind="click"):
        return ids.select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
                          F.pmod("id", F.lit(5_000)).alias("user_id"), F.lit(kind).alias("event_type"), F.lit(1.0).alias("value"),
                          F.concat(F.lit('{"k": '), F.pmod("id", F.lit(7)).cast("string"), F.lit("}")).alias("props"))

    one_file(events(spark.range(10_000)), src, "events000")
    run_cart_stream(spark, src, work)
    one_file(events(spark.range(10_000, 10_200)), src, "events001")
    run_cart_stream(spark, src, work)
    lines = spark.read.parquet(f"{work}/state/batch_id=1")
    assert lines.select("user_id").distinct().count() == 200 and lines.count() <= 600
    assert spark.read.parquet(f"{work}/log/batch_id=1").count() == 600
    cart = rows(read_cart(spark, work))
    assert len(cart) > 9_000 and len({r[0] for r in cart}) == len(cart)
    compacted = compact_cart_stream(spark, work)
    assert rows(read_cart(spark, compacted)) == cart
    one_file(events(spark.range(10_200, 10_210), "purchase"), src, "events002")
    run_cart_stream(spark, src, compacted)
    left = read_cart(spark, compacted)
    assert left.where(F.col("user_id").between(200, 209)).count() == 0 and left.count() < len(cart)


# ---- ids and ranks --------------------------------------------------------------

def test_sparse_keys_fill_ranges_evenly(spark):
    """Keys spread over 2^62, most of them clustered: no range has much more than
    its share, and the ids are those of one sort."""
    keys = written(spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(1 << 62))).otherwise(F.col("id") + (1 << 40)).alias("k")), "t")
    bounds = splitters(keys, "k", 100)
    sizes = [r["count"] for r in keys.groupBy(range_number(F.col("k"), bounds).alias("r")).count().collect()]
    assert len(sizes) == 60 and max(sizes) <= 130
    got = [r.id for r in dense_ids(keys, "k", F.lit(0), "id", bucket_width=100).orderBy("k").collect()]
    assert got == list(range(1, 6001))


def test_ranks_of_hot_groups(spark):
    """A third of the rows in one group, a third equal in everything: ranks and
    running sums are whole, and no written partition holds a group."""
    df = written(spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("g"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), (F.col("id") % 5).alias("w")), "test-rank")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(df, ["g"], ["k"], "test-ranked", sums={"before": "w"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = sorted((r for r in got if r.g == "hot"), key=lambda r: r["rank"])
    assert [r.k for r in hot] == sorted(r.k for r in hot) and all(r.total == 3000 for r in hot)
    total = 0
    for r in hot:
        assert r.before == total
        total += r.w
    assert sorted(r["rank"] for r in got if r.g is None) == list(range(3000))
    assert all(r["rank"] == 0 and r.total == 1 and r.before == 0 for r in got if r.g not in (None, "hot"))


# ---- search -----------------------------------------------------------------------

def test_search_index_splits_long_lists(spark, monkeypatch):
    monkeypatch.setattr(catalog, "LIST_ROWS", 50)
    shop = Shop.from_raw(spark, SF_SMALL)
    path = scratch_path(spark, "test-index")
    catalog.build_search_index(shop.products, path)
    index = catalog.read_search_index(spark, path)
    sizes = index.postings.groupBy("gram", "part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 50 < index.grams.agg(F.max("freq")).first()[0]
    terms = spark.createDataFrame([(t,) for t in ("red", "BRAND#1%ring", "ing", "e", "r_ng", "d wid", "zzz", "ring%brand", "#")], "term string")
    got = rows(catalog.product_search(shop.products, terms, index))
    texts = [(p.product_id, p.name.lower(), p.description.lower()) for p in shop.products.collect()]

    def like(text, term):
        import re
        return re.search("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in term.lower()), text, re.DOTALL) is not None
    want = sorted(((t, i) for (t,) in terms.collect() for i, n, d in texts if like(n, t) or like(d, t)), key=str)
    assert got == want


def test_search_keeps_no_candidate_pairs(spark):
    """Pairs of a term and a product are tested where they arise: no aggregate, sort or
    shuffle is keyed by both, nor are candidates grouped by product for each term."""
    import re
    shop = Shop.from_raw(spark, SF_SMALL)
    terms = shop.raw("part").select(F.concat_ws("%", "p_brand", "p_name").alias("term"))
    plan = catalog.product_search(shop.products, terms)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(keys=\[|hashpartitioning\(|Sort \[)(term#\d+[^,\]]*, product_id#|product_id#\d+L?[^,\]]*, term#)", plan)
    for exchange in re.findall(r"Exchange (?:hash|range)partitioning\(product_id.*?\n(.*?)\n", plan):
        assert "term#" not in exchange


def test_search_of_repeated_ids_nulls_and_short_terms(spark):
    """Every row of a product id that comes several times is one hit of a term, however
    many grams of it start with a short term; null names, descriptions and ids."""
    products = written(spark.createDataFrame(
        [(1, "Red ring red", "r re RED"), (1, "Red ring red", "r re RED"), (1, "blue bolt", None), (2, None, "reddish"), (3, None, ""),
         (None, "red", "ring"), (4, "", "r"), (5, "ab", "re"), (6, "a red b", "bolt%ring")], "product_id long, name string, description string"), "t-odd")
    terms = ["r", "re", "RED", "red ring", "e", "b", "r_n", "red%ring", "bolt", "%re", "zz", "d r", None, "", "_"]
    for broadcast in ("10485760", "-1"):
        conf = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.autoBroadcastJoinThreshold": broadcast}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            got = rows(catalog.product_search(products, spark.createDataFrame([(t,) for t in terms + ["re", "red ring"]], "term string")))
        finally:
            for k in conf:
                spark.conf.unset(k)

        def like(text, term):
            import re
            low = (term or "").lower()
            return text is not None and re.search("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in low), text.lower(), re.DOTALL) is not None
        # a product without an id is no entry of the index: only terms without a literal character find it
        want = sorted(((t, p.product_id) for t in terms for p in products.collect() if (like(p.name, t) or like(p.description, t))
                       and (p.product_id is not None or not (t or "").strip("%_"))), key=str)
        assert got == want


# ---- large orders and first pages ---------------------------------------------------

def test_parts_of_a_large_order_join_to_the_whole(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    n = shop.products.count()
    big = spark.range(30_000).select(F.lit(1).cast("long").alias("order_id"), (F.col("id") % n + 1).alias("product_id"),
                                     (F.col("id") % 9 + 1).cast("int").alias("quantity"), F.lit(1).cast(S.MONEY).alias("subtotal"))
    lines = written(shop.order_lines.where("order_id <> 1").unionByName(big), "test-lines")
    whole = {r.order_id: r.products for r in sellers.order_labels(lines, shop.products).collect()}
    parts = {}
    for r in sellers.order_labels(lines, shop.products, max_labels_per_row=1000).orderBy("order_id", "part").collect():
        parts.setdefault(r.order_id, []).append(r.products)
    assert {k: ", ".join(v) for k, v in parts.items()} == whole and len(parts[1]) == 30
    nested = orders.order_history_nested(shop.orders, lines, shop.products, max_items_per_row=1000).where("order_id = 1").orderBy("part").collect()
    one = orders.order_history_nested(shop.orders, lines, shop.products).where("order_id = 1").first()
    assert [tuple(x) for r in nested for x in r["items"]] == [tuple(x) for x in one["items"]]
    assert [len(r["items"]) for r in nested] == [1000] * 29 + [len(one["items"]) - 29_000]


def test_first_pages_are_cut_before_the_shuffle(spark):
    shop = Shop.from_raw(spark, SF_SMALL)
    page = orders.order_history(shop.orders, shop.payments, last=2)
    assert "WindowGroupLimit" in page._jdf.queryExecution().executedPlan().toString()
    full = {}
    for r in orders.order_history(shop.orders, shop.payments).collect():
        full.setdefault(r.user_id, []).append(tuple(r))
    assert [tuple(r) for r in page.collect()] == [r for user in sorted(full) for r in full[user][:2]]
    dated = written(shop.products.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("product_id") % 7 * 86400)), "t")
    want = {}
    for r in sellers.seller_products(dated).collect():
        want.setdefault(r.seller_id, []).append(tuple(r))
    assert [tuple(r) for r in sellers.seller_products(dated, last=3).collect()] == [r for s in sorted(want) for r in want[s][:3]]
    assert newest(dated, "seller_id", ["created_at", "product_id"], 1).where("seller_id is not null").count() == len(want)


# ---- reports of a batch -----------------------------------------------------------------

def test_batch_reports_read_stored_keys_through_a_filter(spark):
    """The report of a batch is the full report's difference (the oracle test compares
    the registered ones); its plan filters the stored keys by the batch's in the scan."""
    from cartwheel.operators import quality
    from cartwheel.sources.incoming import arrivals
    shop = Shop.from_raw(spark, SF_SMALL)
    given = {t: written(df, f"test-{t}") for t, df in arrivals({t: getattr(shop, t) for t in (
        "users", "sellers", "products", "cart", "orders", "order_items", "payments")}).items()}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        report = quality.dq_unique_batch(given, 3)
        assert "might_contain" in report._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for full, part in ((quality.dq_unique, quality.dq_unique_batch), (quality.dq_foreign_keys, quality.dq_foreign_keys_batch)):
        before = {r.rule: r for r in full({t: df.where("batch_id < 2") for t, df in given.items()}).collect()}
        after = {r.rule: r for r in full({t: df.where("batch_id <= 2") for t, df in given.items()}).collect()}
        got = {r.rule: tuple(r)[2:] for r in part(given, 2).collect()}
        assert got == {k: tuple(a - b for a, b in zip(tuple(after[k])[2:], tuple(before[k])[2:])) for k in after}


def test_batch_reports_derive_no_table_again(spark):
    """The registered reports read stored keys; their rules number no order items and fold no cart."""
    from cartwheel.operators import quality
    from cartwheel.plans import registry
    report = quality.dq_foreign_keys_batch(registry._stored_keys(registry.given_shop(spark, SF_SMALL)), 3)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "l_orderkey" not in plan and "get_json_object" not in plan
