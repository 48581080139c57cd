"""Stream/batch twins under shuffled file order and repeated files."""

import os
import shutil

from pyspark.sql import functions as F

from paths import SF_MID
from cartwheel.operators import orders as O
from cartwheel.session import local_fs_path, scratch_path
from cartwheel.sources.entities import Shop
from cartwheel.streaming.streams import (compact_status_log, read_cart, read_payments, read_status_table, run_cart_stream,
                                         run_payment_stream, run_status_stream)


def _split(spark, table, n, order, repeat=None):
    """Write ``table`` as n files named <table>NNN.parquet, created in ``order``;
    ``repeat`` copies one slice under a second name (a re-delivered file)."""
    src = scratch_path(spark, f"test-{table}-source")
    df = spark.read.parquet(f"{SF_MID}/{table}.parquet")
    key = "event_id" if table == "events" else "o_orderkey"
    for i in order:
        out = f"{src}/tmp{i}"
        df.where(F.col(key) % n == i).coalesce(1).write.parquet(out)
        f = [x for x in os.listdir(local_fs_path(out)) if x.endswith(".parquet")][0]
        shutil.copyfile(os.path.join(local_fs_path(out), f), os.path.join(local_fs_path(src), f"{table}{i:03d}.parquet"))
        if repeat == i:
            shutil.copyfile(os.path.join(local_fs_path(out), f),
                            os.path.join(local_fs_path(src), f"{table}{i:03d}_again.parquet"))
    return src


def test_status_stream_any_order_equals_batch(spark):
    src = _split(spark, "events", 5, [3, 0, 4, 1, 2], repeat=1)
    path = run_status_stream(spark, src, max_files_per_trigger=1)
    assert len([d for d in os.listdir(local_fs_path(path)) if d.startswith("batch_id=")]) == 6
    got = {tuple(r) for r in read_status_table(spark, path).collect()}
    shop = Shop.from_raw(spark, SF_MID)
    want = {tuple(r) for r in O.latest_status_effects(shop.status_events)
            .select("order_id", "new_status", "status_event_id", "new_approval").collect()}
    assert got == want
    assert {tuple(r) for r in read_status_table(spark, compact_status_log(spark, path)).collect()} == want
    again = run_status_stream(spark, src, os.path.dirname(path), max_files_per_trigger=1)
    assert {tuple(r) for r in read_status_table(spark, again).collect()} == want      # a restart with nothing new


def test_payment_stream_deduplicates_redelivered_orders(spark):
    src = _split(spark, "orders", 4, [2, 0, 3, 1], repeat=0)
    work = scratch_path(spark, "test-payments")
    n = spark.read.parquet(f"{SF_MID}/orders.parquet").count()

    def check():
        got = read_payments(spark, run_payment_stream(spark, src, work, first_id=101, max_files_per_trigger=1))
        assert got.where(F.col("payment_status") != "Pending").count() == 0
        assert got.select("order_id").distinct().count() == got.count() == n
        ids = got.agg(F.min("payment_id"), F.max("payment_id"), F.countDistinct("payment_id")).first()
        assert tuple(ids) == (101, 100 + n, n)
        return sorted(map(tuple, got.collect()))

    first = check()
    assert check() == first                                   # a restart with nothing new
    for k in range(3):                                        # delivered again, any time later
        one = [f for f in os.listdir(local_fs_path(src)) if f.startswith("orders00")][k]
        shutil.copyfile(os.path.join(local_fs_path(src), one), os.path.join(local_fs_path(src), f"orders9{k}.parquet"))
        assert check() == first


def test_payment_ids_of_a_batch_of_several_ranges(spark):
    src, n = scratch_path(spark, "test-many-orders"), 200_000
    rows = spark.range(n).select((F.col("id") * 3).alias("o_orderkey"), (F.col("id") % 999).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
                                 F.lit(1.5).alias("o_totalprice"), F.lit("1996-01-02").cast("timestamp_ntz").alias("o_orderdate"),
                                 F.lit("5-LOW").alias("o_orderpriority"))
    rows.repartition(2).write.parquet(f"{src}/tmp")
    for k, name in enumerate(f for f in sorted(os.listdir(local_fs_path(f"{src}/tmp"))) if f.endswith(".parquet")):
        shutil.copyfile(os.path.join(local_fs_path(f"{src}/tmp"), name), os.path.join(local_fs_path(src), f"orders{k}.parquet"))
    paid = read_payments(spark, run_payment_stream(spark, src))
    assert paid.count() == n and paid.where("payment_id <> order_id / 3 + 1").count() == 0


def test_streams_without_input_return_empty_tables(spark):
    src = scratch_path(spark, "test-nothing")
    spark.read.parquet(f"{SF_MID}/orders.parquet").limit(0).write.parquet(f"{src}/x")
    assert read_payments(spark, run_payment_stream(spark, src)).count() == 0
    assert read_status_table(spark, run_status_stream(spark, src)).count() == 0
    assert read_cart(spark, run_cart_stream(spark, src)).count() == 0


def test_cart_stream_any_order_and_redelivery_equals_batch(spark):
    src = _split(spark, "events", 5, [4, 1, 3, 0, 2], repeat=3)
    work = scratch_path(spark, "test-cart")
    want = {(r.user_id, r.product_id): r.quantity for r in Shop.from_raw(spark, SF_MID).cart.collect()}
    for _ in range(2):                                        # the second run finds nothing new
        rows = read_cart(spark, run_cart_stream(spark, src, work, max_files_per_trigger=1)).collect()
        assert {(r.user_id, r.product_id): r.quantity for r in rows} == want
        assert len({r.cart_id for r in rows}) == len(rows) and all(r.cart_id for r in rows)
