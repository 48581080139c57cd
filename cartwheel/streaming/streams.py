"""Streaming jobs.

* ``run_cart_stream`` (ST-1): cart events -> cart lines. Each micro-batch
  re-folds only the users it touches, from their compacted event log plus the
  new events (``foreachBatch``), and appends only their rows; readers take a
  user's newest batch. Exact under any arrival order and re-delivery, and
  idempotent per batch id.
* ``run_payment_stream`` (ST-2): new orders -> one Pending payment each, by
  Spark's stateful de-duplication on a RocksDB state store: exact however late an
  order is delivered again, without reading earlier payments.
* ``run_status_stream`` (ST-3/ST-4): status events -> latest status per order.
  ``max_by`` over (ts, event_id) is order-insensitive, so each batch is
  aggregated without state and appended to an update log; late events need no
  watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel import schemas as S
from cartwheel.functions.keys import dense_ids
from cartwheel.operators.cart import compact_cart_log, fold_cart_events, with_cart_ids
from cartwheel.operators.orders import _status_effects
from cartwheel.session import scratch_path
from cartwheel.sources import feeds
from cartwheel.sources.raw import RAW_SCHEMAS


CART_BUCKETS = 64
# Keyed state on disk; a checkpoint uploads the batch's changes, not the state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` hold while a stream is started (it keeps a copy)."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_raw_stream(spark: SparkSession, source_dir: str, table: str,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of one raw table. ``source_dir`` is either a
    folder of ``<table>*.parquet`` files or the folder holding ``<table>.parquet``."""
    r = spark.readStream.schema(RAW_SCHEMAS[table]).option("pathGlobFilter", f"{table}*.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(source_dir)


def run_cart_stream(spark: SparkSession, source_dir: str, work_dir: str | None = None,
                    max_files_per_trigger: int | None = 1, prepare=None) -> str:
    """Run the cart stream over everything available; return its work folder
    (read the cart with ``read_cart``), also when nothing new has arrived.

    Per micro-batch (``foreachBatch``) the compacted event logs of the batch's
    users plus the new events (de-duplicated on event_id) are folded again with the
    batch fold. Written are the touched users' rows only, below ``batch_id=<k>`` and
    the users' buckets: their cart lines (``state``), their compacted log (``log``)
    and the users themselves (``touched``); a user's rows are those of the newest
    batch that touched them. Exact under any arrival order. A line keeps its
    cart_id while it is the same line (not deleted and added again); new ones
    continue the ids given so far. Batch k only looks at batches before k and
    overwrites its own folders, so it can run again; ``touched`` is written last.

    A batch reads the logs of its users' buckets; ``compact_cart_stream`` merges
    the batches' folders once there are many. ``prepare``: applied to the raw
    events first (an adapter of the shop's own).
    """
    work = work_dir or scratch_path(spark, "cart-stream")

    def apply(batch: DataFrame, batch_id: int) -> None:
        events = batch.select(*S.CART_EVENTS.names)
        users = events.select("user_id").distinct().withColumn("bucket", _bucket())
        users.persist(StorageLevel.MEMORY_AND_DISK)
        buckets = [r["bucket"] for r in users.select("bucket").distinct().collect()]           # at most CART_BUCKETS
        seen = users.join(_newest(spark, work, batch_id, buckets), ["user_id", "bucket"])
        log = _rows_of(spark, work, "log", S.CART_EVENTS, seen, batch_id, buckets)
        history = log.unionByName(events).dropDuplicates(["event_id"])
        history.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            before = _rows_of(spark, work, "state", S.CART, seen, batch_id, buckets).select(
                "user_id", "product_id", F.col("cart_id").alias("_id"), F.col("added_at").alias("_added"))
            same = F.col("_id").isNotNull() & (F.col("added_at") <= F.col("_added"))
            folded = fold_cart_events(history).drop("cart_id").join(before, ["user_id", "product_id"], "left") \
                .withColumn("cart_id", F.when(same, F.col("_id"))).select(*S.CART.names)
            last_id = _last_id(spark, work, batch_id)
            _write_buckets(with_cart_ids(folded, F.lit(last_id)), f"{work}/state/batch_id={batch_id}")
            _write_buckets(compact_cart_log(history), f"{work}/log/batch_id={batch_id}")
        finally:
            history.unpersist()
        top = spark.read.schema(S.CART).parquet(f"{work}/state/batch_id={batch_id}").agg(F.max("cart_id").alias("m")).first()["m"]
        _write_last_id(spark, work, batch_id, max(top or 0, last_id))
        _write_buckets(users.select("user_id"), f"{work}/touched/batch_id={batch_id}")
        users.unpersist()

    raw = read_raw_stream(spark, source_dir, "events", max_files_per_trigger)
    stream = feeds.cart_events_from_raw(prepare(raw) if prepare else raw)
    q = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return work


def _bucket():
    return F.pmod(F.xxhash64("user_id"), F.lit(CART_BUCKETS)).cast("int")


def _table(spark: SparkSession, work: str, kind: str, schema: T.StructType, before: int | None, buckets: list[int] | None) -> DataFrame:
    """One of the stream's tables with ``batch_id`` and ``bucket``: batches that
    ended (and are before ``before``), only the folders of ``buckets``."""
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])
    done = [b for b in _batches(spark, f"{work}/touched") if before is None or b < before]
    if not done:
        return feeds.empty_frame(spark, full)
    rows = spark.read.schema(full).parquet(f"{work}/{kind}").where(F.col("batch_id").isin(done))
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


_TOUCHED = T.StructType([T.StructField("user_id", T.LongType())])


def _newest(spark: SparkSession, work: str, before: int | None, buckets: list[int] | None) -> DataFrame:
    """user_id, bucket, batch_id: the newest batch that touched each user."""
    return _table(spark, work, "touched", _TOUCHED, before, buckets).groupBy("user_id", "bucket").agg(F.max("batch_id").alias("batch_id"))


def _rows_of(spark: SparkSession, work: str, kind: str, schema: T.StructType, newest: DataFrame, before: int | None = None,
             buckets: list[int] | None = None) -> DataFrame:
    return _table(spark, work, kind, schema, before, buckets).join(
        newest.select("user_id", "bucket", "batch_id"), ["user_id", "bucket", "batch_id"], "left_semi").select(*schema.names)


def read_cart(spark: SparkSession, work: str) -> DataFrame:
    """The cart stream's current CART rows."""
    return _rows_of(spark, work, "state", S.CART, _newest(spark, work, None, None))


def compact_cart_stream(spark: SparkSession, work: str) -> str:
    """Every user's newest rows as one batch (the last one's number) in a folder
    of its own, with the stream's checkpoint; go on with that folder. For between
    runs of the stream."""
    batches = _batches(spark, f"{work}/touched")
    if not batches:
        return work
    last, newest = batches[-1], _newest(spark, work, None, None)
    compacted = f"{work}-{last}"
    for kind, schema in (("state", S.CART), ("log", S.CART_EVENTS)):
        _write_buckets(_rows_of(spark, work, kind, schema, newest), f"{compacted}/{kind}/batch_id={last}")
    _write_last_id(spark, compacted, last, _last_id(spark, work, last + 1))
    fs, checkpoint = _path(spark, f"{work}/checkpoint")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, checkpoint, fs, _path(spark, f"{compacted}/checkpoint")[1], False,
                                                  spark._jsc.hadoopConfiguration())
    _write_buckets(newest.select("user_id"), f"{compacted}/touched/batch_id={last}")
    return compacted


def _write_buckets(rows: DataFrame, path: str) -> None:
    rows.withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("bucket", "user_id") \
        .write.mode("overwrite").partitionBy("bucket").parquet(path)


def _last_id(spark: SparkSession, work: str, before: int) -> int:
    """The highest id given by the batches before ``before``; 0 without any."""
    batches = [b for b in _batches(spark, f"{work}/last_id") if b < before]
    return spark.read.schema("last_id long").parquet(f"{work}/last_id/batch_id={batches[-1]}").first()["last_id"] if batches else 0


def _write_last_id(spark: SparkSession, work: str, batch_id: int, last_id: int) -> None:
    """Kept for this batch and the one before it, which is what a batch that runs
    again needs."""
    spark.range(1).select(F.lit(last_id).cast("long").alias("last_id")).write.mode("overwrite").parquet(f"{work}/last_id/batch_id={batch_id}")
    for old in _batches(spark, f"{work}/last_id"):
        if old < batch_id - 1:
            _delete(spark, f"{work}/last_id/batch_id={old}")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, name: str) -> None:
    fs, path = _path(spark, name)
    fs.delete(path, True)


def run_payment_stream(spark: SparkSession, source_dir: str, work_dir: str | None = None,
                       first_id: int = 1, max_files_per_trigger: int | None = None) -> str:
    """AFTER INSERT ON orders, as a stream; returns the folder of the payments
    (read them with ``read_payments``), also when nothing new has arrived.

    An order id is let through once, whatever the time between deliveries, by
    ``dropDuplicates`` without a watermark: the ids are keyed state in RocksDB,
    spread over the shuffle partitions, and a checkpoint uploads a batch's changes.
    So a batch costs what it brings; no payment is read again. Each batch is
    written under ``batch_id=<k>`` (overwritten, with the same orders, if it runs
    again); ids continue the highest one given, which is kept per batch.
    """
    work = work_dir or scratch_path(spark, "payment-stream")
    out = f"{work}/payments"
    orders = read_raw_stream(spark, source_dir, "orders", max_files_per_trigger)
    new = orders.where(F.col("o_orderkey").isNotNull()).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(S.MONEY).alias("amount"),
        F.lit(S.DEFAULT_PAYMENT_STATUS).alias("payment_status"),
        F.lit(S.DEFAULT_PAYMENT_METHOD).alias("payment_method"),
        F.col("o_orderdate").alias("created_at")).dropDuplicates(["order_id"])

    def pay(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)            # the state is looked up once
        try:
            base = max(_last_id(spark, work, batch_id), first_id - 1)
            dense_ids(batch, "order_id", F.lit(base), "payment_id").select(*S.PAYMENTS.names) \
                .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            _write_last_id(spark, work, batch_id, base + batch.count())
        finally:
            batch.unpersist()

    with _settings(spark, STATE_STORE):
        q = (new.writeStream.foreachBatch(pay).option("checkpointLocation", f"{work}/checkpoint")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_payments(spark: SparkSession, out: str) -> DataFrame:
    """The stream's payments with ``batch_id``; none before its first batch."""
    schema = T.StructType([*S.PAYMENTS.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(out) if _batches(spark, out) else feeds.empty_frame(spark, schema)


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the ``batch_id=<k>`` folders below ``root``, on any file system."""
    fs, path = _path(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))


_STATUS_SCHEMA = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("new_status", T.StringType()),
                               T.StructField("status_event_id", T.LongType()),
                               T.StructField("new_approval", T.StringType())])


def run_status_stream(spark: SparkSession, source_dir: str, work_dir: str | None = None,
                      max_files_per_trigger: int | None = None) -> str:
    """Latest status effects per order; returns the folder of the update log
    (read it with ``read_status_table``), also when nothing new has arrived.

    ``max_by`` over (ts, event_id) doesn't depend on order, so a batch is
    aggregated on its own, without streaming state, and its orders' latest
    events are appended under ``batch_id=<k>`` (overwritten if the batch runs
    again); readers take the latest over all batches. ``compact_status_log``
    merges the folders when there are many.
    """
    work = work_dir or scratch_path(spark, "status-stream")
    log_root, ckpt = f"{work}/updates", f"{work}/checkpoint"
    events = feeds.status_events_from_raw(read_raw_stream(spark, source_dir, "events", max_files_per_trigger))

    def append(batch: DataFrame, batch_id: int) -> None:
        _latest_of(_status_effects(batch).select(
            "order_id", "new_status", F.struct("ts", "event_id").alias("status_at"), "new_approval",
            F.when(F.col("new_approval").isNotNull(), F.struct("ts", "event_id")).alias("approval_at"))) \
            .write.mode("overwrite").parquet(f"{log_root}/batch_id={batch_id}")

    q = (events.writeStream.foreachBatch(append).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log_root


_AT = T.StructType([T.StructField("ts", S.TS), T.StructField("event_id", T.LongType())])
_STATUS_LOG = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("new_status", T.StringType()),
                            T.StructField("status_at", _AT), T.StructField("new_approval", T.StringType()),
                            T.StructField("approval_at", _AT)])


def _latest_of(effects: DataFrame) -> DataFrame:
    """Status and approval of each order at their latest events (map-side combined)."""
    return effects.groupBy("order_id").agg(
        F.max_by("new_status", "status_at").alias("new_status"), F.max("status_at").alias("status_at"),
        F.max_by("new_approval", "approval_at").alias("new_approval"), F.max("approval_at").alias("approval_at"))


def compact_status_log(spark: SparkSession, log_root: str) -> str:
    """One folder with each order's latest row; use it as the log from then on
    (``<root>-<k>/batch_id=<k>``, k the last batch merged)."""
    last = _batches(spark, log_root)[-1]
    compacted = f"{log_root}-{last}"
    _latest_of(spark.read.schema(_STATUS_LOG).parquet(log_root)).write.mode("overwrite").parquet(f"{compacted}/batch_id={last}")
    return compacted


def read_status_table(spark: SparkSession, log_root: str) -> DataFrame:
    """Current status effects: order_id, new_status, status_event_id, new_approval."""
    if not _batches(spark, log_root):
        return feeds.empty_frame(spark, _STATUS_SCHEMA)
    return _latest_of(spark.read.schema(_STATUS_LOG).parquet(log_root)).select(
        "order_id", "new_status", F.col("status_at.event_id").alias("status_event_id"), "new_approval")
