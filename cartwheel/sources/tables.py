"""Stored tables that change in place, at the cost of the buckets a change touches.

A table is Parquet below one folder per ``bucket`` (a hash of its key). A change
names the keys it may touch and how their rows become the next ones; it reads the
buckets of those keys (partition pruning), works out their next rows and writes them
back by dynamic partition overwrite. Files of other buckets are neither read nor
written. Any of the shop's table changes can be the step: ``orders``, ``sellers``,
``cart`` functions that map a table to the next one work on some of its buckets as
they do on all.

A bucket is replaced as a whole when the job commits; a change that fails before has
no effect, and one that sets rows (rather than adding to them) can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.session import delete_scratch, written


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


def save_table(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` as a table of ``buckets`` by ``key``."""
    _write(df.withColumn("bucket", bucket_of(key, buckets)), path, key)


def _write(rows: DataFrame, path: str, key: str) -> None:
    rows.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).drop("bucket")


def change_table(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, keys: DataFrame,
                 step: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets of ``keys`` (a column ``key``) by what ``step`` makes of
    their rows; returns the buckets' numbers. ``step`` may change, drop and add rows
    of these keys; rows of other keys in the buckets must come out as they went in."""
    touched = sorted(r["bucket"] for r in keys.where(F.col(key).isNotNull()).select(bucket_of(key, buckets).alias("bucket")).distinct().collect())
    if not touched:
        return []
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    before = spark.read.schema(full).parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    after = written(step(before).select(*schema.names).withColumn("bucket", bucket_of(key, buckets)), "table-change")
    left = {r["bucket"] for r in after.select("bucket").distinct().collect()}         # one row a bucket
    if not left <= set(touched):
        raise ValueError("the change has rows outside the buckets of its keys")
    _write(after, path, key)
    delete_scratch(spark, [f"{path}/bucket={b}" for b in touched if b not in left])    # an overwrite leaves buckets without rows alone
    spark.catalog.refreshByPath(path)
    return touched
