"""Session construction and the shared scratch location.

Jobs never invent a machine-local temp folder: scratch output (stream
checkpoints, materialised tables, lineage cuts) goes below the folder the
cluster names in ``spark.checkpoint.dir``. Only when that is unset (tests,
a laptop) do we pick one ourselves.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; sizes are for local tests and are meant to be
# overridden by the cluster's own defaults.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when the split needs one more
    # shuffle: the cart fold aggregates right after its join on the same key,
    # so without this a hot (user, product) stays in one task; with it the
    # split tasks pre-aggregate and the extra shuffle carries partial rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "cartwheel", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def recommended_conf(input_bytes: int, total_cores: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Cluster sizing for a given input size: shuffle partitions so each
    post-shuffle partition is near ``target_partition_bytes`` (at least two
    waves of tasks), the same advisory size for AQE coalescing and skew
    splitting, and scan splits of the same size. E.g. 100 TB on 1000 x 8
    cores -> ~400k shuffle partitions before AQE coalescing."""
    partitions = max(2 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            # executors could not see a folder of the driver's own disk
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="cartwheel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/cartwheel/{purpose}-{uuid.uuid4().hex[:12]}"


_COLLECTED: ContextVar[list[str] | None] = ContextVar("scratch folders", default=None)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: what
    is read several times is worked out once, the lineage is cut, and a lost
    executor costs a re-read, not a re-run."""
    path = scratch_path(df.sparkSession, purpose)
    if (collected := _COLLECTED.get()) is not None:
        collected.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_noted(paths: list[str]) -> Iterator[None]:
    """The folders that ``written`` makes meanwhile are added to ``paths``."""
    token = _COLLECTED.set(paths)
    try:
        yield
    finally:
        _COLLECTED.reset(token)


def delete_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove folders that ``written`` has made."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme (used only by tests that inspect files)."""
    return path[len("file:"):] if path.startswith("file:") else path
