"""Key-level building blocks shared by the operators.

* ``latest_per_key``: newest row per key as an aggregate (``max_by`` over a
  struct), so a hot key is combined map-side instead of being sorted whole in
  one window task.
* ``dense_ids``: consecutive surrogate keys after a base value (AUTO_INCREMENT
  re-aimed at a whole batch), computed in ranges between sampled splitters.
* ``ranked``: places of rows in their groups without a window over a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.session import written

MAX_RANGES = 4096            # ranges of one numbering


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the row with the greatest ``order`` tuple.

    ``order`` must be a total order within a key (end it with a unique id).
    """
    others = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*[F.col(c) for c in others]),
                      F.struct(*[F.col(c) for c in order])).alias("_latest")
    return (df.groupBy(*keys).agg(picked)
              .select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in others]))


def newest(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """Each key's ``n`` rows with the greatest ``order`` (a total order within a
    key). The rank limit holds in every map task before the shuffle
    (``WindowGroupLimit``), so a hot key sends n rows a task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def splitters(keys_df: DataFrame, key: str, rows: int) -> list[int]:
    """Ascending boundaries that cut the values of ``key`` into ranges of about
    ``rows`` rows (MAX_RANGES ranges at most), taken from the keys' own quantiles,
    so neither gaps nor clusters in the key matter. A value that fills a range
    of its own comes up once. One aggregate over the key column; none when all
    rows fit one range."""
    steps = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    found = keys_df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, steps, 10 * MAX_RANGES).alias("q")).first()
    ranges = min(MAX_RANGES, -(-found["n"] // max(1, rows)))
    picked = [found["q"][i * MAX_RANGES // ranges - 1] for i in range(1, ranges)] if found["q"] and ranges > 1 else []
    return sorted(set(picked))


def range_number(key: Column, bounds: Sequence[int]) -> Column:
    """How many ``bounds`` are at or below ``key`` (null: 0): bisection over a
    literal array, one comparison per bit of its length."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(
        (low + s <= len(bounds)) & (F.try_element_at(array, low + s) <= key), low + s).otherwise(low))


def dense_ids(keys_df: DataFrame, key: str, base: Column, out: str,
              bucket_width: int = 1 << 16, order: Sequence[str] | None = None,
              sums: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Attach ``out = base + rank`` (1, 2, 3, ... in ``order``, default ``key``).

    ``sums`` adds running totals in the same pass: ``{name: (start, weight)}``
    gives ``name = start + sum(weight of all earlier rows)`` (e.g. the first
    line id of each new order, with the line count as weight).

    ``key`` is integral and leads ``order``; rows must be unique on ``order``.
    Rows fall into ranges between ``splitters`` of the key, about
    ``bucket_width`` rows each; ranks inside a range come from a window over that
    range, offsets from the ranges' exact counts (one row a range, MAX_RANGES at
    most, hence broadcast). The splitters are found when this is called, by one
    aggregate over the key; ranks are exact whatever they are. Deterministic, so a
    recomputed task yields the same ids.
    """
    order = list(order or [key])
    sums = dict(sums or {})
    weights = {"_n": F.lit(1)} | {f"_w_{n}": F.col(w) for n, (_, w) in sums.items()}
    earlier, bounds = Window.unboundedPreceding, splitters(keys_df, key, bucket_width)
    keyed = keys_df.withColumn("_range", range_number(F.col(key), bounds))
    # one range: bucket_width rows at most, nothing before them
    inside = (Window.partitionBy("_range") if bounds else Window).orderBy(*[F.col(c) for c in order])
    out_df = keyed.withColumn("_rank", F.row_number().over(inside))
    for n, (_, w) in sums.items():
        out_df = out_df.withColumn(f"_in_w_{n}", F.coalesce(F.sum(F.col(w)).over(inside.rowsBetween(earlier, -1)), F.lit(0)))
    if bounds:
        before = Window.orderBy("_range").rowsBetween(earlier, -1)
        offsets = keyed.groupBy("_range").agg(*[F.sum(w).alias(n) for n, w in weights.items()]).select(
            F.col("_range").alias("_of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off{n}") for n in weights])
        # joined on the range as the window gives it back: from a key computed out of ``key`` the optimizer
        # derives a filter for the other side, where, over a micro-batch of a stream, there is no ``key``
        out_df = out_df.withColumn("_in", F.first("_range").over(inside)).join(F.broadcast(offsets), F.col("_in") == F.col("_of"))
    else:
        out_df = out_df.withColumns({f"_off{n}": F.lit(0) for n in weights})
    out_df = out_df.withColumn(out, (base + F.col("_off_n") + F.col("_rank")).cast("long"))
    for n, (start, _) in sums.items():
        out_df = out_df.withColumn(n, (start + F.col(f"_off_w_{n}") + F.col(f"_in_w_{n}")).cast("long"))
    drop = ["_range", "_rank", "_in", "_of"] + [f"_off{n}" for n in weights] + [f"_in_w_{n}" for n in sums]
    return out_df.drop(*drop)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], purpose: str,
           rank: str = "rank", total: str = "total", attach: DataFrame | None = None,
           sums: dict[str, str] | None = None, files: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 0 in its group, by ``order``, nulls first) and
    ``total`` (rows of its group). A null group is a group. ``sums`` adds running
    totals: ``{name: column}`` gives the column's sum over all earlier rows of the
    group. ``attach``: one row per group whose further columns go to all of its
    rows; it is joined to the (group, partition) rows, so a hot group is never one
    join key.

    Rows are range-partitioned by (group, order, a tie key of their own), sorted
    and written once; a row's rank is its place in its written partition plus the
    rows of its group in earlier partitions. A group with a third of all rows, or a
    third of all rows equal, is spread over as many range partitions as its share;
    the only windows are over the rows of one written partition (for ``sums``) and
    over one row per (group, partition).

    ``files``: the written partitions are put into so many files at most (tasks), for a
    table smaller than the session's shuffle partitions are meant for.

    ``df`` must give the same rows whenever it is read (a written table). Rows
    equal in ``order`` are numbered as they come; ``_tie``, ``_part`` and
    ``_row`` are used inside."""
    keys, sums = [*group, *order, "_tie"], dict(sums or {})
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys) \
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).drop("_tie")
    placed = written(placed if files is None else placed.coalesce(files), purpose)
    pieces = placed.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"),
                                                 *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"), "_first",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(total),
                           *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    more = []
    if attach is not None:
        more = [c for c in attach.columns if c not in group]
        named = attach.select(*[F.col(c).alias(f"_a_{c}") for c in group], *more)
        starts = starts.join(named, reduce(and_, [F.col(f"_g_{c}").eqNullSafe(F.col(f"_a_{c}")) for c in group]))
    if sums:
        inside = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col("_part") == F.col("_g_part"))
    return placed.join(starts, same).select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(rank), total,
        *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums], *more)


def max_key(df: DataFrame, key: str) -> Column:
    """max(key) of ``df`` as a scalar-subquery column (0 for an empty table)."""
    return df.select(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
