"""Mixing sources to target weights with a time-varying curriculum, DataFrame
functions only.

A run lasts from time 0 to 1. Source s has a piecewise linear schedule of rates,
scaled so that its integral, the source's cumulative demand D_s(t), ends at its
target: D_s(1) = target. A document lies at a place c in its source (order: hash of
the id); the mix takes it in pass p at demand p * S + c as long as that is
below the target, and the training position is the time t with
D_s(t) = p * S + c (linear inversion inside a schedule step). Sorting all
passes by position gives the training order.

Targets: ``budget`` words are shared by weight; a source's target stops at
``max_epochs`` times its size and what it cannot use goes to the others by
weight, until none is above. In order of size by weight the sources that stop are
the first ones, so running sums over the sources tell which they are.

Scale: places are running sums in ``ranked`` order (range partitions, written
once), so neither a source with a third of all rows nor a third of all rows without
an id meets in one window. A source's target reaches its rows through one row per
(source, partition). Sources are rows throughout; only sums over them come to the
driver. Texts are read where they lie for ``mix`` and travel for
``mixed_documents`` alone, once to their row's positions and once to their range.

Defined cases: a null text has 0 words and takes none; a null source is a
source of its own, last in order; an empty table gives an empty result;
repeated rows count as separate documents (ties are broken by size; equal rows
are interchangeable); other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.keys import ranked
from cartwheel.llm.common import WORD, persisted, row_keyed

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
STEPS = 64                   # schedule steps over the run


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          row_col: str | None = None) -> DataFrame:
    """doc_id, source, size (words of the whole text) and the order key; the row
    key first, if there is one."""
    return docs.select(
        *([F.col(row_col).alias("row")] if row_col else []),
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("order_key"))


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, cap: float) -> list[float]:
    """Share ``budget`` by weight; none above ``cap`` times its size."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ -= full
    return target


def linear_schedule(n: int, steps: int = STEPS) -> list[list[float]]:
    """The default curriculum: even-numbered sources start at 1.5 times their
    mean rate and end at 0.5 times, odd-numbered ones the other way round. Each
    row: the source's rate in every step, of mean 1."""
    fall = [1.5 - (i + 0.5) / steps for i in range(steps)]
    return [fall if s % 2 == 0 else fall[::-1] for s in range(n)]


def demand_curve(target: float, rates: Sequence[float]) -> list[float]:
    """Cumulative demand at the end of each step, ``target`` at the last."""
    total, sums = sum(rates), [0.0]
    for r in rates:
        sums.append(sums[-1] + r)
    return [target * x / total for x in sums]


def position(demand: Column, curve: Column, steps: int) -> Column:
    """The time in 0..1 at which the ``curve`` (steps + 1 ascending values)
    reaches ``demand``: bisection for the step, linear inside it."""
    powers, step = [], 1 << (steps.bit_length() - 1)
    while step:
        powers.append(step)
        step >>= 1
    at = F.aggregate(F.array(*[F.lit(p) for p in powers]), F.lit(0), lambda low, p: F.when(
        (low + p < steps) & (F.try_element_at(curve, low + p + 1) <= demand), low + p).otherwise(low))
    low, high = F.element_at(curve, at + 1), F.element_at(curve, at + 2)
    return (at + F.when(high > low, F.least(F.lit(1.0), (demand - low) / (high - low))).otherwise(F.lit(0.0))) / float(steps)


def source_targets(records: DataFrame, weights: Sequence[float], budget_share: float, max_epochs: int) -> DataFrame:
    """One row per source: source, source_size, number (by code point, null last),
    target. The same shares as ``water_fill``."""
    totals = persisted(records.groupBy("source").agg(F.sum("size").alias("source_size"))
                       .withColumn("nameless", F.col("source").isNull()), "mixing-sources")
    named = ranked(totals, [], ["nameless", "source"], "mixing-names", rank="number", total="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    named = persisted(named.withColumn("ratio", F.col("cap") / F.col("weight")), "mixing-weights")
    whole = named.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget, all_weight = budget_share * (whole["words"] or 0), whole["weight"] or 0.0
    filled = ranked(named, [], ["ratio", "number"], "mixing-fill", rank="place", total="all", sums={"caps": "cap", "weights": "weight"})
    # all sources before this one stop at their caps: does it stop as well?
    unit = (F.lit(budget) - F.col("caps")) / (F.lit(all_weight) - F.col("weights"))
    filled = persisted(filled.withColumn("stops", F.col("weight") * unit > F.col("cap")), "mixing-stops")
    done = filled.where("stops").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    left, open_weight = budget - (done["cap"] or 0.0), all_weight - (done["weight"] or 0.0)
    rest = F.col("weight") * F.lit(left / open_weight if open_weight else 0.0)
    return filled.select("source", "source_size", "number", F.when(F.col("stops"), F.col("cap")).otherwise(rest).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE,
        max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Every document with source_size, target, taken (words over all passes),
    passes (array of words taken in each pass) and positions (array, the time
    of each pass that takes any). With ``row_col``, a column with a value of its
    own for every row, that value comes first, as ``row``."""
    own = ["row"] if row_col else []
    records = persisted(sized(docs, id_col, text_col, source_col, row_col), "mixing-sizes")
    targets = source_targets(records, weights, budget_share, max_epochs)
    placed = ranked(records, ["source"], ["order_key", "doc_id", "size", *own], "mixing-order", total="docs",
                    attach=targets, sums={"place": "size"})
    shapes = [F.array(*[F.lit(x) for x in demand_curve(1.0, rates)]) for rates in linear_schedule(2)]
    shape = F.when(F.col("number") % 2 == 0, shapes[0]).otherwise(shapes[1])
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda p: F.greatest(F.lit(0), F.least(
        F.col("size"), F.round("target").cast("long") - p * F.col("source_size") - F.col("place"))).cast("long"))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)
    times = F.filter(F.transform(F.col("passes"), lambda words, p: F.when(words > 0, position(
        (p * F.col("source_size") + F.col("place")) / F.nullif("target", F.lit(0.0)), F.col("shape"), STEPS))), lambda t: t.isNotNull())
    return placed.withColumn("shape", shape).withColumn("passes", passes).withColumn("taken", taken).withColumn("positions", times).select(
        *own, "doc_id", "source", "size", "source_size", "target", "taken", "passes", "positions")


def range_sorted(rows: DataFrame, position_col: str) -> DataFrame:
    """``rows`` range-sorted by training position. Rows the mix takes nothing of
    have none; they follow after time 1, spread by a hash of the id, so they
    don't meet in one range."""
    spread = 1.0 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return rows.withColumn("_order", F.coalesce(position_col, spread)) \
        .repartitionByRange("_order", "doc_id").sortWithinPartitions("_order", "doc_id").drop("_order")


def training_order_ids(mixed: DataFrame) -> DataFrame:
    """One row per document and pass that takes any of it: doc_id, pass,
    position, words."""
    one = mixed.select("doc_id", F.posexplode(F.filter("passes", lambda n: n > 0)).alias("pass", "words"), "positions")
    return one.select("doc_id", "pass", F.element_at("positions", F.col("pass") + 1).alias("position"), "words")


def training_order(mixed: DataFrame) -> DataFrame:
    """``training_order_ids`` range-sorted by training position."""
    return range_sorted(training_order_ids(mixed), "position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in training order, one per pass that takes any of the
    document, whole (a source's last document isn't cut). Every row gets its own
    passes, rows of one id or of none too."""
    rows = row_keyed(docs, "_row_key", "mixing-rows")
    mixed = mix(rows, id_col=id_col, row_col="_row_key", **options)
    positions = mixed.where("taken > 0").select(F.col("row").alias("_row_key"), F.col("positions").alias("_positions"))
    taken = rows.join(positions, "_row_key").drop("_row_key") \
        .withColumn("_position", F.explode("_positions")).drop("_positions")      # max_epochs at most
    return taken.repartitionByRange("_position", id_col).sortWithinPartitions("_position", id_col).drop("_position")
