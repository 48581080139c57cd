"""Sharding by sampled splitters, DataFrame functions only.

Law ``bytes``: the shards' sizes are near equal. A record's key is
``(crc32(text), hash(doc_id))`` packed into one long, so equal texts lie next to
each other and a large group of them can still be cut. Steps:

1. draw a sample of keys in which a row's chance is the mean of its share of all
   bytes and its share of all rows (by a hash of the row) and take its quantiles as
   range boundaries; a key that fills a range gets one of its own;
2. measure every range exactly; one of more than twice the mean size or the mean
   number of rows is subdivided at the quantiles of its own keys, and what is still
   overfull then, being one key, at equal steps of a hash of the row;
3. running sums over the ranges, then inside each range, give every record its
   place in the global order; the shard follows from the byte offset, the slot
   from the row offset. No window holds more than one subrange, and the only
   single-task window has one row per subrange.

The cuts between shards are moved to the nearer end of a group of equal texts
when that group is at most ``GROUP_SHARE`` of a shard; a larger group is cut
where the byte offset says, else sizes could not be near equal.

To the driver come only the boundaries and the cuts between shards (at most 2 x RANGES
values). The keyed records (id, size, crc, key: some 40 bytes a row, no text) are
written to the shared folder, not the texts.

Defined cases: null text has size 1 and the crc of the empty text; an empty
table gives an empty result; repeated rows are separate records (ties are
broken by every field the placement uses, then by the record's number; rows equal
in all fields are interchangeable); null ids hash like any value; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.llm.common import persisted, with_row_key

SHARDS = 16
RANGES = 1024                # key ranges, 1/64 of a shard each at 16 shards
SAMPLE_ROWS = 50_000         # expected number of keys drawn
SUBRANGES = 64               # an overfull range is cut in so many
GROUP_SHARE = 0.02


def records_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32 and key: crc32 of the text in the upper bits,
    31 hash bits of the id below."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    low = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 33)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.shiftleft(F.crc32(text), 31).bitwiseOR(low).alias("key"))


def own_range(quantiles: list[int]) -> list[int]:
    """Ascending boundaries; a value that comes up twice or more fills a range by
    itself, so the next value starts a new one."""
    repeated = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    return sorted(set(quantiles) | {v + 1 for v in repeated})


def sample_boundaries(records: DataFrame, total: int, rows: int, ranges: int, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """Range boundaries: quantiles of a sample of about ``sample_rows`` keys, drawn
    by bytes and by rows alike."""
    unit = F.shiftrightunsigned(F.xxhash64("key", "doc_id", "size", "number", F.lit(17)), 11).cast("double") / float(1 << 53)
    chance = (F.col("size") / F.lit(float(max(1, total))) + F.lit(1.0 / max(1, rows))) / 2 * float(sample_rows)
    steps = [i / ranges for i in range(1, ranges)]
    found = records.where(unit < chance).agg(F.percentile_approx("key", steps, 20_000).alias("q")).first()["q"] if steps else None
    return own_range(sorted(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below ``key``: bisection over a literal
    array, one comparison per bit of its length."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    at, step = F.lit(0), 1 << (len(bounds).bit_length() - 1)
    steps = []
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), at,
        lambda low, s: F.when((low + s <= len(bounds)) & (F.try_element_at(array, low + s) <= key), low + s).otherwise(low))


def subdivided(keyed: DataFrame, total: int, rows: int, ranges: int) -> DataFrame:
    """``keyed`` (with ``range``) with ``sub`` and ``step``: overfull ranges are cut
    at their own keys' quantiles, and pieces of one key still overfull by a hash of
    the row. The joined tables have a row per overfull piece, fewer than the ranges."""
    def full_pieces(df: DataFrame, by: list[str]) -> DataFrame:
        sizes = df.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), (F.min("key") == F.max("key")).alias("one_key"))
        return sizes.where((F.col("bytes") > 2.0 * total / ranges) | (F.col("rows") > 2.0 * rows / ranges)).select(*by, "one_key")

    steps = [i / SUBRANGES for i in range(1, SUBRANGES)]
    again = F.filter("q", lambda x, i: F.get("q", i - 1) == x)                 # a key that fills a piece by itself
    cuts = keyed.join(F.broadcast(full_pieces(keyed, ["range"]).drop("one_key")), "range").groupBy("range") \
        .agg(F.percentile_approx("key", steps, 10_000).alias("q")) \
        .select("range", F.array_distinct(F.concat("q", F.transform(again, lambda x: x + 1))).alias("cuts"))
    keyed = keyed.join(F.broadcast(cuts), "range", "left").withColumn("sub", F.when(F.col("cuts").isNull(), 0).otherwise(
        F.size(F.filter("cuts", lambda c: c <= F.col("key"))))).drop("cuts")
    full = full_pieces(keyed, ["range", "sub"]).where("one_key")
    hashed = F.pmod(F.xxhash64("number", F.lit(29)), F.lit(SUBRANGES)).cast("int")
    return keyed.join(F.broadcast(full), ["range", "sub"], "left") \
        .withColumn("step", F.when(F.col("one_key"), hashed).otherwise(F.lit(0))).drop("one_key")


def place(records: DataFrame, shards: int = SHARDS, ranges: int = RANGES, group_share: float = GROUP_SHARE) -> DataFrame:
    """``records`` with ``shard`` and ``slot`` (from 0, gapless in a shard)."""
    whole = records.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = whole["bytes"] or 0, whole["rows"]
    bounds = sample_boundaries(records, total, rows, ranges)
    keyed = persisted(subdivided(records.withColumn("range", range_of(F.col("key"), bounds)), total, rows, len(bounds) + 1), "sharding-pieces")

    piece = ["range", "sub", "step"]
    before = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = keyed.groupBy(*piece).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).select(
        *piece, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy(*piece).orderBy("key", "doc_id", "size", "text_crc32", "number")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    located = persisted(
        keyed.join(F.broadcast(pieces), piece).select(
            "doc_id", "size", "text_crc32",
            (F.col("bytes_before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("offset"),
            (F.col("rows_before") + F.row_number().over(inside) - 1).alias("rank")),
        "sharding-places")

    cuts = [total * i / shards for i in range(1, shards)]
    cuts = snapped_cuts(located, cuts, total / shards * group_share)
    middle = F.col("offset") + F.col("size") / 2
    shard = sum((F.when(middle >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    sharded = located.withColumn("shard", shard)
    starts = sharded.groupBy("shard").agg(F.min("rank").alias("first_rank"))     # one row a shard
    return sharded.join(F.broadcast(starts), "shard") \
        .withColumn("slot", (F.col("rank") - F.col("first_rank")).cast("long"))


def snapped_cuts(located: DataFrame, cuts: list[float], largest: float) -> list[float]:
    """Each byte offset in ``cuts`` moved to the nearer end of the group of
    equal texts it falls into, if the group has at most ``largest`` bytes."""
    if not cuts:
        return cuts
    at_cut = located.where(F.lit(False) if not cuts else _any(
        [(F.col("offset") <= c) & (F.col("offset") + F.col("size") > c) for c in cuts]))
    crcs = sorted({r["text_crc32"] for r in at_cut.select("text_crc32").collect()})   # one row a cut
    groups = located.where(F.col("text_crc32").isin(crcs)).groupBy("text_crc32").agg(
        F.min("offset").alias("start"), F.sum("size").alias("bytes")).collect() if crcs else []
    out = []
    for c in cuts:
        for g in groups:
            if g["bytes"] <= largest and g["start"] < c < g["start"] + g["bytes"]:
                c = g["start"] if c - g["start"] < g["bytes"] / 2 else g["start"] + g["bytes"]
                break
        out.append(float(c))
    return sorted(out)


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    records = with_row_key(records_of(docs, id_col, text_col), "number", "sharding-records")
    return place(records, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
