"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside
the cells, one representative kept per group.

1. Equal vectors become one class (an aggregate), so copies are never compared.
2. Spherical k-means on a bounded sample, in Spark, gives the centres (only they
   come to the driver); every class goes to its nearest centre's cell (its home) and, as a visitor, to each cell whose
   border is within ``MARGIN`` of it.
3. In a cell, home vectors are compared with all vectors of the cell, in blocks
   of a bounded number of rows: a task holds one block of each side, whatever
   the cell's size, and returns link counts and a spanning forest of its links,
   never the pairs.
4. Components of the forests; the smallest id of each is kept.

Every link (u, v) is found, for any data. |u - v| is at most
sqrt(2 - 2 * 0.95) = 0.316, and the border between two home cells lies between u
and v, so their distances from it add up to 0.316 at most: with MARGIN_SHARE =
0.5 at least one of the two visits the other's home cell. If only v visits, u's
home cell counts the link for both: a home row has the list of the cells it is
in, a visitor its home, so the task sees that u is not in v's home. A larger
share costs more visitors and finds the same; below 0.5 links are lost.

Defined cases: null, empty, zero vectors and those with null or non-finite
components link with nothing (component: themselves; kept); vectors of
different length never link; rows of a null id never link to anything; repeated
rows are vectors of their own; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import hot_join, persisted, with_row_key
from cartwheel.llm.components import components
from cartwheel.llm.vectors import matrix, numbered, usable

THRESHOLD = 0.95
CELL_ROWS = 1024             # wanted vectors per cell
MAX_CELLS = 4096
SAMPLE_PER_CELL = 64         # k-means sees so many vectors per cell
ITERATIONS = 10
MARGIN_SHARE = 0.5
ROUNDING = 1e-7              # centres that are almost equal have an apart of rounding errors
BLOCK = 4096                 # rows of one side in a task


def _unit_blocks(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, unit vectors) of a batch's ``v``, by length, in blocks of ``rows``."""
    lengths = np.array([len(x) for x in batch.column("v")])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        for a in range(0, len(at), rows):
            x = matrix(batch.column("v").take(pa.array(at[a:a + rows])))
            yield int(d), at[a:a + rows], x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(table: pa.Table) -> dict[int, np.ndarray]:
    """Rows (d, c, centre) as a matrix by length, in the order of c."""
    table = table.sort_by([("d", "ascending"), ("c", "ascending")])
    d, rows = table.column("d").to_numpy(), table.column("centre").to_pylist()
    return {int(k): np.stack([np.frombuffer(rows[i], "<f8") for i in np.flatnonzero(d == k)]) for k in np.unique(d)}


_CENTRES = pa.schema([("d", pa.int32()), ("c", pa.int64()), ("centre", pa.binary())])


def first_centres(sample: DataFrame, highest: dict[int, int]) -> dict[int, np.ndarray]:
    """The unit vectors of the sample's rows whose draw is at most their length's ``highest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = batch.column("draw").to_numpy()
            batch = batch.filter(pa.array([draw[i] <= highest[len(x)] for i, x in enumerate(batch.column("v"))], pa.bool_()))
            for d, at, x in _unit_blocks(batch):
                draws = batch.column("draw").take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), draws, pa.array([r.tobytes() for r in x], pa.binary())],
                                                 schema=_CENTRES)

    return _by_length(sample.select("draw", "v").mapInArrow(run, "d int, c long, centre binary").toArrow())


def lloyd_step(sample: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Centres moved to the mean direction of the sample's vectors nearest to
    them. A task adds up its own vectors, then a centre's sums meet."""
    shared = sample.sparkSession.sparkContext.broadcast(centres)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = {}, {}
        for batch in batches:
            for d, _, x in _unit_blocks(batch):
                nearest = (x @ shared.value[d].T).argmax(axis=1)
                order = np.argsort(nearest, kind="stable")
                some, start = np.unique(nearest[order], return_index=True)
                sums.setdefault(d, np.zeros_like(shared.value[d]))[some] += np.add.reduceat(x[order], start)
                seen.setdefault(d, np.zeros(len(shared.value[d]), dtype=bool))[some] = True
        for d in sums:
            c = np.flatnonzero(seen[d])
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(c), pa.int32()), pa.array(c, pa.int64()),
                                              pa.array([sums[d][k].tobytes() for k in c], pa.binary())], schema=_CENTRES)

    def meet(group: pa.Table) -> pa.Table:
        total = np.zeros(group.column("d")[0].as_py())
        for part in group.column("centre").to_pylist():
            total += np.frombuffer(part, "<f8")
        norm = np.linalg.norm(total)
        return group.slice(0, 1).set_column(2, "centre", pa.array([(total / norm).tobytes()], pa.binary())) if norm > 0 else group.slice(0, 0)

    moved = sample.select("v").mapInArrow(add_up, "d int, c long, centre binary").groupBy("d", "c") \
        .applyInArrow(meet, "d int, c long, centre binary").toArrow()
    out = {d: x.copy() for d, x in centres.items()}          # one without vectors stays
    for d, c, x in zip(*(moved.column(i).to_pylist() for i in range(3))):
        out[d][c] = np.frombuffer(x, "<f8")
    return out


def fit_centres(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres by vector length, for lengths that get more than one; spherical
    k-means on at most about MAX_CELLS * SAMPLE_PER_CELL vectors. The sample
    stays in Spark: the driver sees two numbers of each sampled row, and the centres."""
    k_all = min(MAX_CELLS, max(1, -(-n // CELL_ROWS)))
    if k_all == 1:
        return {}
    share = min(1.0, k_all * SAMPLE_PER_CELL / max(1, n))
    unit = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = persisted(classes.where(unit <= share).select(F.size("v").alias("d"), F.xxhash64("v", F.lit(7)).alias("draw"), "v"),
                       "dedup-sample")
    drawn = sample.select("d", "draw").toArrow()
    d, draw = drawn.column("d").to_numpy(), drawn.column("draw").to_numpy()
    highest = {}
    for length, count in zip(*(x.tolist() for x in np.unique(d, return_counts=True))):
        if (k := min(count, round(k_all * count / len(d)))) > 1:
            highest[length] = int(np.partition(draw[d == length], k - 1)[k - 1])
    if not highest:
        return {}
    sample = sample.where(F.col("d").isin(list(highest)))
    centres = first_centres(sample, highest)
    for _ in range(ITERATIONS):
        centres = lloyd_step(sample, centres)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of unit vectors, visitors included."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))
    gap = near[np.arange(len(x)), home][:, None] - near
    inside = gap <= margin * apart[home] + ROUNDING
    inside[np.arange(len(x)), home] = True
    row, cell = np.nonzero(inside)
    return row, cell, cell == home[row]


def assign(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float, margin_share: float) -> DataFrame:
    """One row per class and cell it is in: cell, home, at (its home's number),
    cells (home rows: the numbers of all cells the class is in), rep, copies, v."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)      # at most MAX_CELLS centres
    margin = margin_share * float(np.sqrt(2 - 2 * threshold)) + 1e-9
    schema = pa.schema([("cell", pa.string()), ("home", pa.bool_()), ("at", pa.int32()), ("cells", pa.list_(pa.int32())),
                        ("rep", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("v")])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                part = batch.take(pa.array(at))
                x = matrix(part.column("v"))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                centre = shared.value.get(int(d))
                for a in range(0, len(x), 2048):
                    if centre is None:       # a length of few vectors: one cell
                        row = np.arange(len(x[a:a + 2048]))
                        cell, home = np.zeros(len(row), dtype=int), np.ones(len(row), dtype=bool)
                    else:
                        row, cell, home = cells_of(x[a:a + 2048], centre, margin)
                    took = part.take(pa.array(row + a))
                    # A row's cells stand together and one of them is its home, so the lists are cuts of ``cell``.
                    cuts = np.concatenate(([0], np.cumsum(np.where(home, np.bincount(row)[row], 0))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{d}:{c}" for c in cell]), pa.array(home), pa.array(cell[home][row], pa.int32()),
                         pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cell, pa.int32())),
                         took.column("rep"), took.column("copies"), took.column("v")], schema=schema)

    return classes.mapInArrow(run, "cell string, home boolean, at int, cells array<int>, rep long, copies long, v array<double>")


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Root of each of n nodes under the links ``pairs`` (smallest node wins)."""
    root = np.arange(n)
    a, b = pairs
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def compare_blocks(assigned: DataFrame, threshold: float) -> DataFrame:
    """Links of every home class within its cell: kind 'n' rows (rep, count of
    linked vectors) and kind 'e' rows (rep, rep): a spanning forest. A link with
    a visitor whose own home cell doesn't have the class counts for the visitor too."""
    sizes = assigned.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("members")) \
        .select("cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("ni"), F.ceil(F.col("members") / BLOCK).cast("int").alias("nj"))
    sized = assigned.join(F.broadcast(sizes), "cell")      # at most MAX_CELLS rows
    spread = F.xxhash64("rep", F.lit(11))
    homes = sized.where("home and ni > 0").select(
        "cell", F.pmod(spread, "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"),
        F.lit(0).alias("side"), "home", "at", "cells", "rep", "copies", "v")
    members = sized.where("ni > 0").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(spread, "nj").cast("int").alias("j"),
        F.lit(1).alias("side"), "home", "at", F.lit(None).cast("array<int>").alias("cells"), "rep", "copies", "v")
    schema = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        left, right = (group.take(pa.array(np.flatnonzero(side == s))) for s in (0, 1))
        if not len(left) or not len(right):
            return schema.empty_table()
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        xr, yr = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        copies = right.column("copies").to_numpy()
        nodes, place = np.unique(np.concatenate((xr, yr)), return_inverse=True)
        xp, yp = place[:len(xr)], place[len(xr):]
        links, back, root = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64), np.arange(len(nodes))
        mine, visitor = left.column("copies").to_numpy(), ~right.column("home").to_numpy()
        homes_of, home = np.unique(right.column("at").to_numpy(), return_inverse=True)
        lists = left.column("cells").combine_chunks()
        owner, cell = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        known = np.isin(cell, homes_of)
        there = np.zeros((len(x), len(homes_of)), dtype=bool)      # left row is in the cell that is the right row's home
        there[owner[known], np.searchsorted(homes_of, cell[known])] = True
        for a in range(0, len(x), 512):
            found = (x[a:a + 512] @ y.T >= threshold) & (xr[a:a + 512, None] != yr[None, :])
            links[a:a + 512] = found @ copies
            i, j = np.nonzero(found)
            unseen = np.flatnonzero(visitor[j] & ~there[a + i, home[j]])
            np.add.at(back, j[unseen], mine[a + i[unseen]])
            root = _forest((np.concatenate((xp[a + i], np.arange(len(nodes)))), np.concatenate((yp[j], root))), len(nodes))
        some, more, joined = np.flatnonzero(links), np.flatnonzero(back), np.flatnonzero(root != np.arange(len(nodes)))
        return pa.Table.from_arrays(
            [pa.array(["n"] * (len(some) + len(more)) + ["e"] * len(joined)),
             pa.array(np.concatenate((xr[some], yr[more], nodes[joined]))),
             pa.array(np.concatenate((links[some], back[more], nodes[root[joined]])))], schema=schema)

    return homes.unionByName(members).groupBy("cell", "i", "j").applyInArrow(run, "kind string, a long, b long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, margin_share: float = MARGIN_SHARE,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = numbered(embeddings, id_col, vector_col)
    takes_part = usable(F.col("v")) & F.col("vec_id").isNotNull()
    good = rows.where(takes_part)
    # ids may repeat, so a class goes by a key of its own
    classes = with_row_key(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "rep", "dedup-classes")
    n = classes.agg(F.count(F.lit(1)).alias("classes"), F.sum("copies").alias("rows")).first()
    assigned = assign(classes, fit_centres(classes, n["classes"]), threshold, margin_share)
    found = persisted(compare_blocks(persisted(assigned, "dedup-cells"), threshold), "dedup-links")
    counts = found.where("kind = 'n'").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    groups = components(found.where("kind = 'e'").select("a", "b")).withColumnRenamed("node", "rep")
    least = groups.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_least"))
    groups = groups.join(least, "component").select("rep", "component_least")
    per_class = classes.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "v", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_least", "least").alias("component"))
    joined = hot_join(good, persisted(per_class, "dedup-per-class"), ["v"], "copies", n["rows"] or 0).select("vec_id", "n_links", "component")
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return joined.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
