"""Substring dedup: words under a window of ``WINDOW`` words that also starts in
a document with a smaller id are removed.

Counting every window would shuffle more bytes than the texts have, so a
count-min prefilter comes first. Each window is counted under its anchor: the
smallest hash among the ``GRAM``-word runs inside it. Equal windows have equal
anchors, so an anchor's count is never below a window's, and a text has one
anchor per 16 words or so.

Documents fall in buckets by a hash of their id and text, so rows of one id, or
of none, are spread as well (one shuffle of the texts, which all three passes read).
What has to meet across buckets goes to blocks of cells or segments of windows in
packed rows, one per bucket and block or segment:

1. each bucket makes its sketch: SKETCH_ROWS rows of cells, their number fixed by the
   cluster's shuffle partitions (BLOCK_CELLS cells a block), in which each document
   adds 1 for each of its anchors, saturating at 2. A sketch travels without its empty
   cells, so it has BLOCK_CELLS x blocks entries a row at most, however many anchors
   there are. A block adds the buckets' sketches up and tells each bucket which
   of the cells it hit are at two or more in the merged sketch. A bucket estimates
   an anchor by the least of its cells there;
2. each bucket sends the 128-bit fingerprints of its windows whose anchor is
   estimated at two or more, with the smallest id it has seen each in; a segment
   groups them exactly and answers where a smaller id exists elsewhere;
3. each bucket removes the covered words.

An anchor, window or passage in a third of all documents sends one entry per
bucket, however many documents hold it; no task sees more than a bucket, a block or
a segment, and all are numbered in proportion to the cluster's shuffle partitions.
Two different windows of 10^13 agree in 128 bits with probability below 1e-12.

Defined cases: null text has no words; texts shorter than a window lose nothing;
rows of one doc_id (repeats) are documents of equal id and don't remove from each
other; a null doc_id counts as larger than all others; windows are judged on the
input; an empty table gives an empty result; extra columns are carried by
``dedup`` under their own names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm.common import (concat_binary, mix, shuffle_width, split_by, text_bytes, window_hashes, word_bounds,
                                  word_hashes)

WINDOW = 50
GRAM = 20                    # words of an anchor
BUCKETS_PER_PARTITION = 4
SKETCH_ROWS = 2
BLOCK_CELLS = 1 << 21        # cells of one row in one block
NO_ID = np.iinfo(np.int64).max


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values (by doubling)."""
    n, width = len(values) - size + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[size - width:size - width + n])


class Texts:
    """Windows of a bucket's documents, one after the other."""

    def __init__(self, group: pa.Table, window: int, id_col: str, text_col: str, anchors: bool, prints: bool):
        self.raw = []
        text = group.column(text_col).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        ids = group.column(id_col).to_pylist()
        self.ids = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.words = np.zeros(len(ids), dtype=np.int64)
        anchor, first, second, counts = [], [], [], []
        for i in range(len(ids)):
            data = text_bytes(text, i)
            self.raw.append(data)
            letters = np.frombuffer(data, dtype=np.uint8)
            start, end = word_bounds(letters)
            self.words[i] = len(start)
            counts.append(max(0, len(start) - window + 1))
            if len(start) < window:
                continue
            hashes = word_hashes(letters, start, end)
            if anchors:
                gram = min(GRAM, window)
                anchor.append(sliding_min(window_hashes(hashes, gram), window - gram + 1))
            if prints:
                first.append(window_hashes(hashes, window))
                second.append(window_hashes(word_hashes(letters, start, end, lane=1), window, lane=1))
        self.counts = np.array(counts, dtype=np.int64)
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        self.anchors, self.first, self.second = join(anchor), join(first), join(second)

    def window_ids(self) -> np.ndarray:
        return np.repeat(self.ids, self.counts)


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number of each row in that order) of equal 128-bit pairs."""
    order = np.argsort(first, kind="stable")
    same = first[order[1:]] == first[order[:-1]]
    if (same & (second[order[1:]] != second[order[:-1]])).any():
        order = np.lexsort((second, first))
        same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    return order, np.concatenate(([0], np.cumsum(~same))) if len(order) else np.empty(0, dtype=np.int64)


def _segment(values: np.ndarray, segments: int) -> np.ndarray:
    return ((values >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_SKETCH = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_REPEATED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("cells", pa.binary())])
_PRINTS = pa.schema([("segment", pa.int32()), ("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("ids", pa.binary())])
_SMALLER = pa.schema([("bucket", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("ids", pa.binary())])


def cells_of(anchors: np.ndarray, row: int, blocks: int, size: int) -> np.ndarray:
    """The anchors' cells in one row of the sketch, of blocks x size."""
    return (mix(anchors ^ np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(blocks * size)).astype(np.int64)


def partition_sketch(texts: Texts, bucket: int, blocks: int, size: int = BLOCK_CELLS) -> pa.Table:
    """The bucket's count-min sketch, by block: cells in the block (row r's begin at
    r x size) and their counts (2: two or more)."""
    document = np.repeat(np.arange(len(texts.ids)), texts.counts)
    order = np.lexsort((document, texts.anchors))
    anchors, document = texts.anchors[order], document[order]
    once = np.ones(len(anchors), dtype=bool)                  # an anchor counts once per document
    once[1:] = (np.diff(anchors) != 0) | (np.diff(document) != 0)
    anchors = anchors[once]
    rows = [np.unique(cells_of(anchors, row, blocks, size), return_counts=True) for row in range(SKETCH_ROWS)]
    block = np.concatenate([cells // size for cells, _ in rows])
    local = np.concatenate([cells % size + row * size for row, (cells, _) in enumerate(rows)]).astype("<u4")
    counts = np.minimum(np.concatenate([n for _, n in rows]), 2).astype(np.uint8)
    return _rows(_SKETCH, [{"block": b, "bucket": bucket, "cells": local[at].tobytes(), "counts": counts[at].tobytes()}
                           for b, at in split_by(block, blocks)])


def merge_sketches(group: pa.Table, size: int = BLOCK_CELLS) -> pa.Table:
    """One block of all sketches added up; for each bucket, which of its cells are
    at two or more."""
    merged = np.zeros(SKETCH_ROWS * size, dtype=np.uint8)
    parts = [np.frombuffer(c, dtype="<u4") for c in group.column("cells").to_pylist()]
    for cells, counts in zip(parts, group.column("counts").to_pylist()):          # a bucket has a cell once
        merged[cells] = np.minimum(merged[cells] + np.frombuffer(counts, dtype=np.uint8), 2)
    out = [{"block": block, "bucket": bucket, "cells": some.tobytes()} for block, bucket, cells in
           zip(group.column("block").to_pylist(), group.column("bucket").to_pylist(), parts) if len(some := cells[merged[cells] >= 2])]
    return _rows(_REPEATED, out)


def estimated_repeated(anchors: np.ndarray, answers: pa.Table, blocks: int, size: int = BLOCK_CELLS) -> np.ndarray:
    """Which anchors the merged sketch estimates at two documents or more: all of
    their cells are."""
    parts = [np.frombuffer(c, dtype="<u4").astype(np.int64) for c in answers.column("cells").to_pylist()]
    local = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    block = np.repeat(answers.column("block").to_numpy().astype(np.int64), [len(p) for p in parts])
    keep = np.ones(len(anchors), dtype=bool)
    for row in range(SKETCH_ROWS):
        mine = local // size == row
        keep &= np.isin(cells_of(anchors, row, blocks, size), block[mine] * size + local[mine] % size)
    return keep


def send_prints(texts: Texts, keep: np.ndarray, bucket: int, segments: int) -> pa.Table:
    """Fingerprints of the windows to ``keep``, each with the smallest id of the
    bucket it starts in."""
    first, second, ids = texts.first[keep], texts.second[keep], texts.window_ids()[keep]
    order, number = grouped(first, second)
    if not len(order):
        return _PRINTS.empty_table()
    begin = np.flatnonzero(np.concatenate(([True], np.diff(number) > 0)))
    least = np.minimum.reduceat(ids[order], begin)
    first, second = first[order[begin]], second[order[begin]]
    return _rows(_PRINTS, [{"segment": s, "bucket": bucket, "first": first[at].tobytes(), "second": second[at].tobytes(),
                            "ids": least[at].tobytes()} for s, at in split_by(_segment(first, segments), segments)])


def group_prints(group: pa.Table) -> pa.Table:
    """Exact groups of one segment; tells each bucket the smallest id of those
    windows that start in a document with a smaller id than its own."""
    first, second = (concat_binary(group.column(c), "<u8") for c in ("first", "second"))
    ids = concat_binary(group.column("ids"), "<i8")
    sizes = [len(a) // 8 for a in group.column("ids").to_pylist()]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order, number = grouped(first, second)
    if not len(order):
        return _SMALLER.empty_table()
    begin = np.flatnonzero(np.concatenate(([True], np.diff(number) > 0)))
    least = np.empty(len(first), dtype=np.int64)
    least[order] = np.minimum.reduceat(ids[order], begin)[number]
    tell = np.flatnonzero(least < ids)
    buckets = group.column("bucket").to_pylist()
    return _rows(_SMALLER, [{"bucket": buckets[r], "first": first[tell[at]].tobytes(), "second": second[tell[at]].tobytes(),
                             "ids": least[tell[at]].tobytes()} for r, at in split_by(row[tell], len(sizes))])


def covered(texts: Texts, answers: pa.Table, window: int) -> list[np.ndarray]:
    """For each document, which of its words are removed."""
    first, second = (np.concatenate((a, concat_binary(answers.column(c), "<u8")))
                     for c, a in (("first", texts.first), ("second", texts.second)))
    own = texts.window_ids()
    ids = np.concatenate((own, concat_binary(answers.column("ids"), "<i8")))
    order, number = grouped(first, second)
    removed = np.zeros(len(own), dtype=bool)
    if len(order):
        begin = np.flatnonzero(np.concatenate(([True], np.diff(number) > 0)))
        least = np.empty(len(ids), dtype=np.int64)
        least[order] = np.minimum.reduceat(ids[order], begin)[number]
        removed = least[:len(own)] < own
    out, at = [], 0
    for words, n in zip(texts.words, texts.counts):
        step = np.zeros(words + 1, dtype=np.int64)
        hit = np.flatnonzero(removed[at:at + n])
        step[hit] += 1
        step[hit + window] -= 1
        out.append(np.cumsum(step[:-1]) > 0)
        at += n
    return out


def _dedup(docs: DataFrame, emit, output: pa.Schema, output_ddl: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """The three passes; ``emit(group, texts, removed)`` makes the output rows."""
    segments = shuffle_width(docs.sparkSession)
    parts = BUCKETS_PER_PARTITION * segments
    bucketed = docs.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(parts)).cast("int")) \
        .withColumn(text_col, F.col(text_col).cast("string")).repartition("_bucket")

    def sketch(group: pa.Table) -> pa.Table:
        return partition_sketch(Texts(group, window, id_col, text_col, True, False), group.column("_bucket")[0].as_py(), segments)

    def prints(group: pa.Table, repeated: pa.Table) -> pa.Table:
        if not len(group) or not len(repeated):
            return _PRINTS.empty_table()
        texts = Texts(group, window, id_col, text_col, True, True)
        return send_prints(texts, estimated_repeated(texts.anchors, repeated, segments), group.column("_bucket")[0].as_py(), segments)

    def apply(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return output.empty_table()
        texts = Texts(group, window, id_col, text_col, False, True)
        return emit(group, texts, covered(texts, answers, window))

    repeated = bucketed.groupBy("_bucket").applyInArrow(sketch, "block int, bucket int, cells binary, counts binary") \
        .groupBy("block").applyInArrow(lambda group: merge_sketches(group), "block int, bucket int, cells binary")
    smaller = bucketed.groupBy("_bucket").cogroup(repeated.groupBy("bucket")) \
        .applyInArrow(prints, "segment int, bucket int, first binary, second binary, ids binary") \
        .groupBy("segment").applyInArrow(group_prints, "bucket int, first binary, second binary, ids binary")
    return bucketed.groupBy("_bucket").cogroup(smaller.groupBy("bucket")).applyInArrow(apply, output_ddl)


def _kept(data: bytes, removed: np.ndarray) -> bytes:
    words = data.split()
    return b" ".join(words if not removed.any() else [words[k] for k in np.flatnonzero(~removed).tolist()])


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then n_words and n_removed. A text that loses
    words becomes its kept words joined by one space, any other stays as it is.
    (Columns named n_words or n_removed that ``docs`` has are replaced.)"""
    from pyspark.sql.pandas.types import to_arrow_schema
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_words", "n_removed")]
    # The other columns ride along as one struct, so their names can't clash.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(F.lit(True).alias("_"), *[F.col(c) for c in others]).alias("others"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n_words long", "n_removed long"])
    output = to_arrow_schema(T.StructType.fromDDL(ddl))      # everything nullable

    def emit(group: pa.Table, texts: Texts, removed: list[np.ndarray]) -> pa.Table:
        text = [_kept(d, r).decode() if r.any() else old
                for d, r, old in zip(texts.raw, removed, group.column("text").to_pylist())]
        return pa.Table.from_arrays(
            [group.column("doc_id"), pa.array(text, pa.string()), group.column("others").cast(output.field("others").type),
             pa.array(texts.words), pa.array([int(r.sum()) for r in removed], pa.int64())], schema=output)

    done = _dedup(rows, emit, output, ddl, window, "doc_id", "text")
    named = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), text_col: F.col("text").alias(text_col)}
    return done.select(*[named.get(c, F.col("others").getField(c).alias(c)) for c in docs.columns if c not in ("n_words", "n_removed")],
                       "n_words", "n_removed")


def dedup_digest(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: the same passes, with the digest
    of the kept words taken in place."""
    output = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def emit(group: pa.Table, texts: Texts, removed: list[np.ndarray]) -> pa.Table:
        digests = [hashlib.sha256(_kept(d, r)).hexdigest() for d, r in zip(texts.raw, removed)]
        return pa.Table.from_arrays([group.column("doc_id"), pa.array(texts.words),
                                     pa.array([int(r.sum()) for r in removed], pa.int64()), pa.array(digests, pa.string())],
                                    schema=output)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _dedup(rows, emit, output, "doc_id long, n_words long, n_removed long, kept_sha256 string", window, "doc_id", "text")
