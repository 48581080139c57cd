"""Similarity join of documents by the Jaccard similarity of their word shingles:
universe partitioning, the pigeonhole principle, exact verification.

With t = p/q, two sets of sizes a and b have a similarity of t or more exactly
when their symmetric difference is at most H = (a + b)(q - p) // (q + p).

Size bands. Band g holds sizes 2^g .. 2^(g+1)-1; a pair is looked for in the
group of its smaller set's band, so a set is in its own group and, if it is not
too large, in the one below.

Segments. A group hashes tokens into m segments. A set's part in a segment is a
key. At most H segments of a linked pair differ, which gives two schemes:

* threshold 0: m is 2(H + 1) or a little more; all sets order their m keys alike
  (cheap keys first), and the first H + 1 of both sets of a linked pair share
  one: the first of their common keys has at most H others before it. A set
  indexes this subset of its segments. A key's cost is that of its rarest token
  in a sketch of document frequencies over all documents, so keys made up of
  very common tokens, and empty segments, are left out of the subset.
* threshold 1: m is H // 2 + 1, so some segment differs in at most one token; a
  set indexes every segment's part and its one-deletion neighbourhood.

A cost model over measured sizes and token frequencies allocates one of the two
to each group (long keys pay in small groups of much-repeated tokens).

Candidates. Sets that share a key make a candidate group. Round 1 pairs every
set with the smallest id of each of its groups; its links make components. Round
2 takes all pairs of sets that share a key and are in different components yet,
so the pairs inside a group of near copies are never listed, and no link between
components is lost.

Verification. First a lower bound of the symmetric difference from a bitmap of
two to four bits per token (it never drops a link); what is left is counted on whole
sets (array_intersect). Only sets in such pairs are read out,
through a bitmap of their ids with a fixed number of bits.

Copies. Equal sets are one node (its smallest id): 128-bit fingerprints, grouped.

Texts are read by narrow scans and never shuffled. Keys cross the network packed
(8 to 10 bytes each) per batch and segment.

Defined cases: null text or a text without words has the empty set (size 0) and
links with nothing; fewer words than a shingle make one shingle; rows of one
doc_id are one node with several sets; a null doc_id links with nothing and has
a null component; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import (concat_binary, hot_join, mix, persisted, released, shuffle_width, small_batches, split_by,
                                  text_bytes, window_hashes, word_bounds, word_hashes)
from cartwheel.llm.components import components

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
SKETCH_BITS = 18             # cells of the document frequency sketch
HOT = 4                      # a token counts as common from so many times the mean cell
BLOCK = 1024                 # members of a candidate group compared in one go
ID_BITS = 27                 # bitmap of ids whose sets are read out: 16 MB
FLUSH_KEYS = 1 << 18
SEGMENTS_PER_PARTITION = 2


class Bounds:
    """The integer bounds of one similarity."""

    def __init__(self, similarity: Fraction = SIMILARITY):
        self.p, self.q = similarity.numerator, similarity.denominator

    def difference(self, total: int) -> int:
        """Largest symmetric difference of linked sets with ``total`` tokens."""
        return total * (self.q - self.p) // (self.q + self.p)

    def partner(self, n: int) -> int:
        """Largest set a set of ``n`` tokens can be linked with."""
        return n * self.q // self.p

    def groups(self, n: int) -> list[tuple[int, int]]:
        """(group, H against any partner in it) of a set of ``n`` tokens."""
        own = n.bit_length() - 1
        out = [(own, self.difference(n + self.partner(n)))]
        below = (1 << own) - 1
        if own and n <= self.partner(below):
            out.append((own - 1, self.difference(n + below)))
        return out

    def largest(self, group: int) -> int:
        """H of the largest pair of a group."""
        top = (2 << group) - 1
        return self.difference(top + self.partner(top))


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the text's word shingles."""
    letters = np.frombuffer(data.lower(), dtype=np.uint8)       # ASCII only
    start, end = word_bounds(letters)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    width = min(size, len(start))
    return np.unique(window_hashes(word_hashes(letters, start, end), width) + np.uint64(width))


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, independent of order, as two signed longs."""
    return tuple(int(np.int64(np.add.reduce(mix(tokens ^ np.uint64(salt)), dtype=np.uint64).view(np.int64)))
                 for salt in (0x51ED270B, 0x2545F491))


def profile(tokens: np.ndarray) -> bytes:
    """Parities of the token counts in two to four cells a token, as bits: where
    two sets differ in a cell's parity they differ in a token of it."""
    bits = min(17, max(6, (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(cells: np.ndarray, width: int) -> np.ndarray:
    """A bitmap halved (cells that agree in the lower bits of their number
    meet) until it has ``width`` bytes."""
    while len(cells) > width:
        half = len(cells) // 2
        cells = cells[:half] ^ cells[half:]
    return cells


def difference_bound(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets."""
    width = min(len(a), len(b))
    x, y = (fold(np.frombuffer(v, dtype=np.uint8), width) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


# ---- pass 1: facts of every document, and the frequency sketch ----------------

_FACTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
                    ("profile", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
_FACTS_DDL = "doc_id long, n long, fp1 long, fp2 long, profile binary, block int, counts binary"
_SKETCH_BLOCKS = 64


def _facts(rows: DataFrame) -> DataFrame:
    """A row per document, and at the end of each task its sketch in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            text, out = batch.column("text"), []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                tokens = shingles(text_bytes(text, i))
                fp1, fp2 = fingerprint(tokens) if len(tokens) else (0, 0)
                out.append({"doc_id": doc_id, "n": len(tokens), "fp1": fp1, "fp2": fp2, "profile": profile(tokens)})
                if len(tokens):
                    cells += np.bincount((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells)) \
                        if len(tokens) > 4096 else 0
                    if len(tokens) <= 4096:
                        np.add.at(cells, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_pylist(out, schema=_FACTS)
        if cells.any():
            yield pa.RecordBatch.from_pylist(
                [{"block": b, "counts": part.astype("<i8").tobytes()} for b, part in enumerate(np.split(cells, _SKETCH_BLOCKS))],
                schema=_FACTS)

    return rows.mapInArrow(lambda batches: released(run(batches)), _FACTS_DDL)


def _merged_sketch(facts: DataFrame) -> np.ndarray:
    """The tasks' sketches added up: 2^SKETCH_BITS counts, whatever the corpus."""
    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, dtype="<i8") for c in group.column("counts").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    # Two steps, so no task adds up more than the square root of the tasks' sketches.
    partial = facts.where("block is not null").select("block", "counts").withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(32)))
    halves = partial.groupBy("block", "part").applyInArrow(add, "block int, counts binary")
    cells = np.zeros(1 << SKETCH_BITS, dtype=np.int64).reshape(_SKETCH_BLOCKS, -1)
    for r in halves.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        cells[r["block"]] = np.frombuffer(r["counts"], dtype="<i8")
    return cells.reshape(-1)


def heat_table(cells: np.ndarray) -> np.ndarray:
    """Cost class of each cell: 0, or the log of how far it is above the mean."""
    mean = max(1.0, cells.mean())
    heat = np.zeros(len(cells), dtype=np.uint8)
    hot = cells > HOT * mean
    heat[hot] = np.floor(np.log2(cells[hot] / mean)).astype(np.uint8)
    return heat


class Allocation:
    """Segments and threshold of every group."""

    def __init__(self, bounds: Bounds, documents: dict[int, int], repeat: float):
        """``documents``: sets per group; ``repeat``: the chance that a token of
        one set is in another one."""
        self.bounds, self.plan = bounds, {}
        for group, count in documents.items():
            h, n = bounds.largest(group), 1.5 * (1 << group)
            m0, m1 = 2 * (h + 1) + 6, h // 2 + 1
            wide = n / m1
            thin = float(np.exp(-wide) * (1 + wide))       # chance of a part with at most one token
            cost0 = (h + 1) * (1 + count * repeat)
            cost1 = (n + m1) * (1 + count * (repeat ** min(wide, n) + (thin if m1 > 1 else 0.0)))
            self.plan[group] = (0, m0) if cost0 <= cost1 else (1, m1)

    def keys(self, tokens: np.ndarray, heat: np.ndarray) -> np.ndarray:
        """All keys of a set, over its groups."""
        out = []
        for group, h in self.bounds.groups(len(tokens)):
            threshold, m = self.plan[group]
            salt = mix(np.array([group + 1], dtype=np.uint64))[0]
            mixed = mix(tokens ^ salt)
            segment = (mixed % np.uint64(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            sorted_segment = segment[order]
            begin = np.flatnonzero(np.concatenate(([True], np.diff(sorted_segment) > 0)))
            number = sorted_segment[begin]
            part = np.add.reduceat(mixed[order], begin)
            seed = mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
            if threshold == 0:
                cost = np.full(m, 255, dtype=np.int64)
                cost[number] = np.minimum.reduceat(heat[(tokens[order] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], begin)
                content = np.zeros(m, dtype=np.uint64)
                content[number] = part
                key = mix(content + seed)
                out.append(key[np.lexsort((key, cost))[:h + 1]])
            else:
                content = np.zeros(m, dtype=np.uint64)
                content[number] = part
                which = np.searchsorted(number, sorted_segment)
                without = part[which] - mixed[order]
                out += [mix(content + seed), mix(without + seed[sorted_segment])]
        return np.unique(np.concatenate(out))


# ---- pass 2: keys, and candidate groups ---------------------------------------

_KEYS = pa.schema([("segment", pa.int32()), ("first", pa.int64()), ("offsets", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_KEYS_DDL = "segment int, first long, offsets binary, low binary, high binary"


def _packed_keys(keys: np.ndarray, docs: np.ndarray, segments: int) -> pa.RecordBatch:
    """(key, document) entries by segment: 48 bits of the key and the document
    as an offset from the row's smallest."""
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    rows = []
    for s, at in split_by(((keys >> np.uint64(48)) % np.uint64(segments)).astype(np.int64), segments):
        k, d = keys[at], docs[at]
        offsets = d - d[0]
        rows.append({"segment": s, "first": int(d[0]), "offsets": offsets.astype("<u4" if offsets[-1] < 1 << 32 else "<u8").tobytes(),
                     "low": (k & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                     "high": ((k >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()})
    return pa.RecordBatch.from_pylist(rows, schema=_KEYS)


def _keys(rows: DataFrame, allocation: Allocation, heat: np.ndarray, segments: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((allocation, heat))    # 2^SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allocation, heat = shared.value
        for batch in batches:
            keys, owners, held, seen = [], [], 0, {}
            text = batch.column("text")
            ids = batch.column("doc_id").to_pylist()
            # Ascending ids: of equal sets in a batch the smallest id stands for all.
            for i in sorted((i for i, x in enumerate(ids) if x is not None), key=ids.__getitem__):
                tokens = shingles(text_bytes(text, i))
                if not len(tokens) or seen.setdefault(fingerprint(tokens), ids[i]) != ids[i]:
                    continue
                found = allocation.keys(tokens, heat)
                keys.append(found)
                owners.append(np.full(len(found), ids[i], dtype=np.int64))
                held += len(found)
                if held > FLUSH_KEYS:
                    yield _packed_keys(np.concatenate(keys), np.concatenate(owners), segments)
                    keys, owners, held = [], [], 0
            if keys:
                yield _packed_keys(np.concatenate(keys), np.concatenate(owners), segments)

    return rows.mapInArrow(lambda batches: released(run(batches)), _KEYS_DDL)


_CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()),
                         ("members", pa.list_(pa.int64()))])
_CANDIDATES_DDL = "a long, b long, id1 long, id2 long, members array<long>"


def candidate_groups(group: pa.Table) -> pa.Table:
    """One segment's entries: for every key the smallest document paired with
    each other one (a, b), and each distinct list of three or more documents once
    (id1, id2, members)."""
    docs = []
    for first, offsets, low in zip(*(group.column(c).to_pylist() for c in ("first", "offsets", "low"))):
        docs.append(first + np.frombuffer(offsets, dtype="<u4" if len(offsets) == len(low) else "<u8").astype(np.int64))
    docs = np.concatenate(docs)
    keys = concat_binary(group.column("low"), "<u4").astype(np.uint64) | (concat_binary(group.column("high"), "<u2").astype(np.uint64) << np.uint64(32))
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    once = np.concatenate(([True], (np.diff(keys) != 0) | (np.diff(docs) != 0)))
    keys, docs = keys[once], docs[once]
    begin = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
    size = np.diff(np.append(begin, len(keys)))
    begin, size = begin[size > 1], size[size > 1]
    if not len(begin):
        return _CANDIDATES.empty_table()
    at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    member, start = docs[at], np.cumsum(size) - size
    first = np.repeat(member[start], size)
    other = np.ones(len(member), dtype=bool)
    other[start] = False
    pairs = np.unique(np.stack((first[other], member[other])), axis=1)
    id1 = np.add.reduceat(mix(member.astype(np.uint64)), start).view(np.int64)
    id2 = np.add.reduceat(mix(member.astype(np.uint64) ^ np.uint64(0xABCDEF)), start).view(np.int64)
    _, lists = np.unique(np.stack((id1, id2, size)), axis=1, return_index=True)
    lists = lists[size[lists] > 2]
    pad = lambda v, kind: pa.concat_arrays([v, pa.nulls(len(lists), kind)])
    none = pa.nulls(pairs.shape[1], pa.int64())
    return pa.Table.from_arrays(
        [pad(pa.array(pairs[0]), pa.int64()), pad(pa.array(pairs[1]), pa.int64()),
         pa.concat_arrays([none, pa.array(id1[lists])]), pa.concat_arrays([none, pa.array(id2[lists])]),
         pa.array([None] * pairs.shape[1] + [member[start[k]:start[k] + size[k]] for k in lists], pa.list_(pa.int64()))],
        schema=_CANDIDATES)


# ---- verification -------------------------------------------------------------

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _possible(pairs: DataFrame, facts: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs (a < b) whose sizes and bitmaps allow a link; distinct."""
    side = lambda x: facts.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("profile").alias(f"p{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(
        (F.least("na", "nb") * bounds.q >= F.greatest("na", "nb") * bounds.p) & (F.least("na", "nb") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [difference_bound(x, y) <= bounds.difference(n + m) for x, y, n, m in
                    zip(*(batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long").distinct()


def _sets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents in ``pairs`` and a few more: ids are
    looked up in a bitmap of 2^ID_BITS bits, the only thing collected."""
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS)) + 1  # noqa: E731  Spark's bit numbers begin at 1
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(number("id").alias("bit"))
    maps = ids.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    size = len(maps[0]["map"]) if maps else 4096
    bitmap = np.zeros((1 << ID_BITS) // 8, dtype=np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * size
        bitmap[at:at + size] = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    # Buckets begin at 1 and hold 8 * size bits; positions in them at 0.
    wanted = rows.where("doc_id is not null").withColumn("bit", number(F.col("doc_id").cast("long"))) \
        .withColumn("place", (F.bitmap_bucket_number("bit") - 1) * F.lit(8 * size) + F.bitmap_bit_position("bit"))
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = np.flatnonzero((place >= 0) & (bitmap[np.clip(place >> 3, 0, len(bitmap) - 1)] >> (place & 7).astype(np.uint8) & 1 == 1))
            text, ids, tokens, held = batch.column("text"), [], [], 0
            for i in hit.tolist():
                found = shingles(text_bytes(text, i)).view(np.int64)
                ids.append(batch.column("doc_id")[i].as_py())
                tokens.append(found)
                held += len(found)
                if held > FLUSH_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], schema=schema)
                    ids, tokens, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], schema=schema)

    return wanted.select("doc_id", "text", "place").mapInArrow(lambda batches: released(run(batches)), "doc_id long, tokens array<long>")


def _verified(pairs: DataFrame, facts: DataFrame, rows: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs that are links, counted on whole sets."""
    possible = persisted(_possible(pairs, facts, bounds), "ngram-possible")
    sets = _sets(rows, possible)
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}"))
    total = F.size("ta") + F.size("tb")
    common = F.size(F.array_intersect("ta", "tb"))
    linked = (total - 2 * common) * (bounds.q + bounds.p) <= total * (bounds.q - bounds.p)
    return persisted(possible.join(side("b"), "b").join(side("a"), "a").where(linked).select("a", "b").distinct(), "ngram-links")


def compare_members(group: pa.Table, bounds: Bounds) -> pa.Table:
    """Pairs of one task's units (hub, i, j) that share a candidate group, are in
    different components, and whose sizes and bitmaps allow a link. A pair is
    looked at once, however many groups it shares."""
    out_a, out_b = [], []
    unit = np.stack([group.column(c).to_numpy() for c in ("hub", "i", "j")])
    _, number = np.unique(unit, axis=1, return_inverse=True)
    for _, at in split_by(number.reshape(-1), int(number.max()) + 1):
        part = group.take(pa.array(at))
        node, comp, n, block, i, j = (part.column(c).to_numpy() for c in ("node", "component", "n", "block", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        row, column = np.full(len(node), -1), np.full(len(node), -1)
        row[left], column[right] = np.arange(len(left)), np.arange(len(right))
        together = np.zeros((len(left), len(right)), dtype=bool)
        lists = part.column("lists").to_pylist()
        owner = np.repeat(np.arange(len(node)), [len(x) for x in lists])
        order = np.argsort(flat := np.array([y for x in lists for y in x], dtype=np.int64), kind="stable")
        for members in np.split(owner[order], np.flatnonzero(np.diff(flat[order])) + 1):
            r, c = row[members], column[members]
            together[np.ix_(r[r >= 0], c[c >= 0])] = True
        together &= comp[left][:, None] != comp[right][None, :]
        if i[0] == j[0]:
            together &= node[left][:, None] < node[right][None, :]
        cells = [np.frombuffer(p, dtype=np.uint8) for p in part.column("profile").to_pylist()]
        width = min(map(len, cells))
        cells = np.stack([fold(c, width) for c in cells])
        for k in np.flatnonzero(together.any(axis=1)).tolist():
            x, others = left[k], right[np.flatnonzero(together[k])]
            small, large = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
            others, total = others[near := small * bounds.q >= large * bounds.p], (small + large)[near]
            bound = np.bitwise_count(cells[others] ^ cells[x]).sum(axis=1, dtype=np.int64)
            others = others[bound <= total * (bounds.q - bounds.p) // (bounds.q + bounds.p)]
            out_a.append(np.minimum(node[others], node[x]))
            out_b.append(np.maximum(node[others], node[x]))
    if not out_a:
        return _PAIRS.empty_table()
    pairs = np.unique(np.stack((np.concatenate(out_a), np.concatenate(out_b))), axis=1)
    return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIRS)


def _cross_pairs(groups: DataFrame, nodes: DataFrame, reps: DataFrame, bounds: Bounds, parts: int) -> DataFrame:
    """Pairs of different components inside the candidate groups, in blocks.
    Groups with the same smallest member (their hub) overlap most: they go to
    the same tasks, where a set's bitmap is sent once. ``nodes``: doc_id, rep,
    component; ``reps``: doc_id, n, profile."""
    members = groups.select(F.element_at("members", 1).alias("hub"), "id1", F.explode("members").alias("doc_id")) \
        .join(nodes, "doc_id").select("hub", "id1", F.col("rep").alias("node"), "component").distinct()
    mixed = members.groupBy("hub", "id1").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
        .where("low <> high").select("hub", "id1")
    per_node = members.join(mixed, ["hub", "id1"]).groupBy("hub", "node").agg(
        F.first("component").alias("component"), F.collect_list("id1").alias("lists"))
    blocks = per_node.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = per_node.join(blocks, "hub").join(reps.withColumnRenamed("doc_id", "node"), "node") \
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")) \
        .withColumn("task", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(parts)))
    return placed.select("task", "hub", "i", "j", "block", "node", "component", "n", "profile", "lists") \
        .groupBy("task").applyInArrow(lambda g: compare_members(g, bounds), "a long, b long").distinct()


def link_components(docs: DataFrame, similarity: Fraction = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    with small_batches(docs.sparkSession):
        return _link_components(docs, similarity, id_col, text_col)


def _link_components(docs: DataFrame, similarity: Fraction, id_col: str, text_col: str) -> DataFrame:
    spark, bounds = docs.sparkSession, Bounds(similarity)
    parts = SEGMENTS_PER_PARTITION * shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = persisted(_facts(rows), "ngram-facts")
    cells = _merged_sketch(facts)
    facts = facts.where("block is null").drop("block", "counts")
    some = facts.where("n > 0 and doc_id is not null")

    # Equal sets: one node each, the smallest id.
    classes = persisted(some.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
    given = classes.agg(F.sum("copies")).first()[0] or 0
    rep_of = persisted(hot_join(some.select("doc_id", "n", "fp1", "fp2"), classes, ["n", "fp1", "fp2"], "copies", given)
                       .select("doc_id", "rep"), "ngram-reps")
    reps = some.select("doc_id", "n", "profile").join(classes.select(F.col("rep").alias("doc_id"), "n").distinct(), ["doc_id", "n"], "left_semi")

    bands = {r["g"]: r["c"] for r in classes.groupBy(F.floor(F.log2(F.col("n") + 0.5)).cast("int").alias("g"))
             .agg(F.count(F.lit(1)).alias("c")).collect()}                        # at most 40 rows
    documents = {g: bands.get(g, 0) + bands.get(g + 1, 0) for g in range(0, max(bands, default=0) + 1)}
    total = float(cells.sum())
    repeat = float((cells.astype(float) ** 2).sum() / max(1.0, total) / max(1, sum(bands.values())) - total / len(cells) / max(1, sum(bands.values())))
    allocation = Allocation(bounds, documents, min(1.0, max(1e-9, repeat)))
    found = persisted(_keys(rows, allocation, heat_table(cells), parts).groupBy("segment").applyInArrow(candidate_groups, _CANDIDATES_DDL),
                      "ngram-candidates")

    pairs = found.where("a is not null").select("a", "b").distinct()
    to = lambda x: rep_of.select(F.col("doc_id").alias(x), F.col("rep").alias(f"r{x}"))
    pairs = persisted(pairs.join(to("a"), "a").join(to("b"), "b").where("ra <> rb").select("ra", "rb"), "ngram-pairs")
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    links = _verified(ordered(pairs, "ra", "rb"), reps, rows, bounds)

    # Rows of one doc_id with different texts are one node: their sets are tied.
    repeated = rep_of.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    ties = rep_of.join(repeated, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    links = links.union(ties)
    labels = persisted(components(links), "ngram-labels")

    nodes = rep_of.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    groups = found.where("id1 is not null").select("id1", "id2", "members").dropDuplicates(["id1", "id2"])
    more = _verified(_cross_pairs(groups, nodes, reps, bounds, parts), reps, rows, bounds)
    final = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    component = rep_of.join(final.withColumnRenamed("node", "rep"), "rep", "left") \
        .groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return facts.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
