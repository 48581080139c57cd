"""Trie of the conversations' prefixes, from a table of distinct prefix digests.

A node is a distinct sequence of a conversation's first d turns; its members are
the conversations that start with it. Its digest is the sum, over the turns, of a
128-bit hash of (place, role, text) in four lanes, so prefix digests are running
sums, and a parent's digest is its child's less the last turn's hash.

Steps, all over narrow rows (no text is shuffled):

1. ``turns`` numbers every conversation's turns (``ranked``: range partitions, no
   window over a conversation); ``paths`` adds up the lanes, in blocks of ``BLOCK``
   turns with the blocks' own running sums.
2. One aggregate over (depth, digest) gives every node its members' number, its
   smallest member (its home) and its longest member; a common first turn is
   combined before the shuffle.
3. Subtree sums. A node lies on its home's path, as do all its ancestors. So the
   paths are dealt to shards by (conversation, block), each node's own numbers go
   to the shard of its home, and every shard adds them up along its own paths:
   a minimal perfect hash gives each distinct digest of the shard a slot
   (verified against the stored digest), counts are scattered into flat arrays by
   slot, and the array of parent slots is walked in depth order. What a block
   passes to the block above it is added as a row of its own. Shards send one
   partial sum per node; those are added up by node.
4. A node's parent has the same home, but for the topmost node of each home. Those
   few (one per conversation at most) look their parent up: among the nodes with a
   ``HOT_PARTS``-th of all rows by a broadcast (there can't be more than HOT_PARTS
   of them), among the others by a shuffle in which no key is hotter than that.
5. Ids of the conversations that end in a node are joined, in order, into chunks
   where they lie, so the one task that must feed a node's digest in order reads a
   row per chunk, not one per conversation.

Defined cases: turns are in order of turn (null first), then of a digest of role
and text; null role or text is empty; rows without conv_id are no conversation;
repeated rows are turns of their own; a member without turns belongs to the root
only; without members there is no node; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.keys import ranked
from cartwheel.llm.common import mix, persisted, shuffle_width

BLOCK = 4096                 # depths of a path that stay together
SHARD_ROWS = 200_000         # path rows a shard is meant to hold at most
HOT_PARTS = 1024
CHUNK_IDS = 8192             # ids in one row of a node's endings
GAMMA = 1.5                  # cells per key in a level of the perfect hash
DIGEST = ["d0", "d1", "d2", "d3"]
PARENT = ["p0", "p1", "p2", "p3"]
NODE = ["depth", *DIGEST]


# ---- turns and rebuilt conversations -----------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n_bytes (of the text), digest (of role and text), written once."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return persisted(conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest")), "trie-own-turns")


def whole(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, members) of the conversations as they are, for ``prefix_trie``."""
    rows = ranked(own, ["conv_id"], ["turn", "digest"], "trie-ranked", total="len")
    members = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))
    return rows.select("conv_id", (F.col("rank") + 1).alias("depth"), "n_bytes", "digest", "len"), members


def spliced(own: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(rows, members) of the rebuilt conversations: c has the first h turns of
    conversation c - c % group, then its own after its first h; h is the CRC-32 of
    the decimal c modulo ``most``."""
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c, h = F.col("conv_id"), F.col("h")
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least(h, F.coalesce("n_base", F.lit(0).cast("long")))
    members = persisted(
        counts.withColumn("base", c - c % group).withColumn("h", F.crc32(c.cast("string")) % most).join(bases, "base", "left")
        .select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - h, F.lit(0).cast("long"))).alias("len")),
        "trie-members")
    rows = ranked(own, ["conv_id"], ["turn", "digest"], "trie-ranked", attach=members.select("conv_id", "h", "taken", "len"))
    late = rows.where("rank >= h").select("conv_id", (F.col("rank") + 1 - h + F.col("taken")).alias("depth"), "n_bytes", "digest", "len")
    first = rows.where(F.col("rank") < most - 1).select(F.col("conv_id").alias("base"), "rank", "n_bytes", "digest")
    early = first.join(members.where("taken > 0").select("conv_id", "base", "h", "len"), "base").where("rank < h") \
        .select("conv_id", (F.col("rank") + 1).alias("depth"), "n_bytes", "digest", "len")
    return late.unionByName(early), members.select("conv_id", "len")


# ---- paths and nodes ---------------------------------------------------------

def paths(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, depth, block, len, n_bytes, the prefix's digest and its parent's."""
    placed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    lanes = [F.conv(F.substring(placed, 1 + 8 * j, 8), 16, 10).cast("long").alias(f"h{j}") for j in range(4)]
    block = F.floor(F.col("depth") / size).cast("long")
    rows = persisted(rows.select("conv_id", "depth", block.alias("block"), "len", "n_bytes", *lanes), "trie-turns")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.where(F.col("len") >= size).groupBy("conv_id", "block").agg(*[F.sum(f"h{j}").alias(f"h{j}") for j in range(4)]) \
        .select("conv_id", "block", *[F.sum(f"h{j}").over(earlier).alias(f"o{j}") for j in range(4)]).where("block > 0")
    sums = rows.select("*", *[F.sum(f"h{j}").over(inside).alias(f"s{j}") for j in range(4)]).join(starts, ["conv_id", "block"], "left")
    total = [F.col(f"s{j}") + F.coalesce(f"o{j}", F.lit(0).cast("long")) for j in range(4)]
    return persisted(sums.select("conv_id", "depth", "block", "len", "n_bytes", *[t.alias(n) for t, n in zip(total, DIGEST)],
                                 *[(t - F.col(f"h{j}")).alias(n) for j, (t, n) in enumerate(zip(total, PARENT))]), "trie-paths")


def _root() -> list[Column]:
    return [F.lit(0).cast("long").alias(n) for n in NODE]


def _nodes(path: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node, the root included: home, n_convs, longest, n_bytes, parent's digest."""
    nodes = path.groupBy(*NODE).agg(
        F.min("conv_id").alias("home"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("longest"),
        F.max("n_bytes").alias("n_bytes"), *[F.min(p).alias(p) for p in PARENT])
    none = F.lit(None).cast("long")
    root = members.agg(F.min("conv_id").alias("home"), F.count(F.lit(1)).alias("n_convs"), F.max("len").alias("longest")) \
        .where("n_convs > 0").select(*_root(), "home", "n_convs", "longest", F.lit(0).cast("long").alias("n_bytes"), *[none.alias(p) for p in PARENT])
    return persisted(nodes.unionByName(root), "trie-nodes")


# ---- subtree sums in shards --------------------------------------------------

class SlotTable:
    """A minimal perfect hash of distinct rows of 64-bit integers: every level
    hashes the keys left into GAMMA cells each, keys alone in their cell stay, the
    rest go on. A key's slot is the rank of its cell among the taken ones. ``keys``
    holds each slot's key; ``slots`` compares it with the one asked for."""

    def __init__(self, rows: np.ndarray):
        for seed in range(64):
            self.seed = seed
            prints = self._prints(rows)
            order = np.argsort(prints, kind="stable")
            new = np.ones(len(rows), dtype=bool)
            new[1:] = prints[order[1:]] != prints[order[:-1]]
            first = order[new][np.cumsum(new) - 1] if len(rows) else order
            if (rows[first] == rows[order]).all():        # equal fingerprints, equal keys
                break
        else:
            raise RuntimeError("no seed tells the digests apart")
        distinct, left = rows[order[new]], prints[order[new]]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0
        while len(left):
            cell = self._cells(left, len(self.levels), max(1, int(GAMMA * len(left))))
            alone = np.bincount(cell, minlength=max(1, int(GAMMA * len(left)))) == 1
            self.levels.append((alone, at + np.cumsum(alone) - 1))
            at += int(alone.sum())
            left = left[~alone[cell]]
        self.keys = np.empty_like(distinct)
        slot = self._find(self._prints(distinct))
        self.keys[slot] = distinct
        if at != len(distinct) or (np.bincount(slot, minlength=at) != 1).any():
            raise RuntimeError("two digests in one slot")

    def __len__(self) -> int:
        return len(self.keys)

    def _prints(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), (self.seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64), dtype=np.uint64)
        for column in rows.T:
            out = mix(out ^ column)
        return out

    @staticmethod
    def _cells(prints: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(prints + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _find(self, prints: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(prints), -1, dtype=np.int64), np.arange(len(prints))
        for level, (taken, rank) in enumerate(self.levels):
            cell = self._cells(prints[open_], level, len(taken))
            hit = taken[cell]
            out[open_[hit]] = rank[cell[hit]]
            open_ = open_[~hit]
        return out

    def slots(self, rows: np.ndarray) -> np.ndarray:
        slot = self._find(self._prints(rows))
        if (slot < 0).any() or not (self.keys[slot] == rows).all():
            raise KeyError("a digest isn't in the table")
        return slot


_SUMS = pa.schema([(n, pa.int64()) for n in (*NODE, "n_children", "n_leaves", "saved_tokens")])


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def shard_sums(path: pa.Table, marks: pa.Table, size: int = BLOCK) -> pa.Table:
    """Partial sums of a shard. ``path``: whole (conversation, block) pieces;
    ``marks``: conv_id, depth, leaves, saved to be added at that prefix, own (it
    is a node at home here, else what lower blocks pass on)."""
    if not marks.num_rows:
        return _SUMS.empty_table()
    conv, depth, block = _columns(path, ["conv_id", "depth", "block"])
    m_conv, m_depth, m_leaves, m_saved, m_own = _columns(marks, ["conv_id", "depth", "leaves", "saved", "own"])
    kind = np.concatenate((np.zeros(len(conv), dtype=np.int8), np.ones(len(m_conv), dtype=np.int8)))
    order = np.lexsort((kind, np.concatenate((depth, m_depth)), np.concatenate((conv, m_conv))))
    sorted_path = order[kind[order] == 0]
    row_of = np.empty(len(m_conv), dtype=np.int64)          # the path row, in sorted order, of each mark
    after = np.cumsum(kind[order] == 0) - 1
    row_of[order[kind[order] == 1] - len(conv)] = after[kind[order] == 1]
    conv, depth, block = conv[sorted_path], depth[sorted_path], block[sorted_path]
    if (conv[row_of] != m_conv).any() or (depth[row_of] != m_depth).any():
        raise KeyError("a node isn't on its home's path")
    piece = np.cumsum(np.concatenate(([0], ((np.diff(conv) != 0) | (np.diff(block) != 0)).astype(np.int64))))
    used = np.zeros(piece[-1] + 1, dtype=bool)
    used[piece[row_of]] = True
    keep = used[piece]                                       # copies own no node: their paths add nothing
    row_of = (np.cumsum(keep) - 1)[row_of]
    sorted_path, depth = sorted_path[keep], depth[keep]

    def keys(names: list[str], at: np.ndarray) -> np.ndarray:
        return np.stack([at, *[x[sorted_path] for x in _columns(path, names)]], axis=1).astype(np.uint64)

    here, above = keys(DIGEST, depth), keys(PARENT, depth - 1)
    table = SlotTable(np.concatenate((here, above)))
    slot, up = table.slots(here), table.slots(above)
    parent = np.full(len(table), -1, dtype=np.int64)
    parent[slot] = up
    children, leaves, saved = (np.zeros(len(table), dtype=np.int64) for _ in range(3))
    np.add.at(leaves, slot[row_of], m_leaves)
    np.add.at(saved, slot[row_of], m_saved)
    np.add.at(children, parent[slot[row_of[m_own]]], 1)
    level = table.keys[:, 0].astype(np.int64)
    climbing = np.flatnonzero((parent >= 0) & (level % size != 0))
    climbing = climbing[np.argsort(-level[climbing], kind="stable")]
    cuts = np.flatnonzero(np.diff(level[climbing])) + 1
    for s in np.split(climbing, cuts):
        np.add.at(leaves, parent[s], leaves[s])
        np.add.at(saved, parent[s], saved[s])
    some = np.flatnonzero((children != 0) | (leaves != 0) | (saved != 0))
    found = table.keys[some].astype(np.int64)
    return pa.table([*found.T, children[some], leaves[some], saved[some]], schema=_SUMS)


def _subtree_sums(path: DataFrame, nodes: DataFrame, path_rows: int, size: int, shard_rows: int) -> DataFrame:
    own = nodes.where("depth > 0").select(
        F.col("home").alias("conv_id"), "depth", F.floor(F.col("depth") / size).cast("long").alias("block"), "longest",
        (F.col("longest") == F.col("depth")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.lit(True).alias("own"))
    # what the blocks of a long conversation pass to the ones above
    blocks = own.where(F.col("longest") >= size).groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    grid = blocks.groupBy("conv_id").agg(F.max("block").alias("last")).where("last > 0") \
        .select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    lower = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    passed = grid.join(blocks, ["conv_id", "block"], "left").select(
        "conv_id", ((F.col("block") + 1) * size - 1).alias("depth"), "block",
        F.sum("leaves").over(lower).alias("leaves"), F.sum("saved").over(lower).alias("saved"), F.lit(False).alias("own")) \
        .where("leaves IS NOT NULL")
    shards = max(shuffle_width(path.sparkSession), -(-path_rows // shard_rows))      # small tables are spread as well
    shard = F.pmod(F.xxhash64("conv_id", "block"), F.lit(shards)).alias("shard")
    marks = own.drop("longest").unionByName(passed).select(shard, "conv_id", "depth", "leaves", "saved", "own")
    pieces = path.select(shard, "conv_id", "depth", "block", *DIGEST, *PARENT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return shard_sums(left, right, size)

    return pieces.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(
        run, ", ".join(f"{n} long" for n in _SUMS.names))


# ---- parents and endings -----------------------------------------------------

def _parents(nodes: DataFrame, path_rows: int, members: int) -> DataFrame:
    """NODE, parent_conv_id for the topmost node of each home."""
    tops = nodes.where("depth > 0").groupBy("home").agg(F.min(F.struct(*NODE, *PARENT)).alias("top")).select("top.*")
    hot = F.col("n_convs") * HOT_PARTS >= path_rows + members        # at most HOT_PARTS nodes
    names = [F.col(n).alias(f"u_{n}") for n in NODE]
    same = (F.col("depth") - 1 == F.col("u_depth"))
    for p, d in zip(PARENT, DIGEST):
        same = same & (F.col(p) == F.col(f"u_{d}"))
    few = nodes.where(hot).select(*names, F.col("home").alias("parent_conv_id"))
    tried = tops.join(F.broadcast(few), same, "left")
    rest = tried.where("parent_conv_id IS NULL").select(*NODE, *PARENT) \
        .join(nodes.where(~hot).select(*names, F.col("home").alias("parent_conv_id")), same)
    return tried.where("parent_conv_id IS NOT NULL").select(*NODE, "parent_conv_id").unionByName(rest.select(*NODE, "parent_conv_id"))


_CHUNK = pa.schema([*[(n, pa.int64()) for n in NODE], ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([*[(n, pa.int64()) for n in NODE], ("ends_sha256", pa.string())])


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, conv_id): ids of neighbours of one node, joined."""
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in (*NODE, "conv_id")]
        ids = columns[-1].astype(str)
        change = np.zeros(len(ids), dtype=bool)
        for c in columns[:-1]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        starts = np.unique(np.concatenate((starts, np.arange(0, len(ids), size)))) if len(ids) else starts
        ends = np.append(starts[1:], len(ids))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c[starts]) for c in columns], pa.array([",".join(ids[a:b]) for a, b in zip(starts, ends)], pa.string())], schema=_CHUNK)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (node, first): the digest of every node's ids."""
    node, state = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*[batch.column(n).to_pylist() for n in (*NODE, "ids")]):
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=_ENDS)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], schema=_ENDS)


def _endings(path: DataFrame, members: DataFrame, size: int) -> DataFrame:
    ending = path.where("depth = len").select(*NODE, "conv_id").unionByName(members.where("len = 0").select(*_root(), "conv_id"))
    chunks = ending.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id") \
        .mapInArrow(lambda batches: _chunks(batches, size), ", ".join(f"{n} long" for n in (*NODE, "first")) + ", ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first") \
        .mapInArrow(_digests, ", ".join(f"{n} long" for n in NODE) + ", ends_sha256 string")


def prefix_trie(rows: DataFrame, members: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS,
                chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row per node. ``rows``: conv_id, depth (1, 2, ..), n_bytes, digest, len (turns of the
    conversation); ``members``: conv_id, len of every conversation, turnless ones
    too. Returns conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    path = paths(rows, block)
    nodes = _nodes(path, members)
    path_rows, convs = path.count(), members.count()
    sums = _subtree_sums(path, nodes, path_rows, block, shard_rows)
    values = {"home": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long",
              "parent_conv_id": "long", "ends_sha256": "string"}

    def part(df: DataFrame) -> DataFrame:
        return df.select(*NODE, *[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in values.items()])

    childless_root = F.when((F.col("depth") == 0) & (F.col("longest") == 0), F.lit(1).cast("long"))
    all_parts = part(nodes.select(*NODE, "home", "n_convs", childless_root.alias("n_leaves"))).unionByName(part(sums)) \
        .unionByName(part(_parents(nodes, path_rows, convs))).unionByName(part(_endings(path, members, chunk_ids)))
    added = ("n_children", "n_leaves", "saved_tokens")
    one = all_parts.groupBy(*NODE).agg(*[(F.sum(n) if n in added else F.max(n)).alias(n) for n in values])
    zero = F.lit(0).cast("long")
    return one.select(
        F.col("home").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "home")).alias("parent_conv_id"), "n_convs",
        *[F.coalesce(n, zero).alias(n) for n in added], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
