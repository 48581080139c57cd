"""Approximate nearest neighbours by inner product: one hierarchical navigable
small-world graph per shard, stored as flat neighbour arrays, shard results
merged.

Build. Equal vectors become one node that keeps its smallest ids (as many as a
result list can need). Nodes fall into shards by a hash: SHARDS_LEAST of them, more
where they would have over SHARD_ROWS nodes or SHARD_BYTES of vectors. In
a shard every node draws a level (geometric). On each level, from the top down, the
first nodes are linked by blocked products, the others inserted in batches that
search the graph built so far; neighbours are picked by the usual diversity rule (a
candidate is kept if no kept one is nearer to it than the node is), and linked
back. Norms may differ: vectors get one more component that makes them equally
long, which turns largest inner product into nearest vector. On level 0 a ring
through all nodes keeps the graph connected. The index is a table with one row a
node: its level and one flat array of neighbours per level.

Search. Equal query vectors are asked once. They are cut into blocks; a task holds
one shard and one block. From the top level's nodes a greedy walk goes down, then a
beam over level 0, for all queries of the block in lockstep. With S shards a shard
holds an S-th of a query's neighbours, so its beam is EF / sqrt(S) wide (EF_LEAST at
least). The shards' lists are merged per query and ranked by the inner product in
double precision. The work per query is that of a beam per shard: constant up to
SHARDS_LEAST x SHARD_ROWS nodes, then in proportion to the shards.

Defined cases: vectors that are null, empty, zero or have null or non-finite
components take no part, neither do rows of a null id; vectors of another
length than the query's aren't candidates (shards hold one length); of several rows
of one id the nearest counts, once, and none for that id's own query; different
vectors of one query id are all asked, and a candidate has the best of its scores;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.llm.common import hot_join, persisted
from cartwheel.llm.vectors import matrix, numbered, usable

TOP = 20
SHARD_ROWS = 65_536          # nodes per shard, at most
SHARD_BYTES = 64 << 20       # and bytes of their vectors
SHARDS_LEAST = 8             # shards that even a small table is built in, side by side
QUERY_BLOCK = 16_384
M = 16                       # neighbours on upper levels; twice as many on level 0
CANDIDATES = 64              # nearest nodes the neighbours are picked from
FIRST_BATCH = 8192           # nodes of a level linked by comparing all
LARGEST_BATCH = 4096
EF = 204                     # beam width of a query in a single shard
EF_LEAST = 40                # beam width in one shard


def equal_norms(x: np.ndarray) -> np.ndarray:
    """``x`` with one more column that gives all rows the largest norm."""
    squares = np.einsum("ij,ij->i", x, x)
    return np.column_stack((x, np.sqrt(np.maximum(0.0, squares.max(initial=0.0) - squares))))


def diverse(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, degree: int, block: int = 256) -> np.ndarray:
    """Up to ``degree`` neighbours (-1: none) for each of ``nodes`` from its
    candidates ``near`` (-1: none, no repeats): nearest first, one is kept if no
    kept one is nearer to it than the node is; places left go to the nearest ones
    that were passed over."""
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    for a in range(0, len(nodes), block):
        c = near[a:a + block]
        y = x[c]
        value = np.where(c >= 0, np.einsum("nd,ncd->nc", x[nodes[a:a + block]], y), -np.inf)
        order = np.argsort(-value, axis=1, kind="stable")
        c, value, y = np.take_along_axis(c, order, axis=1), np.take_along_axis(value, order, axis=1), np.take_along_axis(y, order[:, :, None], axis=1)
        between = y @ y.transpose(0, 2, 1)
        kept = np.zeros(c.shape, dtype=bool)
        for k in range(c.shape[1]):
            rival = np.where(kept, between[:, k, :], -np.inf).max(axis=1)
            kept[:, k] = (rival <= value[:, k]) & (kept.sum(axis=1) < degree) & (c[:, k] >= 0)
        rank = np.where(kept, 0, np.where(c >= 0, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        picked = np.take_along_axis(c, best, axis=1)
        out[a:a + block, :picked.shape[1]] = picked
    return out


def nearest_in(x: np.ndarray, nodes: np.ndarray, among: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """The ``k`` nearest of ``among`` for each of ``nodes``, itself left out (-1: none), by blocked products."""
    k = min(k, len(among))
    out = np.full((len(nodes), k), -1, dtype=np.int32)
    for a in range(0, len(nodes), block):
        value = x[nodes[a:a + block]] @ x[among].T
        value[nodes[a:a + block, None] == among[None, :]] = -np.inf
        top = np.argpartition(-value, k - 1, axis=1)[:, :k] if k < len(among) else np.tile(np.arange(k), (len(value), 1))
        out[a:a + block] = np.where(np.take_along_axis(value, top, axis=1) > -np.inf, among[top], -1)
    return out


def add_back_links(x: np.ndarray, flat: np.ndarray, nodes: np.ndarray, picked: np.ndarray) -> None:
    """Link the picked neighbours back to ``nodes``; a full list keeps its nearest."""
    source, target = np.repeat(nodes, picked.shape[1]), picked.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((-np.einsum("pd,pd->p", x[source], x[target]), target))
    source, target = source[order], target[order]
    ends, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    room = flat.shape[1]
    few = place < room                                              # nearest come first
    more = np.full((len(ends), min(room, int(count.max(initial=0)))), -1, dtype=np.int32)
    more[np.repeat(np.arange(len(ends)), count)[few], place[few]] = source[few]
    for a in range(0, len(ends), 2048):
        have = flat[ends[a:a + 2048]]
        more_a = more[a:a + 2048]
        more_a = np.where((more_a[:, :, None] == have[:, None, :]).any(axis=2), -1, more_a)
        both = np.concatenate((have, more_a), axis=1)
        value = np.where(both >= 0, np.einsum("nd,ncd->nc", x[ends[a:a + 2048]], x[both]), -np.inf)
        best = np.argsort(-value, axis=1, kind="stable")[:, :room]
        flat[ends[a:a + 2048]] = np.take_along_axis(both, best, axis=1)


def build_graph(x: np.ndarray, levels: np.ndarray) -> list[list[np.ndarray]]:
    """neighbours[level][node] (empty where the node isn't on the level).

    Levels are built from the top down; on each one nodes are inserted in batches,
    those of the levels above first: a batch looks for its nearest inserted nodes by
    a beam over the graph so far, from the nearest nodes of the level above, and
    adds the nearest of its own. A batch is an eighth of what is there, so the work
    per node is that of a search."""
    n = len(x)
    order = np.argsort(-levels, kind="stable").astype(np.int32)
    graph: list[list[np.ndarray]] = []
    above = order[:0]
    for level in range(int(levels.max(initial=0)), -1, -1):
        nodes, degree = order[:int((levels >= level).sum())], 2 * M if level == 0 else M
        flat = np.full((n + 1, 2 * degree), -1, dtype=np.int32)
        done = min(len(nodes), FIRST_BATCH)
        while True:
            batch = nodes[:done] if flat.max(initial=-1) < 0 else nodes[start:done]
            near = nearest_in(x, batch, batch, CANDIDATES)
            if len(batch) < done:
                entry = nearest_in(x, batch, above, 4) if len(above) else np.repeat(nodes[:1][None, :], len(batch), axis=0)
                found = [beam_search(x, flat, entry[a:a + 512].astype(np.int64), x[batch[a:a + 512]], CANDIDATES) for a in range(0, len(batch), 512)]
                near = np.concatenate((np.concatenate(found).astype(np.int32), near[:, :CANDIDATES // 2]), axis=1)
            picked = diverse(x, batch, near, degree)
            flat[batch, :degree] = picked
            add_back_links(x, flat, batch, picked[:, :degree // 2])
            if done == len(nodes):
                break
            start, done = done, min(len(nodes), done + min(done // 8, LARGEST_BATCH))
        links = [row[row >= 0] for row in flat[:n]]
        if level == 0 and n > 1:         # a ring through all nodes keeps the graph connected
            links = [np.unique(np.append(v, (i + 1) % n)).astype(np.int32) for i, v in enumerate(links)]
        graph.append(links)
        above = nodes
    return graph[::-1]


def beam_search(x: np.ndarray, flat: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` best nodes found for each query (-1: none), best first.
    ``flat``: node x degree neighbour numbers, padded with -1; ``entry``:
    query x nodes to start from. All queries advance in lockstep, expanding
    their two best open nodes a step."""
    q, n = len(queries), len(x)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True                                   # the padding
    seen[rows, entry] = True
    beam = entry.copy()
    value = np.einsum("qd,qkd->qk", queries, x[beam])
    opened = np.zeros(beam.shape, dtype=bool)
    active = np.arange(q)
    while len(active):
        act = active[:, None]
        score = np.where(opened[active], -np.inf, value[active])
        take = np.argsort(-score, axis=1, kind="stable")[:, :2]
        ok = np.take_along_axis(score, take, axis=1) > -np.inf
        alive = ok.any(axis=1)
        active, act, take, ok = active[alive], act[alive], take[alive], ok[alive]
        if not len(active):
            break
        opened[act, take] = True
        near = flat[np.where(ok, beam[act, take], n)].reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        fresh = ~seen[act, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[act, near] = True
        i, j = np.nonzero(fresh)
        found = np.full(near.shape, -np.inf, dtype=x.dtype)
        found[i, j] = np.einsum("pd,pd->p", queries[active[i]], x[near[i, j]])
        nodes = np.concatenate((beam[active], near), axis=1)
        values = np.concatenate((value[active], found), axis=1)
        done = np.concatenate((opened[active], ~fresh), axis=1)
        if nodes.shape[1] > width:
            best = np.argpartition(-values, width - 1, axis=1)[:, :width]
            nodes, values, done = (np.take_along_axis(m, best, axis=1) for m in (nodes, values, done))
        if nodes.shape[1] > beam.shape[1]:
            more = nodes.shape[1] - beam.shape[1]
            beam = np.concatenate((beam, np.full((q, more), n, dtype=beam.dtype)), axis=1)
            value = np.concatenate((value, np.full((q, more), -np.inf, dtype=value.dtype)), axis=1)
            opened = np.concatenate((opened, np.ones((q, more), dtype=bool)), axis=1)
        beam[active], value[active], opened[active] = nodes, values, done
    order = np.argsort(-value, axis=1, kind="stable")
    best = np.take_along_axis(beam, order, axis=1)
    return np.where(np.take_along_axis(value, order, axis=1) > -np.inf, best, -1)


class Shard:
    """A shard's graph for searching, from its index rows."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[list[bytes]]):
        self.x = equal_norms(x).astype(np.float32)
        self.flat = []
        for level in range(int(levels.max()) + 1):
            near = [np.frombuffer(v[level], dtype="<i4") if level < len(v) else np.empty(0, "<i4") for v in links]
            flat = np.full((len(x) + 1, max(1, max(map(len, near)))), -1, dtype=np.int64)
            for i, v in enumerate(near):
                flat[i, :len(v)] = v
            self.flat.append(flat)
        self.levels = levels

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        q = np.column_stack((queries, np.zeros(len(queries)))).astype(np.float32)
        top = len(self.flat) - 1
        nodes = np.flatnonzero(self.levels >= top)
        k = min(8, len(nodes))
        entry = nodes[np.argsort(-(q @ self.x[nodes].T), axis=1, kind="stable")[:, :k]]
        for level in range(top, -1, -1):
            found = beam_search(self.x, self.flat[level], entry, q, width if level == 0 else max(k, 8))
            if level:
                entry = np.where(found[:, :k] >= 0, found[:, :k], entry[:, :found[:, :k].shape[1]])
        return found


INDEX = "shard int, node int, v array<double>, ids array<long>, level int, links array<binary>"


def build_index(embeddings: DataFrame, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index table (INDEX), written to the shared folder."""
    rows = numbered(embeddings, id_col, vector_col)
    good = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    # Equal vectors keep their smallest ids; the rank limit is applied in every
    # map task before the shuffle, so many copies of one vector don't meet.
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = persisted(good.withColumn("least", least).where(F.col("least") <= top + 1)
                      .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "hnsw-nodes")
    lengths = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shard, first = F.lit(0), 0
    for d, n in sorted(lengths.items()):
        shards = max(min(SHARDS_LEAST, -(-n // 256)), -(-n // max(1, min(shard_rows, SHARD_BYTES // (8 * d)))))
        shard = F.when(F.size("v") == d, first + F.pmod(F.xxhash64("v"), F.lit(shards))).otherwise(shard)
        first += shards
    schema = pa.schema([("shard", pa.int32()), ("node", pa.int32()), ("v", pa.list_(pa.float64())),
                        ("ids", pa.list_(pa.int64())), ("level", pa.int32()), ("links", pa.list_(pa.binary()))])

    def run(group: pa.Table) -> pa.Table:
        first_id = np.array([ids[0] for ids in group.column("ids").to_pylist()], dtype=np.int64)
        group = group.take(pa.array(np.argsort(first_id, kind="stable")))
        x = matrix(group.column("v"))
        rng = np.random.default_rng(int(group.column("shard")[0].as_py()))
        levels = np.minimum(6, (-np.log(1 - rng.random(len(x))) / np.log(M)).astype(np.int32))
        graph = build_graph(equal_norms(x).astype(np.float32), levels)
        links = [[graph[k][i].astype("<i4").tobytes() for k in range(levels[i] + 1)] for i in range(len(x))]
        return pa.Table.from_arrays([group.column("shard"), pa.array(np.arange(len(x), dtype=np.int32)), group.column("v"),
                                     group.column("ids"), pa.array(levels, pa.int32()), pa.array(links, pa.list_(pa.binary()))],
                                    schema=schema)

    return persisted(nodes.withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(run, INDEX), "hnsw-index")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, ef: int = EF, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest candidates found for
    each row of ``queries`` (query_id, v: array of double, usable)."""
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    shards = [r for r in index.groupBy("shard").agg(F.first(F.size("v")).alias("d")).collect()]      # one row a shard
    by_length: dict[int, list[int]] = {}
    for r in shards:
        by_length.setdefault(r["d"], []).append(r["shard"])
    targets = F.array().cast("array<int>")
    for d, numbers in sorted(by_length.items()):
        targets = F.when(F.size("v") == d, F.array(*[F.lit(s) for s in sorted(numbers)])).otherwise(targets)
    width = {d: max(EF_LEAST, round(ef / len(numbers) ** 0.5)) for d, numbers in by_length.items()}
    vectors = persisted(queries.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("v"))
                        .select("key", "v", "n"), "hnsw-asked")
    asked = vectors.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "v", F.explode(targets).alias("shard"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("v", pa.list_(pa.float64())), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(ask: pa.Table, graph: pa.Table) -> pa.Table:
        if not len(graph) or not len(ask):
            return schema.empty_table()
        graph = graph.take(pa.array(np.argsort(graph.column("node").to_numpy())))
        x, q = matrix(graph.column("v")), matrix(ask.column("v"))
        ids = graph.column("ids").to_pylist()
        shard = Shard(x, graph.column("level").to_numpy(), graph.column("links").to_pylist())
        asking, found_ids, scores = [], [], []
        for a in range(0, len(q), 512):
            found = shard.search(q[a:a + 512], width[q.shape[1]])[:, :top + 2]
            for i, nodes in enumerate(found, start=a):
                nodes = nodes[nodes >= 0]
                score, taken = x[nodes] @ q[i], 0
                for k in np.argsort(-score, kind="stable").tolist():
                    near = ids[nodes[k]]
                    asking += [i] * len(near)
                    found_ids += near
                    scores += [float(score[k])] * len(near)
                    taken += len(near)
                    if taken > top:
                        break
        return pa.Table.from_arrays([ask.column("v").combine_chunks().take(pa.array(asking, pa.int64())), pa.array(found_ids, pa.int64()),
                                     pa.array(scores, pa.float64())], schema=schema)

    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(
        run, "v array<double>, vec_id long, score double")
    # A vector's list is cut before it goes to the ids that ask for it: one more
    # than asked for, since an id's own row may be among them.
    nearest_of = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    lists = found.groupBy("v", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("place", F.row_number().over(nearest_of)).where(F.col("place") <= top + 1) \
        .groupBy("v").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))           # top + 1 at most
    lists = persisted(lists.join(vectors.select("v", "n"), "v"), "hnsw-lists")
    each = hot_join(queries.select("query_id", "v"), lists, ["v"], "n", n).select("query_id", F.explode("near").alias("x")) \
        .select("query_id", "x.vec_id", "x.score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top) \
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(embeddings: DataFrame, is_query: Column, top: int = TOP, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The nearest rows of every row for which ``is_query`` (over vec_id) holds."""
    index = build_index(embeddings, top, id_col, vector_col)
    rows = numbered(embeddings, id_col, vector_col)
    queries = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull() & is_query) \
        .select(F.col("vec_id").alias("query_id"), "v").distinct()
    return search(index, queries, top)
