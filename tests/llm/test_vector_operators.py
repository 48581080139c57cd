"""HNSW search and embedding near-dedup."""

import numpy as np
import pytest

from cartwheel.llm import embedding_dedup, hnsw

AWKWARD = [(9000, None), (9001, [0.0] * 16), (9002, [1.0] * 15 + [float("nan")]), (9003, [1.0] * 15 + [None]), (9004, []),
           (9005, [float("inf")] + [1.0] * 15), (9006, [1.0, 2.0])]


def vectors(seed: int, n: int, d: int = 16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, n // 4):                      # near copies
        x[n // 2 + i] = x[i] + rng.normal(scale=0.05, size=d)
    x[n - n // 8:] = x[0]                           # copies of one vector
    x[1] *= 3
    return x


def frame(spark, x, more=()):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in more]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int").repartition(3)


@pytest.mark.parametrize("n", [3, 300])
def test_dedup_against_brute_force(spark, n):
    x = vectors(3, n)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x, AWKWARD)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    for _ in range(n):
        label = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
    assert len(got) == n + len(AWKWARD)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(n)] == \
        [(int(linked[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(n)]
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in AWKWARD)


def test_dedup_cells_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    x = vectors(4, 600, 32)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(600, dtype=bool)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * linked.sum() <= found <= linked.sum()
    exact = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame(spark, x), margin_share=1.0).collect()}
    assert exact == {i: int(linked[i].sum()) for i in range(600)}


def test_dedup_counts_links_across_deep_borders(spark, monkeypatch):
    """Few strong directions: linked vectors lie along the line between two
    centres, one of them too deep in its cell to visit the other's."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 100)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    n = 1500
    x = np.random.default_rng(8).normal(size=(n, 5)).astype(np.float32)
    x[-60:] = x[:60]                                # copies count as often as they are there
    x[-90:-60] = 3 * x[60:90]                       # other vectors of equal direction
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
    assert {i: got[i].n_links for i in range(n)} == {i: int(linked[i].sum()) for i in range(n)}


def test_centres_are_fitted_without_the_sample_on_the_driver(spark, monkeypatch):
    """The sample (5 MB) is above what may come to the driver, the centres aren't."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 100)
    n, d = 5000, 128
    x = np.random.default_rng(9).normal(size=(n, d))
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, v array<double>, copies long").repartition(4)
    rows = [(n + i, v.tolist(), 1) for i, v in enumerate(x[:40, :3])]       # another length, too few for cells
    classes = embedding_dedup.persisted(classes.unionByName(spark.createDataFrame(rows, classes.schema)), "test-classes")
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        centres = embedding_dedup.fit_centres(classes, n + 40)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert set(centres) == {d} and 45 <= len(centres[d]) <= 51
    assert np.allclose(np.linalg.norm(centres[d], axis=1), 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = (unit @ centres[d].T).max(axis=1).mean()
    assert own > (unit @ unit[:len(centres[d])].T)[len(centres[d]):].max(axis=1).mean()     # nearer than to vectors picked at random


def test_dedup_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_nearest(x, i, top):
    s = x.astype(float) @ x[i].astype(float)
    order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i]
    return order[:top], s


def test_search_finds_the_nearest(spark):
    from pyspark.sql import functions as F
    x = vectors(5, 700)
    got = {}
    for r in hnsw.nearest(frame(spark, x, AWKWARD), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 700, 20)}
    hits = 0
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        want, s = brute_nearest(x, i, 20)
        assert all(v == pytest.approx(s[j], abs=1e-9) and j != i for _, j, v in found)
        assert [(-v, j) for _, j, v in found] == sorted((-v, j) for _, j, v in found)
        hits += len({j for _, j, _ in found} & set(want))
    assert hits >= 0.95 * 20 * len(got)


def test_search_in_small_and_empty_tables(spark):
    from pyspark.sql import functions as F
    x = vectors(6, 9)
    got = hnsw.nearest(frame(spark, x, [(100, [1.0, 1.0]), (120, [2.0, 1.0])]), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(by[0]) == list(range(1, 9)) and by[100] == [120] and by[120] == [100]
    assert hnsw.nearest(frame(spark, x).limit(0), F.lit(True)).count() == 0


def test_graph_reaches_every_node():
    x = vectors(7, 500)
    levels = np.minimum(6, (-np.log(1 - np.random.default_rng(0).random(500)) / np.log(hnsw.M)).astype(np.int32))
    graph = hnsw.build_graph(hnsw.equal_norms(x), levels)
    seen, todo = {0}, [0]
    while todo:
        for j in graph[0][todo.pop()].tolist():
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == 500


def linked_rows(rows, threshold=0.95):
    """(vec_id, links, smallest id reachable) of every row, by comparing all."""
    x = [np.array(v, dtype=float) / np.linalg.norm(v) for _, v in rows]
    near = [[j for j in range(len(x)) if j != i and len(x[j]) == len(x[i]) and x[i] @ x[j] >= threshold] for i in range(len(x))]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return sorted(out)


def test_dedup_of_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (7, [-1.0, 0.0]), (7, [-1.0, 0.05]),
            (9, [0.0, 1.0]), (9, [0.0, 1.0]), (4, [0.0, -1.0])]
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows += [(int(rng.integers(20, 60)), (base[i % 12] + rng.normal(size=8) * 0.08).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == linked_rows(rows)


def test_dedup_of_many_copies_and_many_unusable_rows(spark):
    """A third of the rows copies of one vector, a third without any: the copies are
    broadcast to, the others never joined."""
    rows = [(i, [1.0, 2.0]) for i in range(1000)] + [(i, None) for i in range(1000, 2000)] + [(i, [1.0, -float(i)]) for i in range(2000, 2400)]
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {got[i] for i in range(1000)} == {(999, 0, False), (999, 0, True)} and all(got[i] == (0, i, True) for i in range(1000, 2000))
    assert {got[i] for i in range(2000, 2400)} == {(399, 2000, False), (399, 2000, True)}


def test_search_of_ids_with_several_vectors(spark):
    """Every candidate once per query id, with its best score; copies of a query's
    vector are asked once and answered to each id."""
    from pyspark.sql import functions as F
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (2, [0.6, 0.1]), (3, [0.1, 0.7]), (3, [0.2, 0.2]), (40, [1.0, 0.0]), (60, [1.0, 0.0]), (60, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {
        20: [(1, 40, 1.0), (2, 60, 1.0), (3, 3, 0.7), (4, 2, 0.6)],
        40: [(1, 20, 1.0), (2, 60, 1.0), (3, 2, 0.6), (4, 3, 0.2)],
        60: [(1, 20, 1.0), (2, 40, 1.0), (3, 2, 0.6), (4, 3, 0.2)]}


def test_inserted_nodes_are_found(monkeypatch):
    """A level larger than its first batch: the inserted nodes are found as well as
    the others."""
    monkeypatch.setattr(hnsw, "FIRST_BATCH", 200)
    x = vectors(8, 1500)
    levels = np.minimum(6, (-np.log(1 - np.random.default_rng(0).random(len(x))) / np.log(hnsw.M)).astype(np.int32))
    graph = hnsw.build_graph(hnsw.equal_norms(x), levels)
    links = [[graph[k][i].astype("<i4").tobytes() for k in range(levels[i] + 1)] for i in range(len(x))]
    found = hnsw.Shard(x, levels, links).search(x[::10], 80)[:, :20]
    hits = sum(int((x[f] @ q >= np.sort(x @ q)[-20] - 1e-6).sum()) for f, q in zip(found, x[::10]))     # copies are as good as each other
    assert hits >= 0.95 * 20 * len(found)
    assert max(len(v) for v in graph[0]) <= 4 * hnsw.M + 1
