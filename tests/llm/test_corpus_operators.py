"""Substring dedup, n-gram join, mixing, sharding and the components helper."""

import random
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pytest
from corpus_fixtures import by_id, documents, sha, words_of

from pyspark.sql import functions as F

from cartwheel.llm import mixing, ngram_jaccard, sharding, substring_dedup
from cartwheel.llm.common import persisted
from cartwheel.llm.components import components


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def random_documents(n: int, seed: int) -> list[tuple]:
    """Copies, near copies, shared passages, a hot line and junk."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line, base = text(30), text(6), text(60)
    rows = [(0, None, None, None), (1, "", "en", "s0"), (2, " \t\n", "en", "s0"), (3, "one", "en", "s1"), (4, "One", "en", "s1"),
            (5, "one two three", "en", None), (6, "a b c d e", "en", None), (7, "A B C D E", "en", None)]
    for i in range(8, n):
        kind = rng.random()
        if kind < 0.25:
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.45:
            words = text(rng.randint(1, 40)) + passage + text(rng.randint(0, 40))
        elif kind < 0.6 and i > 20:
            words = words_of(rows[rng.randrange(8, i)][1])
            words = [w.decode() for w in words]
        elif kind < 0.7:
            words = line * rng.randint(1, 12)
        else:
            words = text(rng.choice([3, 6, 12, 30, 120, 400]))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), "en", f"s{rng.randrange(3)}"))
    return rows


# ---- substring dedup ----------------------------------------------------------

def removed_brute(rows, window):
    first = {}
    order = lambda i: float("inf") if i is None else i
    texts = [(i, words_of(t)) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, order(i)), order(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < order(i):
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,seed", [(3, 1), (25, 2), (50, 3)])
def test_substring_dedup_against_brute_force(spark, window, seed):
    rows = random_documents(150, seed)
    rows += [(None, rows[30][1], "en", "a"), (40, rows[40][1], "en", "a"), (9000, " ".join(["long"] * 3000), "en", "a")]
    got = substring_dedup.dedup_digest(documents(spark, rows), window)
    assert sorted(map(tuple, got.collect()), key=str) == removed_brute(rows, window)


def test_substring_dedup_keeps_all_columns(spark):
    rows = [(1, "a b c d", "en", "s"), (2, "x  a b c", "en", "s"), (3, "q  r", "en", None), (4, None, None, None)]
    docs = documents(spark, rows)
    got = substring_dedup.dedup(docs, 3)
    assert got.columns == [*docs.columns, "n_words", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed, r.size, r._bucket) for r in got.collect()} == {
        1: ("a b c d", 0, "x", "x"), 2: ("x", 3, "x", "x"), 3: ("q  r", 0, "x", "x"), 4: (None, 0, "x", "x")}
    assert substring_dedup.dedup(docs.limit(0), 3).count() == 0


def sketched(anchors, blocks, size):
    """(sketches, flagged anchors of each bucket) of buckets with one document each."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    texts = [SimpleNamespace(ids=np.array([b]), counts=np.array([len(a)]), anchors=a) for b, a in enumerate(anchors)]
    sketches = pa.concat_tables([substring_dedup.partition_sketch(t, b, blocks, size) for b, t in enumerate(texts)])
    answers = pa.concat_tables([substring_dedup.merge_sketches(sketches.filter(pa.compute.equal(sketches["block"], k)), size)
                                for k in range(blocks * substring_dedup.SKETCH_ROWS)])
    return sketches, [set(a[substring_dedup.estimated_repeated(a, answers.filter(pa.compute.equal(answers["bucket"], b)), blocks, size)].tolist())
                      for b, a in enumerate(anchors)]


def test_count_min_never_loses_a_repeated_anchor():
    rng = np.random.default_rng(5)
    anchors = [np.unique(rng.integers(0, 3000, 800).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(6)]
    _, flagged = sketched(anchors, 3, 1 << 12)
    values, counts = np.unique(np.concatenate(anchors), return_counts=True)
    repeated = set(values[counts > 1].tolist())
    for b, a in enumerate(anchors):
        assert repeated & set(a.tolist()) <= flagged[b]
    assert sum(map(len, flagged)) < 1.3 * counts[counts > 1].sum()


def test_a_sketch_is_no_larger_than_its_cells():
    """Ten times the anchors make no larger a sketch once its cells are full, and a
    full one still loses none."""
    rng = np.random.default_rng(6)
    sizes = []
    for n in (20_000, 200_000):
        anchors = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2)]
        anchors[1] = np.unique(np.concatenate((anchors[1], anchors[0][:50])))
        sketches, flagged = sketched(anchors, 2, 512)
        sizes.append(sum(len(c) for name in ("cells", "counts") for c in sketches.column(name).to_pylist()))
        assert set(anchors[0][:50].tolist()) <= flagged[0] & flagged[1]
    assert sizes[0] == sizes[1] == 2 * substring_dedup.SKETCH_ROWS * 2 * 512 * 5


# ---- n-gram join --------------------------------------------------------------

def shingle_set(text):
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked_brute(rows, similarity):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k]
             if a and b and len(a & b) >= similarity * len(a | b) and i != j]
    return components_of({i for i, _ in sets}, links), links


@pytest.mark.parametrize("seed,similarity", [(1, Fraction(3, 4)), (2, Fraction(3, 4)), (3, Fraction(9, 10))])
def test_ngram_join_against_brute_force(spark, seed, similarity):
    rows = random_documents(260, seed) + [(None, "a b c d e f", "en", "s"), (9000, "v " * 4000, "en", "s"), (9001, "v " * 3000, "en", "s")]
    got = ngram_jaccard.link_components(documents(spark, rows), similarity).collect()
    want, _ = linked_brute(rows, similarity)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingle_set(t)) for i, t, *_ in rows if i is not None}
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]


def test_every_linked_pair_shares_a_key_under_both_thresholds():
    rng = random.Random(4)
    heat = np.zeros(1 << ngram_jaccard.SKETCH_BITS, dtype=np.uint8)
    heat[::3] = 5
    bounds = ngram_jaccard.Bounds()
    for threshold in (0, 1):
        allocation = ngram_jaccard.Allocation(bounds, {g: 10 for g in range(12)}, 0.001)
        for g in allocation.plan:
            h = bounds.largest(g)
            allocation.plan[g] = (0, 2 * (h + 1) + 6) if threshold == 0 else (1, h // 2 + 1)
        linked = 0
        for _ in range(400):
            n = rng.choice([1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 40, 127, 128, 300])
            x = np.array(sorted(rng.sample(range(1 << 60), n)), dtype=np.uint64)
            y = set(x.tolist())
            for _ in range(rng.randint(0, max(1, n // 3))):
                y ^= {rng.choice(x.tolist())} if rng.random() < 0.5 else {rng.randrange(1 << 60)}
            y = np.array(sorted(y), dtype=np.uint64)
            both = len(np.intersect1d(x, y))
            if not len(y) or 4 * both < 3 * (len(x) + len(y) - both):
                continue
            linked += 1
            assert len(np.intersect1d(allocation.keys(x, heat), allocation.keys(y, heat))), (threshold, n, len(y))
            assert ngram_jaccard.difference_bound(ngram_jaccard.profile(x), ngram_jaccard.profile(y)) <= len(x) + len(y) - 2 * both
        assert linked > 100


def test_near_copies_and_repeated_ids(spark):
    base = [f"t{i}" for i in range(80)]
    rows = [(1000 + i, " ".join(base[:i % 70] + [f"edit{i}"] + base[i % 70 + 1:]), "en", "s") for i in range(120)]
    rows += [(1, " ".join(base), "en", "s"), (5, "totally other words in this one", "en", "s"), (5, " ".join(base[1:]), "en", "s"),
             (6, "totally other words in this one", "en", "s"), (6, "totally other words in this one", "en", "s")]
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.link_components(documents(spark, rows)).collect()}
    assert got == {(1000 + i, 1) for i in range(120)} | {(1, 1), (5, 1), (6, 1)}      # both texts of 5 tie their groups
    assert ngram_jaccard.link_components(documents(spark, rows).limit(0)).count() == 0
    empty = documents(spark, [(1, None, None, None), (2, "", "en", "s")])
    assert {tuple(r) for r in ngram_jaccard.link_components(empty).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_components_against_union_find(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] \
        + [(2000, 2001 + i) for i in range(100)] + [(7, None)]
    got = components(spark.createDataFrame(links, "x long, y long")).collect()
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = components_of({n for p in real for n in p}, real)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_substring_dedup_spreads_rows_of_one_id(spark):
    """Rows of one id, and rows without one, don't meet in one bucket with their
    texts; a passage in them goes where a smaller id has it, as before."""
    from pyspark.sql import functions as F
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"t{n} " * 10 + passage, "en", "s") for n in range(60) for i in (5, None)] + [(1, passage, "en", "s")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = substring_dedup.dedup_digest(documents(spark, rows)).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(rows) and all(r.n_removed == {1: 0, 5: 60, None: 70}[r.doc_id] for r in got)
    for i in (5, None):
        assert len({r["at"] for r in got if r.doc_id == i}) > 1


# ---- mixing -------------------------------------------------------------------

def test_water_fill():
    assert mixing.water_fill([100, 100], [5, 1], 300, 2) == [200.0, 100.0]
    assert mixing.water_fill([100, 0, 50], [1, 1, 1], 1000, 2) == [200.0, 0.0, 100.0]
    assert mixing.water_fill([], [], 0, 2) == []


def test_mixing_reaches_its_targets(spark):
    rows = random_documents(300, 8)
    docs = documents(spark, rows + [(20, rows[20][1], "en", "s0"), (None, "some words here", "en", "s1")])
    mixed = mixing.mix(docs)
    got = mixed.collect()
    sources = {}
    for r in got:
        s = sources.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r["size"]
        s[1] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(r.passes) and len(r.positions) == sum(p > 0 for p in r.passes)
        assert all(0 <= t <= 1 for t in r.positions) and list(r.positions) == sorted(r.positions)
    assert None in sources and all(a == size and abs(b - t) <= 1 for a, b, size, t in sources.values())
    assert sum(v[1] for v in sources.values()) == pytest.approx(1.5 * sum(v[0] for v in sources.values()), abs=5)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    order = mixing.training_order(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.words for r in order) == sum(r.taken for r in got)


def test_curriculum_follows_its_schedule():
    curve = mixing.demand_curve(1000.0, mixing.linear_schedule(2)[0])
    assert curve[-1] == pytest.approx(1000) and curve[32] == pytest.approx(625, abs=1)     # falls from 1.5 to 0.5


def test_mixed_documents_and_awkward_tables(spark):
    docs = documents(spark, [(1, "a b c", "en", "x"), (2, None, "en", "x"), (3, "d", "en", None), (4, "e f " * 20_000, "en", "y")])
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns and rows.where("doc_id = 2").count() == 0
    assert {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}.keys() <= {1, 3, 4}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(documents(spark, [(1, None, None, None)])).collect()} == {0}


# ---- sharding -----------------------------------------------------------------

def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    slots, sizes = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes


def test_shards_are_near_equal(spark):
    rows = [(i, "text %d " % i * (i % 40), "en", "s") for i in range(3000)] + [(5000 + i, "hot copy " * 20, "en", "s") for i in range(1500)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    sizes = check_shards(rows, got, 16)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(abs(s - mean) for s in sizes.values()) < 0.03 * mean
    copies = {}
    for r in got:
        copies.setdefault(r.text_crc32, set()).add(r.shard)
    assert sorted(map(len, copies.values()))[-2] == 1      # only the hot group is cut
    again = sharding.shard_documents(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_awkward_tables(spark):
    import zlib
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "é", "en", "s"), (4, "x" * 100_000, "en", "s"), (4, "x" * 100_000, "en", "s")]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    check_shards(rows, got, 16)
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sharding.shard_documents(documents(spark, rows).limit(0)).count() == 0
    assert by_id(sharding.shard_documents(documents(spark, [(9, "only", "en", "s")])))[9].slot == 0


def test_hot_keys_of_sharding_are_cut(spark):
    """A third of the rows without a text, a third equal in id and text: no piece,
    which is what a window holds, has more than its share."""
    rows = [(i, None, "en", "s") for i in range(2000)] + [(None, "one text", "en", "s")] * 2000 + \
        [(10_000 + i, f"text {i} " * 9, "en", "s") for i in range(2000)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    sizes = check_shards(rows, got, 16)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 16
    records = persisted(sharding.records_of(documents(spark, rows), "doc_id", "text").withColumn("number", F.monotonically_increasing_id()), "t")
    total = records.agg(F.sum("size")).first()[0]
    bounds = sharding.sample_boundaries(records, total, 6000, 24)
    pieces = sharding.subdivided(records.withColumn("range", sharding.range_of(F.col("key"), bounds)), total, 6000, len(bounds) + 1) \
        .groupBy("range", "sub", "step").count().collect()
    assert max(r["count"] for r in pieces) <= 2 * 6000 / 24


def test_mixing_of_rows_without_id_and_many_sources(spark):
    """A third of the rows without id, and more sources than weights: the targets
    are the water filling's, the places a running sum."""
    rows = [(None, "w " * (1 + i % 3), "en", "hot") for i in range(600)] + \
        [(i, "w " * (i % 7), "en", None if i % 40 == 0 else f"s{i % 40}") for i in range(1200)]
    got = mixing.mix(documents(spark, rows)).collect()
    words = {}
    for _, t, _, source in rows:
        words[source] = words.get(source, 0) + len(words_of(t))
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
    want = dict(zip(names, mixing.water_fill([words[s] for s in names], weights, 1.5 * sum(words.values()), 2)))
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == words[r.source] and r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
