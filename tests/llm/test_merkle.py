"""Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest
from corpus_fixtures import CLASHING
from pyspark.sql import functions as F

from cartwheel.functions.keys import ranked
from cartwheel.llm import merkle


def _hex(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row, text):
    return _hex("".join(_field(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def _levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([_hex("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        i //= 16
    return out


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r, _leaf(r, r["text"])))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[s] = _levels([leaf for _, leaf in by_source[s]])
    top = _levels([trees[s][-1][0] for s in names])
    root, out = (top[-1] or [None])[0], []
    for k, s in enumerate(names):
        for i, (r, leaf) in enumerate(by_source[s]):
            text, folded = r["text"], leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                folded = _leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            siblings = _path(trees[s], i) + _path(top, k)
            for a, b in siblings:
                folded = _hex(a + folded + b)
            out.append((r["doc_id"], leaf, trees[s][-1][0], root, _hex("".join(a + b for a, b in siblings)), folded, folded == root))
    return sorted(out, key=str)


def table(spark, rows):
    ddl = "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], ddl).repartition(3)


def check(spark, rows, **options):
    docs = table(spark, rows)
    got = merkle.verify(merkle.build(docs, **options))
    want = brute([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])
    assert sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()),
                  key=str) == want
    return want


def test_trees_of_all_heights(spark):
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(4353)]                    # 4353 -> 273 -> 18 -> 2 -> 1
    rows += [(i, None, None, None, None if i % 2 else "") for i in range(10_000, 10_017)]
    rows += [(i, "", "de", i, "ÄÖ Z" * 5) for i in range(20_000, 20_016)]
    rows += [(30_000, "lone", None, 1, "Only One"), (-5, "é", "fr", 2, "A"), (None, "é", None, None, "B")]
    rows += [(i, f"s{i % 20}", "en", 1, "X y") for i in range(40_000, 40_100)]
    want = check(spark, rows)
    assert 0 < sum(not w[-1] for w in want) < len(want) / 3


def test_ties_repeats_null_ids_and_long_texts(spark):
    rows = [(7, "a", "en", 1, "Same")] * 20 + [(7, "a", "en", 1, f"Other {i}") for i in range(20)]
    rows += [(None, "a", None, None, f"N{i % 3}") for i in range(40)] + [(8, "a", "en", 9, "Long WORD " * 40_000)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "One")], [(None, None, None, None, None)],
                                  [(i, "a", "en", 1, "T") for i in range(17)], [(i, f"s{i}", "en", 1, "T") for i in range(17)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_nodes_are_linked_and_no_join_key_is_hot(spark):
    docs = table(spark, [(i, "hot", "en", 1, f"{i}") for i in range(16 * 16 * 40)])
    m = merkle.build(docs)
    nodes = {(r["node"], r["block"]): r for r in m.nodes.collect()}
    for r in nodes.values():
        if r["parent"] is not None:
            assert nodes[(r["parent"], r["block"])]["children"][r["slot"]] == r["digest"]
    assert m.runs.groupBy("parent", "block").count().agg(F.max("count")).first()[0] <= merkle.SHARE


def test_row_limit_of_the_session_is_kept(spark):
    spark.conf.set(merkle._ROWS_LIMIT, "1234")
    try:
        merkle.verify(merkle.build(table(spark, [(i, "a", "en", 1, "T") for i in range(2000)]))).count()
        assert spark.conf.get(merkle._ROWS_LIMIT) == "1234"
    finally:
        spark.conf.unset(merkle._ROWS_LIMIT)


def test_rank_of_a_hot_group_spans_partitions(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, id, null) AS g", "cast(null AS long) AS k", "id")
    path = merkle.persisted(df, "test-rank")
    out = ranked(path, ["g"], ["k"], "test-ranked")
    hot = out.where("g IS NULL")
    assert hot.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.max("total")).first()[:] == (0, 19_999, 20_000, 20_000)
    assert out.where("g IS NOT NULL").agg(F.max("rank"), F.max("total")).first()[:] == (0, 1)


def test_tables_between_steps_have_few_files(spark):
    """One file per core, whatever the number of shuffle partitions."""
    from cartwheel.session import delete_scratch, scratch_noted
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                    F.lit("en").alias("lang"), F.lit(4).alias("n_chars"), F.lit("Text").alias("text")).coalesce(2)
    before, folders = spark.conf.get("spark.sql.shuffle.partitions"), []
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with scratch_noted(folders):
            rows = merkle.verify(merkle.build(docs))
        cores = spark.sparkContext.defaultParallelism
        assert len(folders) > 9 and all(len(spark.read.parquet(f).inputFiles()) <= cores + 1 for f in folders)
        assert sorted(map(tuple, rows.collect()), key=str) == brute(docs.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        delete_scratch(spark, folders)
