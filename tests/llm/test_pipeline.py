"""Registration, the SQL of the expressible queries, and the corpus pipeline."""

import os
import sys

import numpy as np
import pytest
from corpus_fixtures import words_of
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from cartwheel.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(registry.SQL) <= set(registry.QUERIES) and set(registry.SQL) <= set(entry.oracle_sql())
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    from check_oracle import digest, duck
    df = registry.QUERIES[name](spark, SF)
    cursor = duck(SF).execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, cursor.fetchall())


def repeated_ids(spark):
    """40 rows of one id and 40 of none, each text of its own and there twice."""
    import random
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = [(7, text(30 + i), "s0") for i in range(40)] + [(None, text(30 + i), "s1") for i in range(40)]
    single = [(100 + i, text(60), "s2") for i in range(40)]
    across = text(80)
    rows = shared + shared + single + [(None, across, "s0"), (900, across, "s1"), (901, across, "s2")]
    ddl = "doc_id long, text string, source string"
    return spark.createDataFrame(rows, ddl).repartition(3), set(shared + single + [(900, across, "s1")])


def test_memory_is_given_back_at_the_end_of_a_task():
    import re
    from cartwheel.llm.common import released

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) / 1024

    def batches():
        many = [bytes(1000) for _ in range(100_000)]       # below the size that is mapped by itself
        last.append(bytes(1000))                           # keeps the heap's end in use
        many.clear()
        yield held()

    last: list[bytes] = []
    before = held()
    kept, = released(batches())
    assert kept - before > 60 and held() - before < 30


def test_token_stage_encodes_small_batches(spark):
    """It has run when it returns, while the small batches hold, and they don't hold afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), "id").alias("text"))
    tokens = corpus_pipeline.token_stage(spark, docs, SF)
    assert "MapInArrow" not in tokens._jdf.queryExecution().toString() and spark.conf.get(name) == before
    assert tokens.count() == 30 and tokens.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    docs, want = repeated_ids(spark)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert len(kept) == len(want) and set(kept) == want


def test_mix_of_repeated_and_null_ids(spark):
    """Each row has passes of its own, two at most, and the mix reaches its size."""
    from collections import Counter
    from cartwheel.llm import mixing
    docs, _ = repeated_ids(spark)
    given = Counter(tuple(r) for r in docs.collect())
    rows = Counter(tuple(r) for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect())
    assert all(n <= mixing.MAX_EPOCHS * given[r] for r, n in rows.items())
    passes = sum(len(r.positions) for r in mixing.mix(docs).collect())
    assert sum(rows.values()) == passes
    words = lambda c: sum(n * len(words_of(r[1])) for r, n in c.items())
    assert words(rows) == pytest.approx(1.5 * words(given), rel=0.1)


def test_pipeline_against_its_operators(spark):
    """Each stage's effect, recomputed by brute force over what it was given."""
    from test_corpus_operators import linked_brute, removed_brute
    from cartwheel.llm.common import persisted, table
    docs = table(spark, SF, "documents")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, persisted(stage(spark, docs, SF), "test-stage")
        assert docs.columns == before.columns
        rows[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
    given, kept = rows["language_id"]
    assert set(kept) <= set(given) and len(kept) >= 0.99 * len(given)
    given, kept = rows["ngram_jaccard"]
    root, _ = linked_brute(given, 0.75)
    assert sorted(kept) == sorted(r for r in given if root[r[0]] == r[0])
    given, kept = rows["substring_dedup"]
    want = {i: (n, gone) for i, n, gone, _ in removed_brute(given, 50)}
    assert {r[0]: len(words_of(r[1])) for r in kept} == {i: n - gone for i, (n, gone) in want.items() if n == 0 or gone < n}
    given, kept = rows["source_mixing"]
    assert set(kept) <= set(given) and len(kept) > len(given)
    assert sum(len(words_of(r[1])) for r in kept) == pytest.approx(1.5 * sum(len(words_of(r[1])) for r in given), rel=0.1)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == len(kept) and all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in tokens)
    assert corpus_pipeline.run(spark, SF).count() == len(tokens)


def test_new_operators_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(11, 14))


def test_pipeline_of_an_empty_table(spark):
    from cartwheel.session import scratch_path
    folder = scratch_path(spark, "test-empty")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_stage_frees_what_the_one_before_has_written(spark):
    """Folders that the next stage's documents don't read are gone; one that a
    result, not yet written, still reads stays."""
    from cartwheel.llm.common import persisted, table
    from cartwheel.session import local_fs_path
    docs = table(spark, SF, "documents").where("doc_id < 40")
    run_key = (spark.sparkContext.applicationId, "a run of its own")
    lazy = corpus_pipeline.near_duplicate_stage(spark, docs, run_key[1])
    first = list(corpus_pipeline._SCRATCH[run_key])
    assert first and all(os.path.isdir(local_fs_path(p)) for p in first)
    corpus_pipeline.mixing_stage(spark, lazy, run_key[1])
    read = [p for p in first if os.path.isdir(local_fs_path(p))]
    assert 0 < len(read) < len(first) and lazy.count() > 0
    stored = persisted(lazy, "test-stored")
    corpus_pipeline.substring_stage(spark, stored, run_key[1])
    assert not any(os.path.isdir(local_fs_path(p)) for p in first)
