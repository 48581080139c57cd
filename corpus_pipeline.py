"""From raw documents to token ids: five stages, each one of the training-data
operators. Every stage works on all documents its predecessor kept; all but the
last return the columns of ``documents``.

1. language ID: a model learned from the labelled documents given; documents
   without letters, or in which no language has ``MIN_LANGUAGE_SHARE`` of the
   letters, go.
2. n-gram Jaccard join: of each group of near duplicates the row of the smallest
   id stays (null ids come last). Rows are compared one by one, whatever their
   ids: of equal rows of one id, or of no id, one stays, and rows of one id with
   different texts all stay.
3. substring dedup: words under repeated 50-word windows go; a document that
   loses all its words goes.
4. source mixing: documents in training order, once per pass of the mix.
5. BPE: token ids (little-endian unsigned 32-bit) and the digest of the decoding.

What a stage writes for itself below the shared checkpoint folder is deleted when
the next stage of the same run starts, unless that stage's documents still read it
(a stage's result is lazy; it is written and reread in between).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm import bpe, langid, mixing, ngram_jaccard, substring_dedup
from cartwheel.llm.common import persisted, small_batches, table, with_row_key
from cartwheel.llm.registry import vocabulary_path
from cartwheel.session import delete_scratch, scratch_noted

MIN_LANGUAGE_SHARE = 0.4
ROW = "_row_key"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: (application, sf_dir) -> folders that the run's last stage has written.
_SCRATCH: dict[tuple[str, str], list[str]] = {}


def frees_scratch(stage: Stage) -> Stage:
    """``stage``, after the folders of the stage before it are deleted."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run_key = (spark.sparkContext.applicationId, sf_dir)
        folders = _SCRATCH.pop(run_key, [])
        read = docs.inputFiles() if folders else []
        kept = [p for p in folders if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)]
        delete_scratch(spark, set(folders) - set(kept))
        with scratch_noted(kept):
            result = stage(spark, docs, sf_dir)
        _SCRATCH[run_key] = kept
        return result

    return run_stage


@frees_scratch
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    return langid.keep_identified(docs, model, MIN_LANGUAGE_SHARE)


@frees_scratch
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_row_key(docs, ROW, "pipeline-rows")
    groups = ngram_jaccard.link_components(rows, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))
    stays = rows.select(ROW, "doc_id").join(groups, ROW).groupBy("component_id").agg(first.getField(ROW).alias(ROW))
    return rows.join(stays, ROW, "left_semi").select(*docs.columns)


@frees_scratch
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(docs).where("n_removed = 0 or n_removed < n_words")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@frees_scratch
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(*docs.columns)


@frees_scratch
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):       # run here, for it holds while a job runs
        return persisted(bpe.encode_documents(docs, vocabulary_path(), ("n_tokens", "ids", "decoded_sha256")), "pipeline-bpe")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("bpe", token_stage),
]

#: Learned models, hashes and a tokenizer's merges aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result but the last is written
    below the shared checkpoint folder and read again, and deleted once the next
    one is written."""
    docs, earlier = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        result, folders = stage(spark, docs, sf_dir), []
        with scratch_noted(folders):
            docs = persisted(result, f"pipeline-{name}")
        delete_scratch(spark, earlier)
        earlier = folders
    return STAGES[-1][1](spark, docs, sf_dir)
