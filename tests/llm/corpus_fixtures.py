"""Small tables with the awkward cases every operator has to take."""

import hashlib

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names the operators use inside.
CLASHING = ("size", "key", "bucket", "_bucket", "n", "rep", "component", "position", "rank", "v", "words", "shard", "tokens")


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """doc_id, text, lang, source and the clashing columns; 3 partitions."""
    full = [(i, t, lang, source, *["x"] * len(CLASHING)) for i, t, lang, source in rows]
    ddl = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(full, ddl).repartition(3)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
