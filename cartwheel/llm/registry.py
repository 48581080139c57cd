"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm import (bpe, chat, embedding_dedup, hnsw, html_mincut, langid, merkle, mixing, ngram_jaccard, prefix_trie,
                           sharding, substring_dedup, toxicity)
from cartwheel.llm.common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    rows = mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken",
                        F.try_element_at("positions", F.lit(1)).alias("first_position"))
    return mixing.range_sorted(rows, "first_position").drop("first_position")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_components(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                              "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(rows)).drop("in_order")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file; every worker has the package installed."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.spliced(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.build(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_source_mixing": op2_source_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_chat_format": op5_chat_format,
    "op6_hnsw": op6_hnsw,
    "op7_language_id": op7_language_id,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_sharding": op10_sharding,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_toxicity": op12_toxicity,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The same water filling as a recursion over rounds: each round closes the
#: sources above their cap and shares the rest by weight. The order within a
#: source is by md5 of the id.
_OP2 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS n,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, n, w, NULL::DOUBLE AS target, (SELECT 1.5 * sum(n) FROM s) AS budget FROM s
  UNION ALL
  SELECT round + 1, source, n, w,
         CASE WHEN target IS NOT NULL THEN target
              WHEN w * unit > 2 * n THEN 2 * n END, budget
  FROM (SELECT *, (budget - coalesce(sum(target) OVER (), 0))
                  / nullif(sum(CASE WHEN target IS NULL THEN w END) OVER (), 0) AS unit FROM fill) AS f
  WHERE round < (SELECT count(*) FROM s)),
final AS (
  SELECT source, n, coalesce(target, w * (budget - coalesce(sum(target) OVER (), 0))
         / sum(CASE WHEN target IS NULL THEN w END) OVER ()) AS target
  FROM fill WHERE round = (SELECT max(round) FROM fill)),
placed AS (
  SELECT d.doc_id, d.size, f.n, f.target, round(f.target)::BIGINT AS t,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d JOIN final AS f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, n::BIGINT AS source_size, round(target, 3) AS target,
       (greatest(0, least(size, t - c)) + greatest(0, least(size, t - n::BIGINT - c)))::BIGINT AS taken
FROM placed
"""

_OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS t
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
least AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM least WHERE m < doc_id),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY k) FILTER (gone.k IS NULL) AS t,
         count(gone.k) AS n FROM word LEFT JOIN gone USING (doc_id, k) GROUP BY word.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s AS a JOIN s AS b ON a.t = b.t AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT reach.x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.y) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.x GROUP BY reach.x
"""

_MARKS = "([INST]|[/INST]|[SYS]|[/SYS]|[ANS]|</s>|[TURN]|[/TURN]|[SAYS]|\\\\)"
_MARKS_RE = _MARKS.replace("[", r"\[").replace("]", r"\]")
_OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_MARKS_RE}'))
       + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
         ELSE 7 + length(role) + len(regexp_extract_all(role, '{_MARKS_RE}')) + 8 + 8 END AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(formatted)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

def _field(name: str, value: str | None = None) -> str:
    text = value or f"{name}::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


#: The unsigned CRC-32 of ``{text}``, a string of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split({text}, '')]),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, step: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

_OP11 = f"""
WITH RECURSIVE own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format(text="conv_id::VARCHAR")} % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth,
         strlen(text) AS n_bytes, sha256(strlen(role)::VARCHAR || ':' || role || text) AS turn
  FROM (SELECT c.conv_id, 1 AS part, i, role, text FROM c JOIN own ON own.conv_id = c.base AND i <= h
        UNION ALL SELECT c.conv_id, 2, i, role, text FROM c JOIN own ON own.conv_id = c.conv_id AND i > h)),
path AS (
  SELECT conv_id, 0 AS depth, 0 AS n_bytes, '' AS prefix FROM c
  UNION ALL
  SELECT p.conv_id, r.depth, r.n_bytes, p.prefix || r.turn FROM path AS p JOIN rebuilt AS r
    ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
lens AS (SELECT conv_id, max(depth) AS len FROM path GROUP BY conv_id),
node AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS longest, (count(*) - 1) * max(n_bytes) AS weight,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM path JOIN lens USING (conv_id) GROUP BY prefix, depth),
pair AS (
  SELECT DISTINCT a.prefix AS top, b.prefix AS below FROM path AS a JOIN path AS b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT top, sum(weight) AS saved, count(*) FILTER (longest = depth) AS leaves FROM pair JOIN node ON below = prefix GROUP BY top),
up AS (SELECT n.prefix, p.conv_id, p.prefix AS parent FROM node AS n JOIN node AS p
       ON n.depth = p.depth + 1 AND left(n.prefix, -64) = p.prefix),
kids AS (SELECT parent, count(*) AS n FROM up GROUP BY parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM node AS n JOIN sums ON sums.top = n.prefix LEFT JOIN up ON up.prefix = n.prefix LEFT JOIN kids ON kids.parent = n.prefix
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars"))
_OP13 = f"""
WITH RECURSIVE hit AS (SELECT *, {_CRC32.format(text="doc_id::VARCHAR")} % 5 = 0 AS tampered FROM documents),
d AS (
  SELECT doc_id, source, sha256({_LEAF} || {_field("text", "text")}) AS leaf,
         sha256({_LEAF} || CASE WHEN tampered THEN {_field("text", _LOWER)} ELSE {_field("text", "text")} END) AS found FROM hit),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS t, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
tree AS (
  SELECT t, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT t, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY t, level, pos // 16, n),
top AS (
  SELECT 0::BIGINT AS t, 0 AS level, (t - 1)::BIGINT AS pos, (SELECT count(*) FROM tree WHERE n = 1) AS n, digest FROM tree WHERE n = 1
  UNION ALL
  SELECT 0, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
node AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (FROM tree UNION ALL FROM top) WINDOW w AS (PARTITION BY t, level, pos // 16 ORDER BY pos)),
climb AS (
  SELECT doc_id, leaf, t, 0 AS level, pos::BIGINT AS pos, found AS folded, '' AS path, NULL::VARCHAR AS subroot, NULL::VARCHAR AS root FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, CASE WHEN n.n = 1 THEN 0 ELSE c.t END, CASE WHEN n.n = 1 THEN 0 ELSE c.level + 1 END,
         CASE WHEN n.n = 1 THEN c.t - 1 ELSE c.pos // 16 END,
         CASE WHEN n.n = 1 THEN folded ELSE sha256(l || folded || r) END,
         CASE WHEN n.n = 1 THEN path ELSE path || l || r END,
         CASE WHEN n.n = 1 AND c.t > 0 THEN n.digest ELSE c.subroot END,
         CASE WHEN n.n = 1 AND c.t = 0 THEN n.digest END
  FROM climb AS c JOIN node AS n ON n.t = c.t AND n.level = c.level AND n.pos = c.pos WHERE c.root IS NULL)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM climb WHERE root IS NOT NULL
"""

SQL: dict[str, str] = {
    "op2_source_mixing": _OP2,
    "op3_substring_dedup": _OP3,
    "op4_ngram_jaccard": _OP4,
    "op5_chat_format": _OP5,
    "op11_conversation_trie": _OP11,
    "op13_merkle_manifest": _OP13,
}
