"""Merkle manifest of a document table, verified by a recursive query.

Building: a document's leaf is a digest of its fields. Leaves of a source, by
doc_id, are hashed in runs of ``FANOUT`` consecutive ones, level by level, to the
source's subroot; the subroots, by source, likewise to the root. Positions come
from ``ranked`` (range partitions, no window over a source), and a level is one
grouping by (source, position / FANOUT), so a hot source is spread over its runs.
Every level is written as node rows with the id of their parent, their slot in
the parent's run and their children's digests.

Verifying: ``climb`` is one recursive query of Spark. It starts at every run of
leaves with the digest that each of its leaves, perhaps tampered with, folds to;
a step joins the parent's node row, appends the siblings to the path and folds
every leaf's digest with them, until there is no parent. The leaves of a run have
all siblings above the run in common, so the path is kept once per run, not once
per leaf.

Scale: near the root all runs meet in few nodes. So every node row is stored once
per ``SHARE`` runs below it and the join is on (node, block of runs): no join key
has more than ``SHARE`` rows, and the copies add one row per SHARE runs and level.
The climb's row limit is lifted for the climb alone, which runs at once and is
written to the shared folder. To the driver come the largest number of runs of a
source and the number of sources.

Defined cases: a null field is ``-`` in the leaf; a null source is a source of its
own, first in order; null doc_ids come first in their source and aren't tampered
with; rows of one doc_id are leaves of their own, ordered by leaf digest; a source
with one leaf has that leaf as subroot, with one source the subroot is the root;
an empty table gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.keys import ranked
from cartwheel.llm.common import persisted

FANOUT = 16
SHARE = 64                   # runs of leaves that one copy of a node row serves
FILE_ROWS = 1 << 14          # runs or nodes in one file of a table between steps, where there are many
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "node string, parent string, slot int, digest string, children array<string>, is_subroot boolean, block long"
_ROWS_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """``runs``: one row per run of leaves (its leaves, tampered leaves, ids, node
    link and block); ``nodes``: the inner nodes above them, linked to their
    parents, one row per block of runs below."""
    runs: DataFrame
    nodes: DataFrame


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*[field(fields[f]) for f in FIELDS])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def every_fifth(doc_id: Column) -> Column:
    """The rows whose copy is tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, tampered=every_fifth, tamper=lower_ascii) -> DataFrame:
    """doc_id, source, leaf and ``found``: the leaf of the row as it is found
    later, its text changed by ``tamper`` where ``tampered(doc_id)`` holds."""
    own = {f: F.col(f) for f in FIELDS}
    found = leaf_of(own | {"text": tamper(F.col("text"))})
    rows = docs.select("doc_id", "source", leaf_of(own).alias("leaf"), F.when(tampered(F.col("doc_id")), found).alias("found"))
    return rows.withColumn("found", F.coalesce("found", "leaf"))


def _joined(digests: Column, skip: Column) -> tuple[Column, Column]:
    """The digests before and after position ``skip`` (from 0), as hex text."""
    return F.array_join(F.slice(digests, F.lit(1), skip), ""), F.array_join(F.slice(digests, skip + 2, F.lit(FANOUT)), "")


def _folded(digests: Column, slot: Column, own: Column) -> Column:
    left, right = _joined(digests, slot)
    return digest(left, own, right)


def _leaf_runs(rows: DataFrame, files: int) -> DataFrame:
    """One row per run of the leaves ``rows`` (a written table): source, run (number in its source), n_runs, ids, children
    (leaves), folded (what each found leaf folds to), digest."""
    placed = ranked(rows, ["source"], ["doc_id", "leaf"], "merkle-order", files=files)
    item = F.struct((F.col("rank") % FANOUT).cast("int").alias("at"), "doc_id", "leaf", "found")
    runs = placed.groupBy("source", F.floor(F.col("rank") / FANOUT).cast("long").alias("run")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(item)).alias("items"))       # FANOUT items at most
    children, lone = F.col("children"), F.col("total") == 1
    return runs.withColumn("children", F.col("items.leaf")).select(
        "source", "run", F.ceil(F.col("total") / FANOUT).cast("long").alias("n_runs"), F.col("items.doc_id").alias("ids"), "children",
        F.when(lone, F.col("items.found")).otherwise(
            F.transform("items", lambda x: _folded(children, x["at"], x["found"]))).alias("folded"),
        F.when(lone, children[0]).otherwise(F.sha2(F.array_join(children, ""), 256)).alias("digest"))


def _node(*parts) -> Column:
    return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _grouped(level: DataFrame, keys: list, at: Column) -> DataFrame:
    """The next level: runs of FANOUT neighbours become one node."""
    child = F.struct((at % FANOUT).alias("at"), "digest")
    up = level.groupBy(*keys, F.floor(at / FANOUT).cast("long").alias("pos")).agg(
        F.array_sort(F.collect_list(child)).alias("items"), F.min("g0").alias("g0"), F.max("g1").alias("g1"))
    return up.withColumn("children", F.col("items.digest")).drop("items") \
        .withColumn("digest", F.sha2(F.array_join("children", ""), 256))


def _files(df: DataFrame, runs: int) -> int:
    """Files (tasks) for a table of so many runs or nodes: one per core, more where there
    are many rows, but not one per shuffle partition, for these tables get small and every
    file costs an executor the same."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-runs // FILE_ROWS))


def _kept(df: DataFrame, rows: int, purpose: str) -> DataFrame:
    """``df``, of about ``rows`` runs or nodes, written and read back."""
    return persisted(df.coalesce(_files(df, rows)), purpose)


def build(docs: DataFrame, **options) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text)."""
    each = persisted(leaves(docs, **options), "merkle-leaves")
    about = each.count() // FANOUT
    runs = _kept(_leaf_runs(each, _files(each, about)), about, "merkle-leaf-runs")
    n_runs = runs.count()
    runs = ranked(runs, [], ["source", "run"], "merkle-runs", rank="g", total="all_runs", files=_files(each, n_runs)).drop("all_runs")
    # a source's number is that of its first run
    runs = _kept(runs.withColumn("src", F.col("g") - F.col("run")).drop("source"), n_runs, "merkle-numbered")

    # every level's rows: src, pos, n (nodes of the source on it), children, digest, and the runs g0..g1 below
    level = runs.select("src", F.col("run").alias("pos"), F.col("n_runs").alias("n"), "digest", F.col("g").alias("g0"), F.col("g").alias("g1"))
    left, height, inner, tops = runs.agg(F.max("n_runs")).first()[0] or 0, 1, [], []
    while True:
        tops.append(level.where("n = 1").select("src", F.lit(height).alias("height"), "digest", "g0", "g1"))
        if left <= 1:
            break
        level = _kept(_grouped(level.where("n > 1"), ["src", "n"], F.col("pos")).withColumn(
            "n", F.ceil(F.col("n") / FANOUT).cast("long")), n_runs // FANOUT ** height, "merkle-level")
        left, height = -(-left // FANOUT), height + 1
        inner.append(level.withColumn("height", F.lit(height)))

    # the tree over the subroots
    subroots = _kept(reduce(DataFrame.unionByName, tops), n_runs, "merkle-subroots")
    subroots = ranked(subroots, [], ["src"], "merkle-sources", rank="pos", total="sources", files=_files(each, n_runs))
    subroots = _kept(subroots.withColumn("slot", (F.col("pos") % FANOUT).cast("int")).withColumn(
        "parent", F.when(F.col("sources") > 1, _node("top1", F.floor(F.col("pos") / FANOUT).cast("long")))), n_runs, "merkle-tops")
    left, upper, number = subroots.count(), [], 0
    level = subroots.select("pos", "digest", "g0", "g1")
    while left > 1:
        number, left = number + 1, -(-left // FANOUT)
        level = _kept(_grouped(level, [], F.col("pos")), left, "merkle-top-level")
        upper.append(level.select(
            _node(f"top{number}", F.col("pos")).alias("node"),
            (_node(f"top{number + 1}", F.floor(F.col("pos") / FANOUT).cast("long")) if left > 1 else F.lit(None).cast("string")).alias("parent"),
            (F.col("pos") % FANOUT).cast("int").alias("slot"), "digest", "children", F.lit(False).alias("is_subroot"), "g0", "g1"))

    # node rows with their links; subroots take theirs from the upper tree
    links = subroots.select("src", "height", "parent", F.col("slot").alias("top_slot"))
    nodes = list(upper)
    for h, rows in enumerate(inner, start=2):
        below = rows.where("n > 1").select(
            _node(str(h), F.col("src"), F.col("pos")).alias("node"),
            _node(str(h + 1), F.col("src"), F.floor(F.col("pos") / FANOUT).cast("long")).alias("parent"),
            (F.col("pos") % FANOUT).cast("int").alias("slot"), "digest", "children", F.lit(False).alias("is_subroot"), "g0", "g1")
        last = rows.where("n = 1").join(links.where(F.col("height") == h).drop("height"), "src").select(
            _node(str(h), F.col("src"), F.col("pos")).alias("node"), "parent", F.col("top_slot").alias("slot"), "digest", "children",
            F.lit(True).alias("is_subroot"), "g0", "g1")
        nodes += [below, last]
    spark = docs.sparkSession
    if nodes:
        copies = F.sequence(F.floor(F.col("g0") / SHARE).cast("long"), F.floor(F.col("g1") / SHARE).cast("long"))
        stored = reduce(DataFrame.unionByName, nodes).withColumn("block", F.explode(copies)).drop("g0", "g1")
        stored = _kept(stored, n_runs, "merkle-nodes")
    else:
        stored = spark.createDataFrame([], NODES)

    base = runs.withColumn("block", F.floor(F.col("g") / SHARE).cast("long")).select(
        "g", "block", "src", "run", "n_runs", "ids", "children", "folded", "digest")
    several = base.where("n_runs > 1").withColumn("parent", _node("2", F.col("src"), F.floor(F.col("run") / FANOUT).cast("long"))) \
        .withColumn("slot", (F.col("run") % FANOUT).cast("int")).withColumn("subroot", F.lit(None).cast("string"))
    single = base.where("n_runs = 1").join(links.where("height = 1").drop("height"), "src") \
        .withColumnRenamed("top_slot", "slot").withColumn("subroot", F.col("digest"))
    return Manifest(_kept(several.unionByName(single).drop("src", "run", "n_runs"), n_runs, "merkle-anchor"), stored)


_CLIMB = f"""
WITH RECURSIVE climb(g, block, parent, slot, folded, path, subroot, root) AS (
  SELECT g, block, parent, slot, folded, CAST('' AS STRING), subroot, digest FROM {{runs}}
  UNION ALL
  SELECT c.g, c.block, p.parent, p.slot,
         transform(c.folded, f -> sha2(concat(array_join(slice(p.children, 1, c.slot), ''), f,
                                              array_join(slice(p.children, c.slot + 2, {FANOUT}), '')), 256)),
         concat(c.path, array_join(slice(p.children, 1, c.slot), ''),
                array_join(slice(p.children, c.slot + 2, {FANOUT}), '')),
         CASE WHEN p.is_subroot THEN p.digest ELSE c.subroot END, p.digest
  FROM climb AS c JOIN {{nodes}} AS p ON p.node = c.parent AND p.block = c.block)
SELECT g, folded, path, subroot, root FROM climb WHERE parent IS NULL
"""


def climb(manifest: Manifest) -> DataFrame:
    """One row per run of leaves: g, folded (what each of its leaves folds to at
    the root), path (digests of the siblings above the run, bottom up), subroot,
    root. Runs at once."""
    spark = manifest.runs.sparkSession
    before = spark.conf.get(_ROWS_LIMIT, None)
    spark.conf.set(_ROWS_LIMIT, "-1")                      # a row per run and level is due
    try:
        rows = spark.sql(_CLIMB, runs=manifest.runs.select("g", "block", "parent", "slot", "folded", "subroot", "digest"),
                         nodes=manifest.nodes)
        return _kept(rows, manifest.runs.count(), "merkle-climb")
    finally:
        if before is None:
            spark.conf.unset(_ROWS_LIMIT)
        else:
            spark.conf.set(_ROWS_LIMIT, before)


def verify(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings from the
    leaf's run up to the root), folded_root, verified: a row per document."""
    rows = manifest.runs.select("g", "ids", F.col("children").alias("leaves")).join(climb(manifest), "g")
    each = rows.select(F.posexplode(F.arrays_zip("ids", "folded")).alias("at", "x"), "leaves", "path", "subroot", "root")
    left, right = _joined(F.col("leaves"), F.col("at"))
    return each.coalesce(_files(each, manifest.runs.count())).select(
        F.col("x.ids").alias("doc_id"), F.element_at("leaves", F.col("at") + 1).alias("leaf"), "subroot", "root",
        digest(left, right, F.col("path")).alias("proof_sha256"), F.col("x.folded").alias("folded_root"),
        (F.col("x.folded") == F.col("root")).alias("verified"))
