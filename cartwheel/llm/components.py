"""Connected components of a link table, as DataFrame jobs.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step joins the links to each
node's smallest neighbour, an aggregate with a map-side combine, so a node with
very many links is combined before the shuffle. Each step's links are written to
the shared folder; the loop ends when a step changes nothing (O(log^2 n) steps,
a handful in practice). Only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import persisted


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Large star: a node's larger neighbours go to its
    smallest neighbour (or itself). Small star: its smaller ones and itself do."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a
    link to another one. ``links``: two columns of longs, any order, repeats
    allowed; links with null ends are dropped."""
    a, b = (F.col(c) for c in links.columns[:2])
    links = persisted(links.where(a.isNotNull() & b.isNotNull() & (a != b))
                      .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "components")
    before = _state(links)
    for _ in range(max_steps):
        links = persisted(_star(_star(links, large=True), large=False), "components")
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
