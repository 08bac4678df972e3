"""Connected components of a graph given as a table of links, by alternating stars.

Each round replaces the links of every vertex by links to its smallest neighbour, first from its
larger neighbours, then from its smaller ones; after a few rounds every component is a star
around its smallest vertex. Links never leave the executors; each round is a table in the shared
folder, so lineage stays short and lost executors cost one round at most. The smallest neighbours
are such a table as well: joined with tables, the links of a vertex with very many of them are
split over several tasks by Spark's adaptive skew join, which it doesn't do beside an aggregate.

Edge cases: links of a vertex with itself, repeated ones and those in either direction count once;
links with a null end are left out; vertices without links don't appear; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(links: DataFrame, large: bool, t: Scratch) -> DataFrame:
    """links (u, v) with v < u, each once -> the same for the next half round."""
    if large:  # every vertex tells its larger neighbours its smallest one
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = t.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # every vertex tells its smaller neighbours, and keeps itself, the smallest one
        least = t.put(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    found = t.put(out.where("u > v").distinct(), "links")
    t.drop(least, links)
    return found


def _final(links: DataFrame) -> bool:
    """Whether all are stars already: each vertex has one smaller neighbour, which has none itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(links.select("v").distinct().select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every vertex of ``links`` (u long, v long); component: its smallest vertex."""
    t = Scratch(links.sparkSession)
    now = t.put(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _final(now):
        now = _star(_star(now, True, t), False, t)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
