"""Connected components of a link table by alternating large and small stars.

Every round is two groupings with a map-side minimum and two joins, so a node that a third of all
links meet is combined before the shuffle and split by AQE in the join.  Rounds are written to the
shared folder, and only two numbers per round reach the driver.  No round has more links than the
one before, so that count bounds the files of the next: on a local file system Hadoop starts a
``chmod`` for every file, and such a child is counted with its executor's whole memory until it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import store

#: Links per file of a round.
LINKS = 100_000


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of node ids; returns (node, component), smallest id of each node
    that has a link to another one.  Nulls and loops are ignored."""
    a, b = links.columns
    edges = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = store(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = store(small.coalesce(-(-mark[0] // LINKS)), "links")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
