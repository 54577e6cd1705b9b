"""Connected components of a table of links, by alternating stars.

Each round replaces the links of a node by links to the smallest node it knows: first from its larger neighbours
(large star), then from its smaller ones (small star). The links end as one star a component. Every round is two
aggregations and joins on the links, written to the shared folder; nothing is collected, and a node with many
links is only ever aggregated to a minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import in_parts, written
from strandlake.session import forget


def _stars(links: DataFrame) -> DataFrame:
    """One round. links: (a, b) with a > b, distinct."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # large star: larger neighbours go to the least of the node and its neighbours
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    own = least.where("m < a").select("a", F.col("m").alias("b"))
    large = large.unionByName(own).distinct()
    # small star: smaller neighbours, and the node, go to the least of them
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of links (a, b), with the smallest node it is connected to. links: a written table."""
    size = links.count()
    links = written(in_parts(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), size))
    size = links.count()
    same = False
    while not same:
        after = written(in_parts(_stars(links), size))
        before, size = size, after.count()
        same = before == size and not after.join(links, ["a", "b"], "left_anti").head(1)
        forget(links)
        links = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
