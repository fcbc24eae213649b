"""Connected components of a link table by alternating large and small stars.

Each round replaces links so that every node comes closer to the smallest node of its
component; the number of rounds grows with the logarithm of the longest path. Links never
leave the cluster: a round ends in a checkpoint, and only a count and a checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versionlog.llm.common import cut


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of a link with another node; root is the smallest node.

    ``links`` has two columns of one orderable type; nulls and loops are ignored.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
    links = cut(links.where("a is not null and b is not null and u <> v").select("u", "v").distinct())
    before = _mark(links)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours, and the node, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
