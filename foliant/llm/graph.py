"""Connected components by contraction.

Edge cases: no link gives no row; a link from a node to itself gives the node as its own root; links may repeat and stand in either direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst); root is the component's smallest node.

    In each round every node points to its smallest neighbour, or to itself if it is the smallest; the trees of these
    pointers are flattened by jumps and become one node each. Links within a tree go, equal ones become one,
    so what is settled takes no part in later rounds: a star is done after one, a path after about the logarithm of its length. Only
    whether anything is left comes to the driver.
    """
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    labels = materialize(ends.withColumn("root", F.col("node")))
    edges = materialize(links_between(links, ("src", "dst")))
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        tree = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("root")))
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            last, tree = tree, materialize(tree.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            discard(last)
            if not tree.where("moved").limit(1).count():
                break
        a, b = (tree.select(F.col("node").alias(end), F.col("root").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
        last, edges = edges, materialize(links_between(edges.join(a, "src").join(b, "dst"), ("a", "b")))
        known, labels = labels, materialize(labels.join(tree.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        discard(last, known, tree)
    discard(edges)
    return labels


def links_between(links: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Different links (src < dst) between the two columns, without those of a node to itself."""
    a, b = ends
    return links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
