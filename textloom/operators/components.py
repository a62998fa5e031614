"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialise, shared_dir, shuffles_removed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest among them and the node.

    ``edges`` has u > v. The large star links neighbours above a node, the small
    star those below it and the node itself.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    met = near.join(least, near.u == least.n)
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Rows with a null end and self links add no link, but a self-linked node is
    returned. The number of rounds grows with the logarithm of the longest
    chain; each round's edges are checkpointed in the shared folder, so a lost
    executor costs no earlier round. An empty table gives an empty table.
    """
    shared_dir(edges.sparkSession)
    # read twice here and again by whoever reads the result: found once
    pairs = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"), "edges")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # the first round's stars fold links that repeat, so they aren't exchanged for that alone
    now = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = None
    for _ in range(max_rounds):
        with shuffles_removed(edges.sparkSession):
            now = _star(_star(now, large=True), large=False).checkpoint()
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("k"), F.col("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.k, "left").select("node", F.coalesce("root", "node").alias("root"))
