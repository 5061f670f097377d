"""Connected components by contraction, with work that shrinks from round to round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def connected(edges: DataFrame) -> DataFrame:
    """Nodes of the graph with a root that all nodes of a component share.

    Takes edges (a, b) of one type; self-loops, repeated, reversed and NULL-ended edges are ignored. Returns (node, root), one
    row for each node that has an edge to another node; no rows for no edges. In each round a node points to the neighbour
    with the lowest hash, itself included, and the graph of the nodes pointed to is next. Hashes keep long chains, in whatever
    order their ids come, from taking a round per node. Nothing is collected; every round is written to the shared folder.
    """
    left = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, maps = written(left.distinct(), "edges"), []
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = [F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n")) for c in ("a", "b")]
        heads = written(both.groupBy("a").agg(F.min(rank[1]).alias("m"))
                        .select(F.col("a").alias("node"), F.least(rank[0], F.col("m"))["n"].alias("root")), "heads")
        maps.append(heads)
        pairs = left.join(heads.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(heads.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
        left = written(pairs.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps.pop()
    while maps:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = written(maps.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
    return found
