"""Connected components of a graph given as edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.llm.work import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge.

    ``edges`` has long columns a and b. Large-star and small-star steps alternate until nothing
    changes: each connects neighbours to the smallest node seen, so paths shrink by half or so in
    a round. Minima are combined before they are shuffled, and the join with them is one that
    the engine splits when a node has very many edges. Rounds end in written tables.
    """
    now = written(_directed(edges.select("a", "b")), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where(F.col("b") > F.col("a"))
        now = written(_directed(large.select(F.col("b").alias("a"), F.col("least").alias("b"))), "edges")
        small = _to_least(now)
        now = written(
            _directed(
                small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
                    small.select("a", F.col("least").alias("b"))
                )
            ),
            "edges",
        )
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.max("a"), F.min("b")).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _to_least(edges: DataFrame) -> DataFrame:
    """Edges with ``least``: the smallest of a and all its b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return edges.join(least, "a")
