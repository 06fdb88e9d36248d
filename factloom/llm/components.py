"""Connected components by alternating star contractions, on DataFrames.

Each round links every node to the least node around it (large star, then small star), which halves
the depth of what is left; rounds are written to the shared folder, so a lost executor costs one
round at most and the plan never grows.  No neighbourhood is ever collected into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Of ``edges`` (``a``, ``b``: non-null numbers): ``node`` and ``root``, the least node it is connected to.

    Nodes without an edge to another node are not in the result; no edges give an empty result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, the least ones bring no partitioning of their own: adaptive execution may split a hub's edges in the join
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        below = written(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done, now = now, written(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for table in (done, least, large, below):
            remove(table)
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
