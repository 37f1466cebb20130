"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import merged, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.join(merged(least), "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(merged(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node with a link that is not the least of its component, and
    that least node.  ``edges`` has two columns a and b of one ordered type,
    a <> b.  The number of rounds follows the logarithm of the number of links;
    every round is written, so that no round is computed twice, and only a count
    and a checksum come to the driver."""
    state, seen = written(edges.select("a", "b"), "links"), None
    while True:
        state = written(_small_star(_large_star(state)), "links")
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            return state
        seen = mark
