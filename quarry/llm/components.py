"""Connected components by alternating large-star and small-star steps (a distributed label contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._spark import materialize

#: Parts that the rows of one key are dealt to in a join, so that a hub or a large component is no task of its own.
SALTS = 16
#: Rows of two numbers that are broadcast at most, about 4 MB; a longer list is merged.
FEW = 1 << 16


def salted_join(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``one``, which has a row a key, on the key and a hash of ``by``; each row of ``one`` goes to every part.

    By merging: Spark sees the size of ``one`` before it is multiplied, and would send ``SALTS`` times that through the driver.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("merge"), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b: long) is connected to.

    Each step lets every node point its larger (then its smaller) neighbours to its least neighbour, and stops
    when no edge changes. The edges only ever shrink to a forest of stars; nothing is collected. An edge may come twice or
    from a node to itself; without edges there are no rows. The least neighbours of at most ``FEW`` nodes are broadcast.
    """

    def told(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
        return rows.join(F.broadcast(least), "a") if few else salted_join(rows, least, "a", "b")

    def seen(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
    mark = seen(e)
    while True:
        few = 2 * mark[0] <= FEW  # an edge has two nodes, and no step makes more edges
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = told(both, least, few).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, scratch)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = told(large, least, few)
        e = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), scratch)
        now = seen(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
