"""Connected components of a link table, in Spark, with no part of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import forget, join_hot, written


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of ``links``; component is the smallest node
    that is reachable. Nodes without links are not listed.

    Each round hangs every neighbour of a node, and the node, under the smallest of them
    (first over all neighbours, then over smaller ones), and ends when no link moves.
    Rounds grow with the logarithm of the longest path. A node's rows are only ever
    reduced to a minimum, which Spark does before the shuffle, and joined against one row
    per node; the neighbours of a hub stay where they are and the hub's row goes to them. None is
    gathered into a list. Links with a null end are ignored; repeated links and loops do no harm.
    """
    pairs = (
        links.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs = written(pairs, "links")
    state = _digest(pairs)
    while state[0]:
        before, old = state, pairs
        pairs = _round(pairs, 2 * before[0])
        state = _digest(pairs)
        forget(old)
        if state == before:
            break
    # every node now hangs under its root; roots stand for themselves
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    )


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _round(pairs: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step on links (a > b)."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    large = join_hot(both.where("b > a"), low, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    small = join_hot(large, low, ["a"], "n", total).select("a", "b", "m")
    small = (
        small.where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(low.select("a", F.col("m").alias("b")))
        .distinct()
    )
    return written(small, "links")
