"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import materialize


def components(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys…, node, root)`` for every node of ``(keys…, a, b)``: the least node that links lead to.

    ``keys`` tell graphs apart that are worked on together. Rounds of two star
    steps: a node hangs all its larger neighbours, then all smaller ones, on its
    least neighbour. Trees become stars in a logarithmic number of rounds. Every
    step is a join on stored links with one row per node on the other side, so a
    node with many links may be split.
    """
    keys = keys or []
    now = materialize(links.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialize(both.where("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        joined = large.join(least, [*keys, "a"])
        hung = joined.where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(hung.unionByName(joined.select(*keys, "a", F.col("m").alias("b"))).distinct(), "small")
        # Done when every node hangs on one root and no root hangs on anything.
        roots = now.select(*keys, F.col("b").alias("a")).distinct()
        split = now.groupBy(*keys, "a").agg(F.count("*").alias("n")).where("n > 1")
        loose = split.select("a").unionByName(now.join(roots, [*keys, "a"], "left_semi").select("a"))
        if loose.isEmpty():
            break
    return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())
