"""Topics as dense regions of embeddings; their number comes out of the data.

Neighbours come from random projections: rows are sorted by the sign pattern of
their vectors on random directions, cut into blocks of bounded size, and compared
within each block, once for each of several sets of directions. A crowd of equal
vectors fills several blocks instead of one large bucket.

The core distance of a row is that to its k-th neighbour, and two neighbours
are as far apart as the largest of both core distances and their own distance
(mutual reachability). The graph is cut at several levels of that distance;
components of a level with at least ``min_size`` rows are clusters, nested from
level to level. Of each branch either the cluster itself or its best parts are
kept, whichever has the larger excess of mass: rows times the range of densities
(inverse distances) over which the cluster holds together. Rows in no kept
cluster are outliers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.graph import components
from postlens.operators.ranking import rank_within, top_k
from postlens.session import materialize

OUTLIER = -1
#: Rows compared with each other at a time, sets of directions, directions in a set.
BLOCK, TABLES, DIRECTIONS = 1024, 4, 24
#: Levels: the share of rows dense enough to take part, from coarse to fine.
SHARES = (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.45, 0.3, 0.15)
#: The smallest distance of a level, so that crowds of equal vectors have a finite density.
CLOSEST = 1e-6


def _vectors(df: DataFrame, embedding: str, scale: int | None) -> Column:
    values = F.col(embedding).cast("array<double>")
    return values if scale is None else F.transform(values, lambda x: F.floor(F.lit(scale) * x).cast("double"))


def projections(vectors: Column, table: int, seed: int, directions: int = DIRECTIONS) -> Column:
    """Sign pattern of a vector on the random directions of one table, as a number; the first direction weighs most."""
    @F.pandas_udf(T.LongType())
    def pattern(rows: pd.Series) -> pd.Series:
        size = max((len(r) for r in rows), default=0)
        matrix = np.zeros((len(rows), size))
        for i, r in enumerate(rows):
            matrix[i, :len(r)] = r
        # Directions are drawn dimension by dimension, so that a longer vector does not change them.
        planes = np.stack([np.random.default_rng([seed, table, d]).normal(size=directions) for d in range(size)]) if size else np.zeros((0, directions))
        return pd.Series(((matrix @ planes) > 0).astype(np.int64) @ (1 << np.arange(directions - 1, -1, -1)))

    return pattern(vectors)


def _nearest(k: int):
    """Per block: the ``k`` nearest others of every row by cosine distance, ties by id."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", kind="stable")
        ids = block["id"].to_numpy()
        size = max((len(v) for v in block["vector"]), default=0)
        matrix = np.zeros((len(block), size))
        for i, v in enumerate(block["vector"]):
            matrix[i, :len(v)] = v
        norms = np.sqrt((matrix ** 2).sum(axis=1))
        both = norms[:, None] * norms[None, :]
        distance = np.where(both > 0, 1 - (matrix @ matrix.T) / np.where(both > 0, both, 1), 1.0)
        np.fill_diagonal(distance, np.inf)
        order = np.argsort(distance, axis=1, kind="stable")[:, :min(k, len(ids) - 1)]
        return pd.DataFrame({"a": np.repeat(ids, order.shape[1]), "b": ids[order].ravel(),
                             "distance": np.take_along_axis(distance, order, axis=1).ravel()})
    return run


def neighbours(rows: DataFrame, k: int, seed: int = 42, block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """``(a, b, distance, rank)``: up to ``k`` near rows b of every row a of ``(id, vector)``. Exact for up to ``block`` rows."""
    patterns = rows.select("id", F.posexplode(F.array(*[projections(F.col("vector"), t, seed) for t in range(tables)])).alias("table", "pattern"))
    placed = rank_within(patterns, ["table"], ["pattern", "id"], "place")
    # Each table cuts at other places.
    cut = F.floor((F.col("place") - 1 + F.col("table") * (block // tables)) / block)
    dealt = placed.select("id", "table", cut.alias("block")).join(rows, "id")
    found = dealt.groupBy("table", "block").applyInPandas(_nearest(k), "a long, b long, distance double")
    once = materialize(found, "near").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return materialize(top_k(once, ["a"], ["distance", "b"], k), "neighbours")


def _levels(cores: DataFrame, shares: tuple) -> list[float]:
    """Distances of the levels, coarse to fine: one number per share."""
    found = cores.agg(F.percentile_approx("core", list(shares), 100_000)).first()[0] or []
    levels = []
    for distance in found:
        distance = max(float(distance), CLOSEST)
        if not levels or distance < levels[-1]:
            levels.append(distance)
    return levels


def _chosen(big: DataFrame, member: DataFrame, levels: list[float]) -> DataFrame:
    """``(level, root, n)`` of the kept clusters among ``big`` ones, by excess of mass."""
    density = [1 / e for e in levels]
    reach = [b - a for a, b in zip(density, density[1:])] + [density[-1]]
    states, above = {}, None
    for level in range(len(levels) - 1, -1, -1):
        here = big.where(F.col("level") == level).select("root", "n")
        if above is None:
            kids = here.select("root", F.lit(0).alias("kids"), F.lit(0.0).alias("best"), F.lit(0.0).alias("one"), F.lit(0.0).alias("parts")).where("false")
        else:
            into = member.where(F.col("level") == level).select(F.col("node").alias("child"), F.col("root").alias("up"))
            kids = above.withColumnRenamed("root", "child").join(into, "child").groupBy(F.col("up").alias("root")).agg(
                F.count("*").cast("int").alias("kids"), F.sum(F.greatest("mass", "below")).alias("best"), F.max("mass").alias("one"),
                F.max("below").alias("parts"))
        joined = here.join(kids, "root", "left").na.fill(0)
        # One part: the same cluster at a higher density. Several: it ends here.
        states[level] = above = materialize(joined.select(
            "root", "n", "kids", (F.col("n") * reach[level] + F.when(F.col("kids") == 1, F.col("one")).otherwise(0.0)).alias("mass"),
            F.when(F.col("kids") == 1, F.col("parts")).when(F.col("kids") > 1, F.col("best")).otherwise(0.0).alias("below")), "clusters")
    kept, decided = None, None
    for level in range(len(levels)):
        here = states[level].withColumn("good", F.col("mass") >= F.col("below"))
        if decided is None:
            marked = here.withColumns({"taken": F.lit(False), "pick": F.col("good")})
        else:
            into = member.where(F.col("level") == level - 1).select(F.col("node").alias("root"), F.col("root").alias("up"))
            marked = here.join(into, "root").join(decided, "up").withColumn("pick", F.col("born") & ~F.col("taken") & F.col("good"))
        marked = materialize(marked.select("root", "n", "kids", "taken", "pick"), "picked")
        decided = marked.select(F.col("root").alias("up"), (F.col("taken") | F.col("pick")).alias("taken"), (F.col("kids") > 1).alias("born"))
        picked = marked.where("pick").select(F.lit(level).alias("level"), "root", "n")
        kept = picked if kept is None else kept.unionByName(picked)
    return kept


def dense_topics(df: DataFrame, embedding: str = "embedding", min_size: int = 10, k: int = 10, scale: int | None = None,
                 shares: tuple = SHARES, seed: int = 42, block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """``df`` with ``topic``: 0 for the largest cluster, 1, …, and -1 for rows in no dense region.

    ``scale`` first maps each component x to floor(scale * x). Rows without a
    vector are outliers; a vector of zeros is at distance 1 from all others.
    """
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "embedded")
    rows = materialize(numbered.where(F.col(embedding).isNotNull()).select(F.col("_row").alias("id"), _vectors(df, embedding, scale).alias("vector")),
                       "vectors")
    near = neighbours(rows, k, seed, block, tables)
    cores = materialize(near.groupBy("a").agg(F.max("distance").alias("core")), "cores")
    levels = _levels(cores, shares)
    if not levels:
        return numbered.drop("_row").withColumn("topic", F.lit(OUTLIER).cast("long"))
    far = near.join(cores, "a").join(cores.select(F.col("a").alias("b"), F.col("core").alias("core_b")), "b")
    apart = far.select("a", "b", F.greatest("distance", "core", "core_b").alias("apart"))
    steps = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(e).alias("e")) for i, e in enumerate(levels)])
    links = apart.select("a", "b", F.explode(F.filter(steps, lambda s: F.col("apart") <= s["e"])).alias("s")).select("s.level", "a", "b")
    member = materialize(components(links, ["level"]), "members")
    big = materialize(member.groupBy("level", "root").agg(F.count("*").alias("n")).where(F.col("n") >= min_size), "clusters")
    kept = _chosen(big, member, levels)
    named = rank_within(kept, [], [F.col("n").desc(), F.col("root")], "topic").select("level", "root", (F.col("topic") - 1).alias("topic"))
    topics = member.join(named, ["level", "root"]).select(F.col("node").alias("_row"), "topic")
    return numbered.join(topics, "_row", "left").drop("_row").withColumn("topic", F.coalesce("topic", F.lit(OUTLIER)).cast("long"))
