"""Ranks, pages and samples that stay exact when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from postlens import fixed_values as fixed
from postlens.session import materialize

# Up to this k Spark itself cuts every group to k rows before the shuffle.
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def _columns(names: list) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """First ``k`` rows of every group, with their ``rank`` from 1.

    Small ``k``: a plain window filter, which Spark runs as a group limit on the
    map side, so a hot group reaches its final task as at most ``k`` rows per
    map task. Large ``k``: each group is first cut to ``k`` rows inside every
    salt, and only the survivors meet in one task. ``order`` must end in a
    unique column.
    """
    order = _columns(order)
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    survivors = df
    if k > limit:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
        inner = W.partitionBy(*keys, "_salt").orderBy(*order)
        survivors = salted.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= k).drop("_r", "_salt")
    outer = W.partitionBy(*keys).orderBy(*order)
    return survivors.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)


def rank_within(df: DataFrame, keys: list[str], order: list, rank: str = "rank",
                size: str | None = None) -> DataFrame:
    """Exact ``row_number`` for every row of every group, without one task per group.

    The rows are range-partitioned on (keys, order), so a hot group spreads over
    many partitions, and numbered inside their sorted partition. A row's rank is
    its distance from the first row of its group in the same partition plus the
    group's rows in earlier partitions; both come from one small row per group
    and partition. The numbered rows are stored once in the shared folder, so
    every pass sees the same numbers. ``order`` must end in a unique column;
    ``size`` names an optional group-size column. Select the columns you need
    first: they are all written once.
    """
    order = _columns(order)
    by = [*[F.col(k) for k in keys], *order]
    numbered = (df.repartitionByRange(*by).sortWithinPartitions(*by)
                .withColumn("_at", F.monotonically_increasing_id()))
    # The id holds the partition number above bit 33 and the place in the partition below.
    stored = materialize(numbered).withColumn("_pid", F.shiftright("_at", 33))
    runs = stored.groupBy("_pid", *keys).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("_pid").alias("_o_pid"), *[F.col(k).alias(f"_o_{k}") for k in keys], "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("_size"))
    match = F.col("_pid") == F.col("_o_pid")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    extra = {rank: F.col("_at") - F.col("_first") + F.col("_before") + 1}
    if size:
        extra[size] = F.col("_size")
    return stored.join(offsets, match).withColumns(extra).select(*df.columns, *extra)


def rank_sentences(sentences: DataFrame, key: str = "doc_id", n: int = fixed.MAX_SENTENCES) -> DataFrame:
    """Last ``n`` rows per post from ``(key, sent_idx, …)``, with ``total`` and ``is_last``."""
    last = top_k(sentences, [key], [F.col("sent_idx").desc()], n, "from_end")
    return last.withColumns({
        "total": F.count("*").over(W.partitionBy(key)),
        "is_last": F.col("from_end") == 1,
    })


def paginate(df: DataFrame, keys: list[str], order: list, size: int = 10) -> DataFrame:
    """Add ``position``, ``page``, ``total_page``, ``has_prev`` and ``has_next``."""
    ranked = rank_within(df, keys, order, "position", "_size")
    page = F.ceil(F.col("position") / size).cast("int")
    total = F.ceil(F.col("_size") / size).cast("int")
    return ranked.withColumns({"page": page, "total_page": total}).withColumns({
        "has_prev": F.col("page") > 1, "has_next": F.col("page") < F.col("total_page")}).drop("_size")


def one_page(df: DataFrame, order: list, page: int, size: int = 10) -> DataFrame:
    """A single page of the whole table; its rows are picked by rank, so a deep page is no larger task than the first."""
    place = F.col("_place")
    return rank_within(df, [], order, "_place").where(
        (place > (page - 1) * size) & (place <= page * size)).drop("_place").orderBy(*_columns(order))


def seeded_order(id_column: str, seed: int = 42) -> Column:
    """Reproducible random order: the hash of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_column).cast("string")))


def shuffle_rows(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The whole table in a reproducible random order (a range sort on the hash)."""
    return df.orderBy(seeded_order(id_column, seed), id_column)


def stratified_sample(df: DataFrame, stratum: str, id_column: str, n: int | str | None, seed: int = 42,
                      border_rows: int = 1000) -> DataFrame:
    """Up to ``n`` rows of every stratum; no ``n``, ``'all'`` or ``n <= 0`` keeps everything.

    The rows of a stratum with the ``n`` least hashes of seed and id are picked
    by a threshold, not by sorting: counts per hash prefix, which combine on the
    map side, show the prefix in which the n-th row lies. That border is counted
    again by longer prefixes until at most ``border_rows`` rows of a stratum are
    in it, and only these are ranked. The plan is the same for every ``n``.
    """
    if n is None or n == "all" or int(n) <= 0:
        return df
    h, digits, border = seeded_order(id_column, seed), 3, None
    narrow = df.select(F.col(stratum).alias("_s"), h.alias("_h"))
    while True:
        inside, need = narrow, F.lit(int(n))
        if border is not None:
            known = border.select(F.col("_s").alias("_of"), F.col("_prefix").alias("_upper"), "_need")
            inside = narrow.join(known, F.col("_s").eqNullSafe(F.col("_of")) & (F.left("_h", F.lit(digits - 3)) == F.col("_upper")))
            need = F.col("_need")
        counts = inside.withColumn("_need", need).groupBy("_s", F.left("_h", F.lit(digits)).alias("_prefix")).agg(
            F.count("*").alias("_n"), F.max("_need").alias("_need"))
        # At most 4,096 prefixes of a stratum.
        so_far = F.sum("_n").over(W.partitionBy("_s").orderBy("_prefix"))
        reached = counts.withColumn("_to", so_far).where((F.col("_to") >= F.col("_need")) & (F.col("_to") - F.col("_n") < F.col("_need")))
        border = materialize(reached.select("_s", "_prefix", (F.col("_need") - F.col("_to") + F.col("_n")).alias("_need"), "_n"), "border")
        if digits >= 30 or (border.agg(F.max("_n")).first()[0] or 0) <= border_rows:
            break
        digits += 3
    cuts = border.select(F.col("_s").alias("_of"), "_prefix", "_need")
    marked = df.join(cuts, F.col(stratum).eqNullSafe(F.col("_of")), "left")
    place = F.left(h, F.lit(digits))
    surely = marked.where(F.col("_prefix").isNull() | (place < F.col("_prefix"))).select(*df.columns)
    edge = marked.where(place == F.col("_prefix")).withColumn("_pick", F.row_number().over(W.partitionBy(stratum).orderBy(h, id_column)))
    return surely.unionByName(edge.where(F.col("_pick") <= F.col("_need")).select(*df.columns))


def top_themes(scores, threshold: float = 0.15, k: int = 3) -> Column:
    """Best labels of an ``array<struct<label, score>>``: at most ``k`` that reach ``threshold``,
    or the single best one when none does. Ties keep their order in the array."""
    order = F.sort_array(F.transform(scores, lambda x, i: F.struct(
        (-x["score"]).alias("neg"), i.alias("place"), x["label"].alias("label"))))
    best = F.transform(order, lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("score")))
    good = F.slice(F.filter(best, lambda x: x["score"] >= threshold), 1, k)
    return F.when(F.size(good) > 0, good).otherwise(F.slice(best, 1, 1))


def trending(topics: DataFrame, k: int = 8, count: str = "entry_count", id_column: str = "id") -> DataFrame:
    """Topics with the most entries; ordering and limit run as one top-k operator."""
    return topics.orderBy(F.col(count).desc(), F.col(id_column)).limit(k)


def day_key(ts: Column, shift_hours: int = 4) -> Column:
    """Calendar day of a list that turns over ``shift_hours`` after midnight UTC."""
    return F.to_date(ts - F.make_interval(hours=F.lit(shift_hours)))


def daily_best(df: DataFrame, k: int, ts: str = "ts", favourites: str = "fav_count",
               id_column: str = "id") -> DataFrame:
    """Most liked rows of every day key."""
    dated = df.withColumn("day", day_key(F.col(ts)))
    return top_k(dated, ["day"], [F.col(favourites).desc(), F.col(id_column)], k)


def order_entries(df: DataFrame, mode: str = "default", topic: str = "topic", ts: str = "created_at",
                  favourites: str = "fav_count", id_column: str = "id") -> DataFrame:
    """Entries of each topic with their ``position``: by time, or most liked first (``nice``)."""
    order = [F.col(favourites).desc(), F.col(id_column)] if mode == "nice" else [F.col(ts), F.col(id_column)]
    return rank_within(df, [topic], order, "position")


def latest_by_author(df: DataFrame, page: int = 1, size: int = 10, nick: str | None = None,
                     author: str = "author", ts: str = "created_at", id_column: str = "id") -> DataFrame:
    """One page of the newest entries of ``nick``, or of every author."""
    order = [F.col(ts).desc(), F.col(id_column).desc()]
    if nick is not None:
        return one_page(df.where(F.col(author) == nick), order, page, size)
    newest = top_k(df, [author], order, page * size, "position")
    return newest.where(F.col("position") > (page - 1) * size)
