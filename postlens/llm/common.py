"""Helpers shared by the corpus operators: stored intermediates and word rules."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.session import scratch_path

#: Characters that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
WORD_GAP = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage with a copy that outlives executors, and gives later
    joins a side whose size is known and whose exchanges AQE may split when a
    key is hot. The copy goes when the application ends.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the copy that ``stage`` stored for ``df``; any other table stays."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getName().startswith("llm-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole(text: Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(text, GAP, -1), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unused(docs: DataFrame, name: str) -> str:
    """``name``, prolonged until no column of ``docs`` is called so (Spark ignores case in names)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def null_safe(col: Column) -> Column:
    """A text that is never null and differs for null and every value, for use as a join key."""
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col.cast("string")))


def running(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) and, for each value column, ``before_<value>``: its sum over all earlier rows.

    The order is global but no task sees the whole table: rows are range
    partitioned on ``order`` and stored, each partition is summed on its own, and
    only one row per partition meets in a single window. Rows that tie in all of
    ``order`` are put in any order, so make it unique where that matters.
    """
    parts = stage(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
                  .withColumn("_part", F.spark_partition_id()), "ranges")
    sums = [F.sum(v).alias(f"_all_{v}") for v in values]
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_all"), *sums)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("_part", *[
        F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ["_all", *[f"_all_{v}" for v in values]]])
    own = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    so_far = own.rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", (F.row_number().over(own) - 1).cast("long").alias("_place"), *[
        F.coalesce(F.sum(v).over(so_far), F.lit(0)).alias(f"_own_{v}") for v in values])
    return local.join(earlier, "_part").select(
        *df.columns, (F.col("_place") + F.col("_all")).cast("long").alias("rank"),
        *[(F.col(f"_own_{v}") + F.col(f"_all_{v}")).cast("long").alias(f"before_{v}") for v in values])


#: 64-bit words of a key filter: four million bits, half a megabyte, whatever the number of keys.
FILTER_WORDS = 1 << 16


def may_be_among(key: Column, keys: DataFrame) -> Column:
    """Whether ``key`` may be one of ``keys`` (one column): true for all that are, and for a few others.

    A bitmap of fixed size holds a bit per hash. Rows that it rules out need no
    join, so a join that concerns few rows moves few rows, at any size. With
    far more keys than bits it rules out nothing, which costs time only.
    """
    h = F.xxhash64(keys.columns[0])
    words = keys.select(F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).cast("int").alias("i"), F.pmod(h, F.lit(64)).cast("int").alias("b"))
    held = words.groupBy("i").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("w"))
    all_words = keys.sparkSession.range(FILTER_WORDS, numPartitions=1).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("w"))
    # FILTER_WORDS rows at most.
    full = held.unionByName(all_words).groupBy("i").agg(F.bit_or("w").alias("w")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))
    at = F.xxhash64(key)
    return F.getbit(F.get(full.scalar(), F.pmod(F.shiftrightunsigned(at, 6), F.lit(FILTER_WORDS)).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1


def without(df: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose ``name`` is not in stored ``gone`` (that column); only rows that may be are shuffled."""
    maybe = may_be_among(F.col(name), gone)
    return df.where(~maybe).unionByName(df.where(maybe).join(gone.hint("merge"), name, "left_anti"))


def only(df: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` joined with stored ``wanted`` on ``name``; only rows that may match are shuffled."""
    return df.where(may_be_among(F.col(name), wanted.select(name))).join(wanted.hint("merge"), name)


def keep_once(df: DataFrame, repeated: DataFrame, name: str) -> DataFrame:
    """``df`` with one row, whichever, of those whose ``name`` is in stored ``repeated``; the others as they are."""
    if repeated.isEmpty():
        return df
    return without(df, repeated, name).unionByName(only(df, repeated, name).select(df.columns).dropDuplicates([name]))
