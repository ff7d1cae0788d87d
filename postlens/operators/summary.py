"""Distributions, batch summaries, profiles and activity counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens import fixed_values as fixed
from postlens.functions import text as tx
from postlens.operators.filters import is_analysable
from postlens.operators.rows import unnest


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("sentiment").agg(F.count("*").alias("n"))


def theme_distribution(df: DataFrame) -> DataFrame:
    """Rows per main theme; a missing theme counts as the general one."""
    return (df.groupBy(F.coalesce("main_topic", F.lit(fixed.FALLBACK_THEME)).alias("main_topic"))
            .agg(F.count("*").alias("n")))


def batch_summary(df: DataFrame, column: str = "text") -> DataFrame:
    """``(kind, label, n)``: all entries, then sentiments and main themes of the analysed ones.

    Every row contributes its facts to one aggregation, so the scored rows are
    computed once and nothing is cached.
    """
    seen = is_analysable(F.col(column))
    facts = F.array_compact(F.array(
        F.struct(F.lit("total_entries").alias("kind"), F.lit("").alias("label")),
        F.when(seen, F.struct(F.lit("sentiment").alias("kind"),
                              F.coalesce("sentiment", F.lit("neutral")).alias("label"))),
        F.when(seen, F.struct(F.lit("theme").alias("kind"),
                              F.coalesce("main_topic", F.lit(fixed.FALLBACK_THEME)).alias("label")))))
    return df.select(F.inline_outer(facts)).groupBy("kind", "label").agg(F.count("*").alias("n"))


def batch_entries(df: DataFrame, id_column: str = "id", column: str = "text") -> DataFrame:
    """The analysed rows of a batch with a 100-character preview of their text."""
    analysed = df.where(is_analysable(F.col(column)))
    return (analysed.withColumn(column, tx.preview(tx.strip(F.col(column))))
            .withColumnRenamed(id_column, "entry_id"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, pct)`` with the share of all rows; nulls are not listed, ties go by value."""
    total = df.agg(F.count("*")).scalar()
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / total).orderBy(F.col("n").desc(), column)


def top_values(df: DataFrame, column: str, k: int = 7) -> DataFrame:
    return value_counts(df, column).limit(k)


def profile(df: DataFrame) -> DataFrame:
    """``(column, type, rows, nulls, empties)`` for every column from one aggregation."""
    fields = df.schema.fields
    aggregates = [F.count("*").alias("_rows")]
    for i, f in enumerate(fields):
        empty = F.col(f.name) == "" if isinstance(f.dataType, T.StringType) else F.lit(False)
        aggregates += [F.count_if(F.col(f.name).isNull()).alias(f"_n{i}"), F.count_if(empty).alias(f"_e{i}")]
    facts = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("nulls"), F.col(f"_e{i}").alias("empties"))
        for i, f in enumerate(fields)])
    return df.agg(*aggregates).select(F.inline(facts))


def distinct_themes(df: DataFrame, definition: str = "main") -> DataFrame:
    """Distinct themes as sorted rows: over main themes, or over ``all`` listed themes."""
    source = df.select("main_topic") if definition == "main" else unnest(df, [], "themes", "main_topic")
    return source.where(F.col("main_topic").isNotNull()).select(F.col("main_topic").alias("theme")).distinct().orderBy("theme")


def theme_counts(df: DataFrame) -> DataFrame:
    """Number of themes under both definitions, as ``(definition, n)``."""
    pairs = F.array_union(
        F.transform("themes", lambda t: F.struct(F.lit("all").alias("definition"), t.alias("theme"))),
        F.array(F.struct(F.lit("main").alias("definition"), F.col("main_topic").alias("theme"))))
    return (df.select(F.inline_outer(pairs)).where(F.col("theme").isNotNull()).distinct()
            .groupBy("definition").agg(F.count("*").alias("n")))


def user_activity(entries: DataFrame, as_of: datetime, author: str = "author", ts: str = "ts") -> DataFrame:
    """Per author: entries in total, in the last month, week and day, and the latest time."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def since(days: int):
        after = F.col(ts) >= now - F.make_interval(days=F.lit(days))
        return F.count_if(after & (F.col(ts) <= now))

    today = F.count_if((F.col(ts) >= F.date_trunc("day", now).cast("timestamp_ntz")) & (F.col(ts) <= now))
    return entries.groupBy(author).agg(
        F.count("*").alias("total"), since(30).alias("last_month"), since(7).alias("last_week"),
        today.alias("today"), F.max(ts).alias("last_entry"))


def topic_sizes(entries: DataFrame, topic: str = "topic", per_page: int = 10) -> DataFrame:
    """Entries and pages per topic."""
    return (entries.groupBy(topic).agg(F.count("*").alias("entry_count"))
            .withColumn("total_page", F.ceil(F.col("entry_count") / per_page).cast("int")))


def dataset_metadata(df: DataFrame, topic: str = "topic", collected_at: datetime | None = None) -> DataFrame:
    """``(key, value)``: entry count, collection time and one row per distinct topic."""
    stamp = F.lit(collected_at) if collected_at else F.current_timestamp()
    total = df.agg(F.count("*").cast("string").alias("value")).select(F.lit("total_entries").alias("key"), "value")
    when = df.sparkSession.range(1).select(F.lit("collected_at").alias("key"), stamp.cast("string").alias("value"))
    topics = df.select(F.lit("topic").alias("key"), F.col(topic).cast("string").alias("value")).distinct()
    return total.unionByName(when).unionByName(topics)
