"""The daily list as a table partitioned by day, built once per day."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.ranking import day_key, top_k


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """``(day)`` of every stored partition; empty when there is no table yet."""
    try:
        return spark.read.schema("day date").parquet(path).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "day date")


def refresh_daily(entries: DataFrame, path: str, k: int = 50, closed_before: date | None = None,
                  ts: str = "ts", favourites: str = "fav_count", id_column: str = "id") -> None:
    """Write the best entries of every day that is not stored yet (safe to repeat).

    Stored days are dropped before the ranking. ``closed_before`` leaves out
    days that may still get entries.
    """
    dated = entries.withColumn("day", day_key(F.col(ts)))
    if closed_before is not None:
        dated = dated.where(F.col("day") < F.lit(closed_before))
    rebuild_days(dated.join(stored_days(entries.sparkSession, path), "day", "left_anti"), path, k, favourites, id_column)


def rebuild_days(dated: DataFrame, path: str, k: int = 50, favourites: str = "fav_count", id_column: str = "id") -> None:
    """Write the best of all ``dated`` entries (with ``day``) in place of what is stored for their days."""
    best = top_k(dated, ["day"], [F.col(favourites).desc(), F.col(id_column)], k)
    (best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def daily_snapshot(entries: DataFrame, path: str, day: date, k: int = 50, ts: str = "ts",
                   favourites: str = "fav_count", id_column: str = "id") -> DataFrame:
    """The list of one day: from the table if stored, else computed, stored and read back."""
    wanted = entries.where(day_key(F.col(ts)) == F.lit(day))
    refresh_daily(wanted, path, k, None, ts, favourites, id_column)
    schema = entries.withColumns({"rank": F.lit(0), "day": F.lit(day)}).schema
    return entries.sparkSession.read.schema(schema).parquet(path).where(F.col("day") == F.lit(day))
