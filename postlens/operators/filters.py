"""Row filters and the counted cleaning funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as tx


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def drop_missing(df: DataFrame, columns: list[str], blank_too: bool = True) -> DataFrame:
    """Rows where every column holds a value (``''`` in a text column counts as missing if ``blank_too``)."""
    blank = {c for c in columns if blank_too and isinstance(df.select(c).schema[0].dataType, T.StringType)}
    present = [F.col(c).isNotNull() & (F.col(c) != "" if c in blank else F.lit(True)) for c in columns]
    return df.where(reduce(lambda a, b: a & b, present))


def is_url_only(col: Column) -> Column:
    return col.rlike(rf"^(https?://|www\.)[^{tx.SPACE_CLASS}]+$")


def is_short_crossref(col: Column, below: int = 20) -> Column:
    return F.lower(col).contains("bkz") & (F.length(col) < below)


def drop_url_only(df: DataFrame, column: str = "body") -> DataFrame:
    return df.where(~is_url_only(F.col(column)))


def drop_short_crossref(df: DataFrame, column: str = "body", below: int = 20) -> DataFrame:
    return df.where(~is_short_crossref(F.col(column), below))


def min_length(df: DataFrame, column: str = "body", above: int = 10) -> DataFrame:
    return df.where(F.length(column) > above)


def text_verdict(col: Column, low: int = 3, high: int = 5000) -> Column:
    """``ok``, ``too_short`` or ``too_long`` for the stripped text."""
    length = F.length(tx.strip(F.coalesce(col, F.lit(""))))
    return F.when(length < low, "too_short").when(length > high, "too_long").otherwise("ok")


def valid_text(df: DataFrame, column: str = "text", low: int = 3, high: int = 5000
               ) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; the rejected rows carry their ``reason``."""
    judged = df.withColumn("reason", text_verdict(F.col(column), low, high))
    return judged.where("reason = 'ok'").drop("reason"), judged.where("reason <> 'ok'")


def is_analysable(col: Column, low: int = 3) -> Column:
    """The batch rule: stripped text of at least ``low`` characters."""
    return F.length(tx.strip(F.coalesce(col, F.lit("")))) >= low


def batch_skip(df: DataFrame, column: str = "text", low: int = 3) -> DataFrame:
    return df.where(is_analysable(F.col(column), low))


def drop_incomplete(df: DataFrame, columns: tuple[str, ...] = ("body", "author", "id")) -> DataFrame:
    return drop_missing(df, list(columns))


def drop_unknown_gold(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.where(F.col(gold).isin(0, 1, 2) & F.col(pred).isin(0, 1, 2))


def filter_analysed(df: DataFrame, sentiment: str = "all", theme: str = "all") -> DataFrame:
    """Keep rows whose analysis fits the choice; rows without an analysis always stay.

    Expects ``sentiment`` and ``themes`` as left by ``attach_analysis``.
    """
    keep = F.lit(True)
    if sentiment != "all":
        keep = keep & (F.col("sentiment") == sentiment)
    if theme != "all":
        keep = keep & (F.col("themes").isNull() | F.array_contains("themes", theme))
    return df.where(F.col("sentiment").isNull() | keep)


def valid_query(df: DataFrame, column: str = "query", low: int = 2) -> DataFrame:
    return df.where(F.length(tx.strip(F.col(column))) >= low)


def entry_by_id(df: DataFrame, entry_id, column: str = "id") -> DataFrame:
    """One entry; the comparison reaches the scan as a pushed filter."""
    return df.where(F.col(column) == F.lit(entry_id))


def entries_by_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def by_channel(df: DataFrame, channel: str | None, column: str = "tags") -> DataFrame:
    """Topics of one channel, or all of them (the general agenda)."""
    return df if not channel else df.where(F.array_contains(column, channel))


def cleaning_funnel(df: DataFrame, column: str = "body", profile: str = "sheet") -> DataFrame:
    """``(stage, n)``: how many rows each rule removes first, and how many remain.

    One pass over the data: every row is counted under the first rule that
    rejects it. ``sheet`` keeps rows that are empty after cleaning but shows
    them as their own stage; ``labelling`` only knows valid and skipped rows.
    """
    body = F.col("_clean")
    if profile == "sheet":
        stages = ["null", "url_only", "short_crossref", "empty", "remaining"]
        stage = (F.when(body.isNull(), "null")
                 .when(is_url_only(body), "url_only")
                 .when(is_short_crossref(body), "short_crossref")
                 .when(body == "", "empty").otherwise("remaining"))
    elif profile == "labelling":
        stages = ["skipped", "valid"]
        stage = F.when(F.length(body) > 10, "valid").otherwise("skipped")
    else:
        raise ValueError(f"no funnel for profile: {profile}")
    judged = df.select(tx.clean(F.col(column), profile).alias("_clean")).select(stage.alias("stage"))
    counted = judged.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in stages])
    return counted.unpivot([], stages, "stage", "n")
