"""Dates, counters, labels and codes."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions.text import strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst moves filters below projections by copying expressions. A value
    bound here stays a single copy however often ``body`` uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def split_tags(col: Column) -> Column:
    """Comma-separated channel list; null when blank."""
    return F.when(strip(col) != "", F.split(strip(col), ","))


def parse_edit_date(col: Column) -> Column:
    """``struct(created_at, updated_at)`` of ``created ~ updated``.

    A short ``updated`` (only the time) takes the leading characters it lacks
    from ``created``.
    """
    updated = strip(F.get(F.split(col, "~"), F.lit(1)))
    head = F.substr(col, F.lit(1), F.greatest(F.length(col) - F.length(updated) - 2, F.lit(0)))
    edited = F.coalesce(updated, F.lit("")) != ""
    created = F.when(edited, strip(head)).otherwise(col)
    lacking = F.length(created) - F.length(updated)
    full = F.when(edited & (lacking > 0), F.concat(F.substr(created, F.lit(1), lacking), updated))
    return F.struct(created.alias("created_at"), F.coalesce(full, updated).alias("updated_at"))


def to_post_ts(col: Column) -> Column:
    """``dd.MM.yyyy[ HH:mm]`` to a timestamp without zone; null when it is neither."""
    with_time = F.try_to_timestamp(col, F.lit("dd.MM.yyyy HH:mm"))
    return F.coalesce(with_time, F.try_to_timestamp(col, F.lit("dd.MM.yyyy"))).cast("timestamp_ntz")


def parse_count(col: Column, default: int = 1) -> Column:
    """First number of a counter text such as ``230 başlık``."""
    return F.coalesce(F.regexp_extract(col, r"(\d+)", 1).try_cast("bigint"), F.lit(default).cast("bigint"))


def first_truthy(*cols: Column, default=None, empty="") -> Column:
    """First value that is neither null nor ``empty`` (``''`` for text, ``0`` for counters)."""
    return F.coalesce(*[F.nullif(c, F.lit(empty)) for c in cols], F.lit(default))


def sentiment_code(col: Column) -> Column:
    """negative, neutral, positive to 0, 1, 2; anything else counts as neutral."""
    return F.coalesce(F.try_element_at(_literal_map(fixed.SENTIMENT_CODES), col), F.lit(1))


def gold_code(col: Column, numeric: bool = False) -> Column:
    """Gold label to 0, 1, 2, or -1 when it cannot be read.

    Numbers are truncated; text goes through the spelling table. Text ``-1``
    means negative while the number -1 is invalid.
    """
    if numeric:
        code = F.when(~F.isnan(col.cast("double")), col.try_cast("int"))
        return F.when(code.isin(0, 1, 2), code).otherwise(-1)
    return F.coalesce(F.try_element_at(_literal_map(fixed.GOLD_CODES), strip(F.lower(col))), F.lit(-1))


def canonical_sentiment(label: Column, score: Column) -> Column:
    """``struct(label, score)`` with one of three labels; an unknown label is neutral at 0.5."""
    text = strip(F.lower(F.coalesce(label, F.lit("neutral"))))
    index = F.when(text.startswith("label_"), F.substring_index(text, "_", -1).try_cast("int"))
    known = (
        F.when(index == 0, "negative").when(index == 1, "neutral").when(index == 2, "positive")
        .when(text.contains("pos") | text.contains("olumlu"), "positive")
        .when(text.contains("neg") | text.contains("olumsuz"), "negative")
        .when(text.contains("neutral") | text.contains("nötr"), "neutral")
    )
    return F.struct(
        F.coalesce(known, F.lit("neutral")).alias("label"),
        F.when(known.isNull(), F.lit(0.5)).otherwise(F.coalesce(score.cast("double"), F.lit(0.5))).alias("score"),
    )


def best_candidate(candidates: Column) -> Column:
    """Best of an array of ``struct(label, score)``, the first one on ties."""
    ranked = F.transform(candidates, lambda c, i: F.struct(
        F.coalesce(c["score"], F.lit(0.0)).alias("score"), (-i).alias("place"),
        F.coalesce(c["label"], F.lit("neutral")).alias("label")))
    best = F.array_max(ranked)
    return F.struct(
        F.coalesce(best["label"], F.lit("neutral")).alias("label"),
        F.coalesce(best["score"], F.lit(0.5)).alias("score"),
    )


def theme_label(code: Column) -> Column:
    """Model label to its Turkish theme name; unknown labels are capitalized."""
    capital = F.concat(F.upper(F.substring(code, 1, 1)), F.lower(F.substr(code, F.lit(2))))
    return F.coalesce(
        F.try_element_at(_literal_map(fixed.THEME_BY_CODE), code),
        F.try_element_at(_literal_map(fixed.THEME_BY_ENGLISH), strip(F.lower(code))),
        capital,
    )


def signed_score(sentiment: Column, confidence: Column) -> Column:
    """+confidence, -confidence or 0."""
    return (F.when(sentiment == "positive", confidence)
            .when(sentiment == "negative", -confidence).otherwise(F.lit(0.0)))


def prefix_signed_score(label: Column, score: Column) -> Column:
    """Sign taken from the label's spelling: ``neg…`` is negative, ``pos…`` positive."""
    text = F.lower(label)
    return (F.when(text.contains("neg"), -F.abs(score))
            .when(text.contains("pos"), F.abs(score)).otherwise(score))


def round2(col: Column) -> Column:
    """Two decimals, judged on the exact binary value as Python's ``round`` does."""
    return F.call_function("format_number", col.cast("double"), F.lit("0.00")).cast("double")


