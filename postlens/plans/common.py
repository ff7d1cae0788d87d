"""Shared inputs of the registered queries and the SQL fragments of their checks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators import scoring
from postlens.session import spread

BASE_URL = "https://forum.example.org"


TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    # Text work is bound by the CPU: let a small text table use all cores.
    return spread(rows, *TEXT_KEYS[name]) if name in TEXT_KEYS else rows


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows on all cores, however few pieces they are stored in: what follows takes far longer than the shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


# The supplied documents are invented prose in four languages, so the phrase
# lists, stop words and vocabularies below are frequent words of that prose.
LEXICON = scoring.Lexicon(
    positive=["the", "and", "la", "ing", "und", "que", "tion", "that", "of the"],
    negative=["of", "de", "der", "on", "est", "les", "for", "un", "in the"],
)
OTHER_LEXICONS = {
    "broad": LEXICON,
    "narrow": scoring.Lexicon(positive=["and", "und", "que"], negative=["for", "der", "les"]),
    "none": scoring.Lexicon(positive=["+"], negative=["@"]),
}
STOP_WORDS = ["that", "this", "with", "from", "eine", "para", "pour", "dans"]
VOCABULARIES = {
    "en": ["the", "of", "and", "to", "is", "that", "it", "was", "for", "with"],
    "fr": ["le", "les", "des", "et", "que", "une", "est", "pour", "dans", "qui"],
    "de": ["der", "die", "und", "den", "von", "das", "mit", "nicht", "ist", "auf"],
    "es": ["el", "los", "las", "y", "que", "una", "por", "con", "para", "es"],
}


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_hits(column: str, words: list[str]) -> str:
    """Number of listed phrases the lower-cased text contains."""
    return f"len(list_filter({sql_list(words)}, lambda w: contains(lower({column}), w)))"


def sql_replace(column: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        column = "replace({}, '{}', '{}')".format(column, old.replace("'", "''"), new.replace("'", "''"))
    return column


SQL_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def sql_squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SQL_SPACES}', ' ', 'g'))"


def sql_strip(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '^{SQL_SPACES}', ''), '{SQL_SPACES}$', '')"


def sql_prep(column: str) -> str:
    """References and addresses out, then stripped."""
    no_refs = rf"regexp_replace({column}, '(?i)\(bkz:\s*[^)]+\)', ' ', 'g')"
    return sql_strip(rf"regexp_replace({no_refs}, 'https?://\S+', ' ', 'g')")


SQL_TOKENS = (r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), "
              r"lambda t: regexp_full_match(t, '[a-zçğıöşü]+'))")


def sql_sentences(source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """CTEs ``prepared``, ``cut`` (all sentences) and ``tail`` (last ten, one row each)."""
    return rf"""
prepared AS (
  SELECT {key}, {sql_prep(column)} AS whole FROM {source}),
cut AS (
  SELECT {key}, whole, list_filter(list_transform(string_split_regex(whole, '[.?!…\n]+'),
         lambda s: {sql_strip('s')}), lambda s: s <> '') AS parts FROM prepared),
tail AS (
  SELECT {key}, unnest(last) AS sentence, generate_subscripts(last, 1) - 1 AS sent_idx, len(last) AS n
  FROM (SELECT {key}, CASE WHEN len(parts) = 0 THEN [whole] WHEN len(parts) > 10
               THEN parts[len(parts) - 9:len(parts)] ELSE parts END AS last FROM cut))"""


def sql_scored(lexicon: scoring.Lexicon = LEXICON, key: str = "doc_id") -> str:
    """CTE ``scored`` on top of ``tail``."""
    return f"""
hits AS (
  SELECT *, {sql_hits('sentence', lexicon.positive)} AS p, {sql_hits('sentence', lexicon.negative)} AS g FROM tail),
scored AS (
  SELECT {key}, sent_idx, n, sentence,
         CASE WHEN p > g THEN 'positive' WHEN g > p THEN 'negative' ELSE 'neutral' END AS label,
         (greatest(p, g) + 1)::DOUBLE / (p + g + 2) AS score FROM hits)"""


def sql_vote(key: str = "doc_id", cte: str = "scored", out: str = "voted") -> str:
    """CTE ``voted``: the vote rule as window-free SQL over long scores."""
    return f"""
{out}_w AS (
  SELECT *, CAST(CAST(score AS DECIMAL(18,6)) * CASE WHEN n = 1 OR sent_idx < n - 1 THEN 1.0 WHEN n <= 3 THEN 1.1
         WHEN n <= 7 THEN 2.0 ELSE 3.0 END AS DECIMAL(18,6)) AS v FROM {cte}),
{out}_t AS (
  SELECT {key}, max(n) AS n,
         coalesce(sum(v) FILTER (label = 'positive'), 0)::DECIMAL(18,6) AS vp,
         coalesce(sum(v) FILTER (label = 'negative'), 0)::DECIMAL(18,6) AS vn,
         coalesce(sum(v) FILTER (label = 'neutral'), 0)::DECIMAL(18,6) AS vz,
         arg_max(label, score * 1000 - sent_idx * 0.0001) AS top_label, max(score) AS top_score
  FROM {out}_w GROUP BY {key}),
{out}_f AS (
  SELECT *, CASE WHEN vp >= vn AND vp >= vz THEN 'positive' WHEN vn >= vz THEN 'negative' ELSE 'neutral' END AS f,
         greatest(vp, vn, vz) AS fv,
         CASE top_label WHEN 'positive' THEN vp WHEN 'negative' THEN vn ELSE vz END AS tv,
         CASE WHEN vp >= vn THEN 'positive' ELSE 'negative' END AS alt, greatest(vp, vn) AS av FROM {out}_t),
{out}_d AS (
  SELECT *, fv::DOUBLE / n AS base, (f <> top_label AND abs(fv - tv) < 0.35) AS overruled FROM {out}_f),
{out}_s AS (
  SELECT {key}, top_label AS label,
    CASE WHEN overruled THEN top_label WHEN f = 'neutral' AND base < 0.55 AND av > 0.3 THEN alt ELSE f END AS sentiment,
    CASE WHEN overruled THEN top_score
         WHEN f <> 'neutral' THEN least(0.99::DOUBLE, greatest(0.65::DOUBLE, base))
         WHEN base < 0.55 AND av > 0.3 THEN least(0.85::DOUBLE, greatest(0.60::DOUBLE, av::DOUBLE / n))
         WHEN base < 0.55 THEN least(0.85::DOUBLE, greatest(0.45::DOUBLE, base))
         ELSE least(0.85::DOUBLE, greatest(0.50::DOUBLE, base)) END AS confidence
  FROM {out}_d),
{out} AS (
  SELECT {key}, label, sentiment, confidence,
    CASE sentiment WHEN 'positive' THEN confidence WHEN 'negative' THEN -confidence ELSE 0.0 END AS score FROM {out}_s)"""


def sql_sentiment(lexicon: scoring.Lexicon = LEXICON, source: str = "documents", key: str = "doc_id",
                  column: str = "text") -> str:
    """``WITH`` list ending in ``voted``."""
    return sql_sentences(source, key, column) + "," + sql_scored(lexicon, key) + "," + sql_vote(key)


def analysable_documents(spark: SparkSession, folder: str) -> DataFrame:
    from postlens.operators.filters import batch_skip
    return batch_skip(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def documents(spark: SparkSession, folder: str, among: DataFrame | None = None) -> DataFrame:
    """Ids and texts, or those whose id is ``among`` the given ones: others are left out before any text is dealt out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return spread(docs if among is None else docs.join(among.select("doc_id"), "doc_id", "left_semi"), "doc_id")


def document_sentiment(spark: SparkSession, folder: str, lexicon: scoring.Lexicon = LEXICON, among: DataFrame | None = None) -> DataFrame:
    """The vote of every document, or of those whose id is ``among`` the given ones."""
    return scoring.analyse_sentiment(documents(spark, folder, among), "text", scoring.lexicon_scorer(lexicon))


def join_words(column: str):
    return F.array_join(column, " ")
