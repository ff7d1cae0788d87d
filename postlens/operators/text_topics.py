"""Topics of new texts: cosine with the term vectors of known topics.

``fit`` turns texts with known topics into one sparse vector per topic, the
class-based TF-IDF weights of its best words. ``assign`` joins the words of new
texts with the inverted list of the model: one row per word, with the topics
that have it. A text's words are counted inside its row, so that only distinct
words meet the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions import values as val
from postlens.operators.keywords import keyword_tokens, top_words
from postlens.operators.ranking import rank_within, top_k
from postlens.operators.rows import unnest
from postlens.session import materialize

TERMS = 1000
_ALL = (1 << 31) - 1


def fit(df: DataFrame, topic: str, column: str = "text", terms: int = TERMS, stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """A model ``(word, idf, topics)``; ``topics`` are ``(place, topic, weight)`` with weights of unit length per topic.

    The weight of a word is its count in the topic times ``idf = ln(1 + A / f)``,
    with f its count in all topics and A the mean number of words of a topic.
    Each topic keeps its ``terms`` heaviest words, ties by word. Rows without a
    topic take no part.
    """
    words = unnest(df.where(F.col(topic).isNotNull()), [F.col(topic).cast("string").alias("topic")], keyword_tokens(F.col(column), stop_words), "word")
    tf = materialize(words.groupBy("topic", "word").agg(F.count("*").alias("tf")), "term-counts")
    average = tf.groupBy("topic").agg(F.sum("tf").alias("n")).agg(F.avg("n")).scalar()
    idf = tf.groupBy("word").agg(F.log(1 + average / F.sum("tf")).alias("idf"))
    weighted = tf.join(idf, "word").withColumn("weight", F.col("tf") * F.col("idf"))
    best = materialize(top_k(weighted, ["topic"], [F.col("weight").desc(), F.col("word")], terms), "terms")
    sizes = best.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    named = rank_within(sizes, [], ["topic"], "place")
    unit = best.join(named, "topic").select(
        "word", "idf", F.struct("place", "topic", (F.col("weight") / F.col("size")).alias("weight")).alias("t"))
    # As many topics a word as the model has.
    return unit.groupBy("word").agg(F.first("idf").alias("idf"), F.sort_array(F.collect_list("t")).alias("topics"))


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def similarities(df: DataFrame, model: DataFrame, keys: list[str], column: str = "text", stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """``(keys…, place, topic, similarity)`` for every topic that shares a word with the text; ``keys`` tell the texts apart."""
    counted = val.let(keyword_tokens(F.col(column), stop_words), lambda words: top_words(words, _ALL))
    rows = unnest(df, keys, counted, "w").select(*keys, F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    met = rows.join(model, "word").withColumn("own", F.col("n") * F.col("idf"))
    # A row without topic sums up the text's own length.
    none = F.struct(F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("topic"), F.col("own").alias("weight"))
    parts = met.select(*keys, "own", F.explode(F.array_append(F.col("topics"), none)).alias("t"))
    sums = parts.groupBy(*keys, "t.place", "t.topic").agg(F.sum(F.col("own") * F.col("t.weight")).alias("dot"))
    sums = materialize(sums, "dots")
    length = sums.where("place is null").select(*keys, F.sqrt("dot").alias("length"))
    return sums.where("place is not null").join(length, keys).select(*keys, "place", "topic", (F.col("dot") / F.col("length")).alias("similarity"))


def assign(df: DataFrame, model: DataFrame, keys: list[str], column: str = "text", stop_words: list[str] = fixed.STOP_WORDS,
           least: float = 0.0) -> DataFrame:
    """``(keys…, topic, similarity, probability)`` of every text.

    The topic is the most similar one, ties by name; its probability is its
    share of the similarities with all topics. A text without a known word, or
    whose best similarity is under ``least``, has no topic.
    """
    found = similarities(df, model, keys, column, stop_words)
    best = found.groupBy(*keys).agg(
        F.max(F.struct("similarity", (-F.col("place")).alias("neg"), "topic")).alias("best"), F.sum("similarity").alias("all"))
    good = F.col("best.similarity") >= least
    return df.select(*keys).join(best, keys, "left").select(
        *keys, F.when(good, F.col("best.topic")).alias("topic"), F.coalesce("best.similarity", F.lit(0.0)).alias("similarity"),
        F.when(good, F.col("best.similarity") / F.col("all")).alias("probability"))
