"""Keywords of a text and terms of a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators.ranking import top_k
from postlens.operators.rows import unnest


def keyword_tokens(col: Column, stop_words: list[str] = fixed.STOP_WORDS, longer_than: int = 3) -> Column:
    """Candidate words in reading order: long enough and not a stop word."""
    words = F.filter(tx.word_tokens(col), lambda w: F.length(w) > longer_than)
    return tx.drop_stopwords(words, stop_words)


def top_words(words: Column, n: int = 8) -> Column:
    """``array<struct<word, n>>``: the most frequent words, ties by first appearance.

    The words are sorted together with their places; equal words then form runs,
    whose first element holds the first place and whose length is the count. The
    cost is two sorts inside the row and no shuffle.
    """
    size = F.size(words)
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place"))))

    def runs(ordered: Column) -> Column:
        places = F.slice(F.sequence(F.lit(0), size), F.lit(1), size)
        return val.let(F.filter(places, lambda i: (i == 0) | (ordered[i]["word"] != ordered[i - 1]["word"])),
                       lambda starts: by_length(ordered, starts))

    def by_length(ordered: Column, starts: Column) -> Column:
        return F.sort_array(F.transform(starts, lambda s, j: F.struct(
            (s - F.coalesce(F.get(starts, j + 1), size)).alias("neg"),
            ordered[s]["place"].alias("place"), ordered[s]["word"].alias("word"))))

    best = F.slice(val.let(placed, runs), 1, n)
    return F.transform(best, lambda r: F.struct(r["word"].alias("word"), (-r["neg"]).cast("bigint").alias("n")))


def with_keywords(df: DataFrame, column: str = "text", n: int = 8,
                  stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """Add ``keywords``: ``array<struct<word, n>>``, best first."""
    found = val.let(keyword_tokens(F.col(column), stop_words), lambda words: top_words(words, n))
    return df.withColumn("keywords", found)


def keyword_rows(df: DataFrame, key: str, column: str = "text", n: int = 8,
                 stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """``with_keywords`` as rows ``(key, rank, word, n)``."""
    found = with_keywords(df.select(key, column), column, n, stop_words)
    return unnest(found, [key], "keywords", "k", "rank").select(key, (F.col("rank") + 1).alias("rank"), "k.word", "k.n")


def topic_terms(df: DataFrame, topic: str, column: str = "text", k: int = 5,
                stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """Top words per topic by class-based TF-IDF: ``tf * ln(1 + A / f)``.

    ``tf`` is the count in the topic, ``f`` the count over all topics and ``A``
    the average number of words per topic. Counting combines on the map side
    and is keyed by (topic, word), so a topic with most of the text is no hot key.
    """
    words = unnest(df, [topic], keyword_tokens(F.col(column), stop_words), "word")
    tf = words.groupBy(topic, "word").agg(F.count("*").alias("tf"))
    totals = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    average = tf.groupBy(topic).agg(F.sum("tf").alias("n")).agg(F.avg("n")).scalar()
    weighted = tf.join(totals, "word").withColumn("weight", F.col("tf") * F.log(1 + average / F.col("f")))
    return top_k(weighted, [topic], [F.col("weight").desc(), F.col("word")], k).select(
        topic, "rank", "word", "tf", "f", "weight")
