"""Sentence scoring and the position-weighted vote.

A scorer is any function ``Column -> Column`` from an array of sentences to an
array of ``struct(label, score)``. The built-in one counts lexicon phrases. A
user model plugs in through ``ModelScorer``.

Everything but a user model works on array columns inside one row, so a post is scored and
voted on without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens import fixed_values as fixed
from postlens import schemas
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators.ranking import rank_sentences
from postlens.operators.rows import unnest

LABELS = ("positive", "negative", "neutral")
VOTE_TYPE = "decimal(18,6)"

Scorer = Callable[[Column], Column]


@dataclass(frozen=True)
class Lexicon:
    positive: list[str] = field(default_factory=lambda: list(fixed.POSITIVE_PHRASES))
    negative: list[str] = field(default_factory=lambda: list(fixed.NEGATIVE_PHRASES))


@dataclass(frozen=True)
class LastWeights:
    short: float = fixed.LAST_WEIGHT_SHORT
    medium: float = fixed.LAST_WEIGHT_MEDIUM
    long: float = fixed.LAST_WEIGHT_LONG


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur in the text, each counted once, overlaps included."""
    hits = [text.contains(p).cast("int") for p in phrases]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def lexicon_counts(col: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """``struct(pos, neg)`` of phrases found in the lower-cased text."""
    # Bound once: inside a lambda Catalyst would lower the text for every phrase.
    return val.let(F.lower(col), lambda text: F.struct(
        phrase_count(text, lexicon.positive).alias("pos"), phrase_count(text, lexicon.negative).alias("neg")))


def lexicon_match(df: DataFrame, column: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """One row per text and matched phrase (``phrase``, ``polarity``)."""
    text = F.lower(F.col(column))
    found = [F.when(text.contains(p), F.struct(F.lit(p).alias("phrase"), F.lit(side).alias("polarity")))
             for side, phrases in (("positive", lexicon.positive), ("negative", lexicon.negative))
             for p in phrases]
    return unnest(df, ["*"], F.array_compact(F.array(*found)), "_hit").select(*df.columns, "_hit.*")


def lexicon_scorer(lexicon: Lexicon = Lexicon()) -> Scorer:
    """More positive phrases: positive; more negative ones: negative; else neutral at 0.5."""

    def score_one(sentence: Column) -> Column:
        return lexicon_counts(sentence, lexicon)

    def judge(counts: Column) -> Column:
        pos, neg = counts["pos"], counts["neg"]
        label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
        return F.struct(label.alias("label"), ((F.greatest(pos, neg) + 1) / (pos + neg + 2)).alias("score"))

    return lambda sentences: F.transform(F.transform(sentences, score_one), judge)


def length_batches(lengths: list[int], budget: int, padding: float = 1.2) -> Iterator[list[int]]:
    """Places of the sentences, in batches for one model call each.

    A model fills every sentence up to the longest of its batch. Taken from long
    to short, a batch ends before its filled size exceeds ``budget`` words, or
    ``padding`` times its real size. A sentence without words counts as one.
    """
    batch, real, top = [], 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = max(lengths[i], 1)
        filled = (len(batch) + 1) * top
        if batch and (filled > budget or filled > padding * (real + size)):
            yield batch
            batch, real = [], 0
        if not batch:
            top = size
        batch.append(i)
        real += size
    if batch:
        yield batch


@dataclass(frozen=True)
class ModelScorer:
    """Scorer around a user model; ``load`` runs once per Python task.

    The model gets lists of sentences and returns one ``(label, score)`` for each;
    labels pass through ``canonical_sentiment``. Sentences of an Arrow batch are
    put together by length (see ``length_batches``), cut to ``max_words`` words,
    and their results go back to their places. The other columns pass by as
    Arrow data. No filter moves below this step, so the model sees every sentence
    exactly once.
    """

    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]
    budget: int = 16_384
    max_words: int = 256
    padding: float = 1.2

    def apply(self, df: DataFrame) -> DataFrame:
        load, limits = self.load, (self.budget, self.padding)
        longest = self.max_words
        scored_type = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                posts = batch.column(batch.schema.get_field_index("sentences")).to_pylist()
                flat = [s for sentences in posts for s in sentences]
                split = [s.split() for s in flat]
                found = [None] * len(flat)
                for batch_ in length_batches([min(len(w), longest) for w in split], *limits):
                    texts = [flat[i] if len(split[i]) <= longest else " ".join(split[i][:longest]) for i in batch_]
                    for i, result in zip(batch_, model(texts), strict=True):
                        found[i] = result
                results = iter(found)
                raw = [[dict(zip(("label", "score"), next(results))) for _ in sentences] for sentences in posts]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(raw, scored_type)], [*batch.schema.names, "_raw"])

        schema = T.StructType([*df.schema.fields, T.StructField("_raw", schemas.SCORED)])
        canonical = F.transform("_raw", lambda r: val.canonical_sentiment(r["label"], r["score"]))
        return df.mapInArrow(run, schema).withColumn("scored", canonical).drop("_raw")


def last_weight(n: Column, weights: LastWeights = LastWeights()) -> Column:
    """Weight of the last sentence of a post with ``n`` sentences."""
    value = F.when(n == 1, 1.0).when(n <= 3, weights.short).when(n <= 7, weights.medium)
    return value.otherwise(weights.long).cast(VOTE_TYPE)


def with_sentences(df: DataFrame, column: str = "text", order: str = "references_first") -> DataFrame:
    """Add ``sentences``: the last ten of the prepared text, in reading order."""
    return df.withColumn("sentences", val.let(
        tx.sentiment_prep(F.col(column), order),
        lambda text: val.let(tx.split_sentences(text), lambda parts: tx.last_n(parts, text))))


def with_scores(df: DataFrame, scorer: Scorer | ModelScorer | None = None) -> DataFrame:
    """Add ``scored``: one ``struct(label, score)`` per sentence."""
    if isinstance(scorer, ModelScorer):
        return scorer.apply(df)
    return df.withColumn("scored", (scorer or lexicon_scorer())(F.col("sentences")))


def vote_of(scored: Column, weights: LastWeights = LastWeights()) -> Column:
    """``struct(sentiment, confidence, label)`` of an array of scored sentences.

    Votes are summed as decimals, so exact ties stay exact in any order.
    """
    def cast(c: Column) -> Column:
        return c.cast(VOTE_TYPE)

    def tally(sentences: Column) -> Column:
        n = F.size(sentences)
        votes = F.transform(sentences, lambda x, i: F.struct(
            x["label"].alias("label"),
            cast(cast(x["score"]) * F.when(i == n - 1, last_weight(n, weights)).otherwise(1)).alias("vote")))
        totals = F.aggregate(
            votes, F.struct(*[cast(F.lit(0)).alias(label) for label in LABELS]),
            lambda acc, x: F.struct(*[
                cast(acc[label] + F.when(x["label"] == label, x["vote"]).otherwise(0)).alias(label) for label in LABELS]))
        strongest = F.array_max(F.transform(sentences, lambda x, i: F.struct(
            x["score"].alias("score"), (-i).alias("place"), x["label"].alias("label"))))
        return F.struct(n.alias("n"), totals.alias("votes"), strongest.alias("top"))

    return val.let(val.let(scored, tally), _decide)


def _decide(t: Column) -> Column:
    """From ``struct(n, votes, top)`` to the verdict."""
    # Struct order settles ties: equal votes fall to the label named first in LABELS.
    ranked = F.sort_array(F.array(*[
        F.struct(t["votes"][label].alias("votes"), F.lit(-i).alias("place"), F.lit(label).alias("label"))
        for i, label in enumerate(LABELS)]), asc=False)

    def measure(r: Column) -> Column:
        top = t["top"]["label"]
        backing = F.element_at(F.filter(r, lambda x: x["label"] == top), 1)["votes"]
        return F.struct(
            r[0]["label"].alias("first"), r[1]["label"].alias("second"),
            (r[0]["votes"].cast("double") / t["n"]).alias("base"),
            (r[1]["votes"].cast("double") / t["n"]).alias("second_base"),
            (r[1]["votes"] > F.lit("0.3").cast(VOTE_TYPE)).alias("second_counts"),
            ((r[0]["label"] != top) & (r[0]["votes"] - backing < F.lit("0.35").cast(VOTE_TYPE))).alias("overruled"))

    def clamp(value: Column, low: float, high: float) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), value))

    def verdict(m: Column) -> Column:
        neutral, weak = m["first"] == "neutral", m["base"] < 0.55
        swap = neutral & weak & m["second_counts"]
        return F.struct(
            F.when(m["overruled"], t["top"]["label"]).when(swap, m["second"]).otherwise(m["first"]).alias("sentiment"),
            F.when(m["overruled"], t["top"]["score"])
            .when(~neutral, clamp(m["base"], 0.65, 0.99))
            .when(swap, clamp(m["second_base"], 0.60, 0.85))
            .when(weak, clamp(m["base"], 0.45, 0.85))
            .otherwise(clamp(m["base"], 0.50, 0.85)).alias("confidence"),
            t["top"]["label"].alias("label"))

    return val.let(val.let(ranked, measure), verdict)


def _spread(df: DataFrame, keep: list[str], verdict: str = "_verdict") -> DataFrame:
    sentiment, confidence = F.col(f"{verdict}.sentiment"), F.col(f"{verdict}.confidence")
    return df.select(*keep, sentiment, val.signed_score(sentiment, confidence).alias("score"), confidence,
                     F.col(f"{verdict}.label"))


def vote(df: DataFrame, scored: str = "scored", weights: LastWeights = LastWeights()) -> DataFrame:
    """Add ``sentiment``, ``score``, ``confidence`` and ``label`` from the scored sentences."""
    return _spread(df.withColumn("_verdict", vote_of(F.col(scored), weights)), list(df.columns))


def vote_sentences(sentences: DataFrame, key: str = "doc_id", weights: LastWeights = LastWeights()) -> DataFrame:
    """The same vote for scores in long form ``(key, sent_idx, label, score)``.

    For scores that arrive as a table. Only the last ten rows of a key vote, so
    the array they meet in is that small.
    """
    gathered = rank_sentences(sentences, key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("sent_idx", "label", "score"))).alias("_rows"))
    scored = gathered.select(key, F.transform("_rows", lambda x: F.struct(
        x["label"].alias("label"), x["score"].cast("double").alias("score"))).alias("scored"))
    return vote(scored, "scored", weights).drop("scored")


def lexicon_override(df: DataFrame, text: Column, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Flip a confident verdict that the last sentence clearly contradicts (off by default)."""
    counted = df.withColumn("_lex", lexicon_counts(text, lexicon))
    pos, neg, sure = F.col("_lex.pos"), F.col("_lex.neg"), F.col("confidence") >= 0.75
    to_positive = (F.col("sentiment") == "negative") & (pos >= 2) & (neg == 0) & sure
    to_negative = (F.col("sentiment") == "positive") & (neg >= 2) & (pos == 0) & sure
    lowered = F.greatest(F.lit(0.6), F.least(F.lit(0.85), F.col("confidence") - 0.05))
    # Both right-hand sides see the verdict before the flip.
    flipped = counted.withColumns({
        "sentiment": F.when(to_positive, "positive").when(to_negative, "negative").otherwise(F.col("sentiment")),
        "confidence": F.when(to_positive | to_negative, lowered).otherwise(F.col("confidence")),
    })
    return flipped.withColumn("score", val.signed_score(F.col("sentiment"), F.col("confidence"))).drop("_lex")


def analyse_sentiment(df: DataFrame, column: str = "text", scorer: Scorer | ModelScorer | None = None,
                      override: Lexicon | None = None, order: str = "references_first",
                      weights: LastWeights = LastWeights()) -> DataFrame:
    """Text to sentiment: prepare, split, score the last ten sentences, vote.

    Adds ``sentiment``, ``score``, ``confidence``, ``label`` and ``error``. A row
    without text gets neutral at 0 and an error text instead of failing the job.
    """
    scored = with_scores(with_sentences(df, column, order), scorer)
    voted = vote(scored, "scored", weights)
    if override is not None:
        voted = lexicon_override(voted, F.element_at("sentences", -1), override)
    missing = F.col(column).isNull()
    return voted.withColumns({
        "sentiment": F.when(missing, "neutral").otherwise(F.col("sentiment")),
        "score": F.when(missing, 0.0).otherwise(F.col("score")),
        "confidence": F.when(missing, 0.0).otherwise(F.col("confidence")),
        "label": F.when(~missing, F.col("label")),
        "error": F.when(missing, "text is missing"),
    }).drop("sentences", "scored")


def verdicts(df: DataFrame, scorers: dict[str, Scorer], column: str = "text", order: str = "references_first",
             weights: LastWeights = LastWeights()) -> DataFrame:
    """Add ``verdicts``: the sentiment under each of several scorers, whose sentences are split once."""
    def judged(sentences: Column) -> Column:
        return F.struct(*[vote_of(scorer(sentences), weights)["sentiment"].alias(name) for name, scorer in scorers.items()])

    split = tx.sentiment_prep(F.col(column), order)
    return df.withColumn("verdicts", val.let(
        val.let(split, lambda text: val.let(tx.split_sentences(text), lambda parts: tx.last_n(parts, text))), judged))
