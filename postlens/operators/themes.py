"""Theme scores, the top-three rule and the trainable theme model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.functions import text as tx
from postlens.functions import values as val
from postlens.operators.keywords import with_keywords
from postlens.operators.ranking import top_themes


def theme_result(df: DataFrame, scores: str = "theme_scores", threshold: float = 0.15, k: int = 3,
                 round_scores: bool = True) -> DataFrame:
    """Add ``themes``, ``main_topic``, ``scores``, ``is_ambiguous``, ``threshold_used`` and ``error``.

    Two themes are ambiguous when their rounded scores differ by less than 0.1;
    the comparison is done in decimals so that exactly 0.10 is not ambiguous.
    A row without scores gets the general theme and an error text.
    """
    usable = F.coalesce(F.size(scores), F.lit(0)) > 0
    named = F.transform(top_themes(F.col(scores), threshold, k), lambda x: F.struct(
        val.theme_label(x["label"]).alias("label"),
        (val.round2(x["score"]) if round_scores else x["score"]).alias("score")))
    labels = F.transform("_themes", lambda x: x["label"])
    cents = F.transform("_themes", lambda x: x["score"].cast("decimal(4,2)"))
    close = F.get(cents, F.lit(0)) - F.get(cents, F.lit(1)) < F.lit("0.10").cast("decimal(4,2)")
    return df.withColumn("_themes", F.when(usable, named)).withColumns({
        "themes": F.coalesce(labels, F.array(F.lit(fixed.FALLBACK_THEME))),
        "main_topic": F.coalesce(F.col("_themes")[0]["label"], F.lit(fixed.FALLBACK_THEME)),
        "scores": F.coalesce(F.map_from_entries("_themes"), F.create_map().cast("map<string,double>")),
        "is_ambiguous": F.coalesce(close, F.lit(False)),
        "threshold_used": F.when(usable, F.lit(threshold)),
        "error": F.when(~usable, "no theme scores"),
    }).drop("_themes")


def vocabulary_scores(col: Column, vocabularies: dict[str, list[str]]) -> Column:
    """Theme scores from word lists: each list's share of all listed words in the text."""

    def count_in(words: Column, vocabulary: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(list(vocabulary))))

    def hits(words: Column) -> Column:
        return F.array(*[count_in(words, v) for v in vocabularies.values()])

    def shares(found: Column) -> Column:
        total = F.nullif(F.aggregate(found, F.lit(0), lambda a, b: a + b), F.lit(0))
        return F.array(*[F.struct(F.lit(name).alias("label"), F.coalesce(found[i] / total, F.lit(0.0)).alias("score"))
                         for i, name in enumerate(vocabularies)])

    return val.let(val.let(tx.word_tokens(col), hits), shares)


def train_theme_model(labelled: DataFrame, column: str = "text", label: str = "theme",
                      features: int = 1 << 16, iterations: int = 30) -> PipelineModel:
    """Multinomial theme classifier on hashed TF-IDF words."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=column, outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_y", probabilityCol="_probability",
                           predictionCol="_prediction", family="multinomial", maxIter=iterations),
        IndexToString(inputCol="_prediction", outputCol="_label"),
    ]).fit(labelled)


def score_themes(df: DataFrame, model: PipelineModel, column: str = "text") -> DataFrame:
    """Add ``theme_scores``: the model's probability for every theme."""
    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[1:-1]).transform(df)
    p = vector_to_array("_probability")
    entries = F.array(*[F.struct(F.lit(name).alias("label"), p[i].alias("score")) for i, name in enumerate(labels)])
    return scored.withColumn("theme_scores", entries).select(*df.columns, "theme_scores")


def analyse_theme(df: DataFrame, column: str = "text", scores: str = "theme_scores", n_keywords: int = 8,
                  threshold: float = 0.15, stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """Theme result plus keywords for rows that already carry theme scores."""
    themed = with_keywords(theme_result(df, scores, threshold), column, n_keywords, stop_words)
    return themed.withColumn("keywords", F.transform("keywords", lambda k: k["word"]))
