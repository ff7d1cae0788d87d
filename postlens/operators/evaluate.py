"""Predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import text as tx
from postlens.functions import values as val


def prepare(df: DataFrame, gold: str = "RDuygu", pred: str = "Tduygu", numeric_gold: bool = False,
            normalize_gold: bool = True) -> DataFrame:
    """Add ``gold`` and ``pred`` as codes and keep rows where both are 0, 1 or 2.

    Without ``normalize_gold`` the raw values are compared as they are.
    """
    if not normalize_gold:
        return df.withColumns({"gold": F.col(gold), "pred": F.col(pred)}).where(F.col("pred").isNotNull())
    coded = df.withColumns({
        "gold": val.gold_code(F.col(gold), numeric_gold), "pred": F.col(pred).try_cast("int")})
    return coded.where(F.col("gold").isin(0, 1, 2) & F.col("pred").isin(0, 1, 2))


def prepare_categories(df: DataFrame, gold: str = "Rkategori", pred: str = "Tkategori",
                       mode: str = "turkish") -> DataFrame:
    """Add folded ``gold`` and ``pred`` categories; rows lacking either are left out."""
    known = df.where((F.coalesce(F.col(gold), F.lit("")) != "") & (F.coalesce(F.col(pred), F.lit("")) != ""))
    return known.withColumns({"gold": tx.fold_label(F.col(gold), mode), "pred": tx.fold_label(F.col(pred), mode)})


def pair_counts(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``(gold, pred, n)``: all that the metrics below need, a handful of rows.

    Pass it on with ``weight="n"`` so that the predictions are read only once.
    """
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def _rows(condition: Column, weight: str | None) -> Column:
    """Number of rows that fulfil a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col(weight) if weight else F.lit(1))), F.lit(0))


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """``(total, correct, accuracy)``; accuracy of no rows is null."""
    hit = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    return (df.agg(_rows(F.lit(True), weight).alias("total"), _rows(hit, weight).alias("correct"))
            .withColumn("accuracy", F.col("correct") / F.nullif(F.col("total"), F.lit(0))))


def confusion_matrix(df: DataFrame, labels: list, gold: str = "gold", pred: str = "pred",
                     weight: str | None = None) -> DataFrame:
    """One row per gold label with a ``pred_<label>`` column each, empty cells included.

    All cells come from one aggregation without a group key.
    """
    cells = df.agg(*[_rows((F.col(gold) == g) & (F.col(pred) == p), weight).alias(f"_{i}_{j}")
                     for i, g in enumerate(labels) for j, p in enumerate(labels)])
    rows = F.array(*[
        F.struct(F.lit(g).alias("gold"), *[F.col(f"_{i}_{j}").alias(f"pred_{p}") for j, p in enumerate(labels)])
        for i, g in enumerate(labels)])
    return cells.select(F.inline(rows))


def class_report(df: DataFrame, labels: list | None = None, gold: str = "gold", pred: str = "pred",
                 weight: str | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support)``; a zero denominator gives 0.

    Without ``labels`` the union of gold and predicted values is reported. Each
    row adds one fact per side, so a single aggregation by label is enough.
    """
    hit = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    n = (F.col(weight) if weight else F.lit(1)).cast("bigint")
    none = F.lit(0).cast("bigint")
    facts = F.array(
        F.struct(F.col(gold).alias("label"), n.alias("gold"), none.alias("pred"), F.when(hit, n).otherwise(none).alias("hit")),
        F.struct(F.col(pred).alias("label"), none.alias("gold"), n.alias("pred"), none.alias("hit")))
    rows = df.select(F.inline(facts))
    if labels is not None:
        rows = rows.where(F.col("label").isin(list(labels)))
        grid = df.sparkSession.createDataFrame([(x,) for x in labels], rows.select("label").schema)
        rows = rows.unionByName(grid.withColumns({"gold": none, "pred": none, "hit": none}))
    sums = rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("gold", "pred", "hit")])

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return sums.select(
        "label", ratio(F.col("hit"), F.col("pred")).alias("precision"),
        ratio(F.col("hit"), F.col("gold")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("pred") + F.col("gold")).alias("f1"),
        F.col("gold").alias("support"))


def report_averages(report: DataFrame) -> DataFrame:
    """``macro`` (plain mean over labels) and ``weighted`` (by support) averages of a class report."""
    parts = ["precision", "recall", "f1"]
    support = F.sum("support")
    sums = report.agg(
        *[F.avg(p).alias(f"macro_{p}") for p in parts],
        *[F.coalesce(F.sum(F.col(p) * F.col("support")) / F.nullif(support, F.lit(0)), F.lit(0.0)).alias(f"weighted_{p}")
          for p in parts],
        support.alias("support"))
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("average"), *[F.col(f"{kind}_{p}").alias(p) for p in parts],
                 F.col("support").alias("support")) for kind in ("macro", "weighted")])))


def is_error(gold: str = "gold", pred: str = "pred"):
    """Wrong or missing: two nulls do not match either."""
    return ~F.coalesce(F.col(gold) == F.col(pred), F.lit(False))


def error_types(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Wrong pairs with their count and share of all rows, most frequent first."""
    total = df.agg(F.count("*")).scalar()
    wrong = df.where(is_error(gold, pred)).groupBy(gold, pred).agg(F.count("*").alias("n"))
    return wrong.withColumn("rate", F.col("n") / total).orderBy(F.col("n").desc(), gold, pred)


def sample_errors(df: DataFrame, id_column: str, k: int = 10, column: str = "body",
                  gold: str = "gold", pred: str = "pred") -> DataFrame:
    """First ``k`` wrong rows in id order with a preview."""
    return (df.where(is_error(gold, pred)).orderBy(id_column).limit(k)
            .select(id_column, gold, pred, tx.preview(F.col(column), always=True).alias("preview")))


def sample_correct(df: DataFrame, id_column: str, k: int = 5, column: str = "body",
                   gold: str = "gold", pred: str = "pred") -> DataFrame:
    return (df.where(~is_error(gold, pred)).orderBy(id_column).limit(k)
            .select(id_column, gold, tx.preview(F.col(column), always=True).alias("preview")))


def crosstab(df: DataFrame, row: str, column: str, columns: list) -> DataFrame:
    """Counts of ``row`` by the given values of ``column`` (named up front, so no extra job)."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.count(F.lit(1))).na.fill(0)


def compare_models(predictions: DataFrame, gold: DataFrame, models: list[str], key: str = "id") -> DataFrame:
    """``(model, accuracy, correct, total)``, best first.

    ``predictions`` is ``(model, key, sentiment)``; a missing prediction counts as
    neutral and a model without any prediction scores 0.
    """
    wide = predictions.groupBy(key).agg(*[
        F.max(F.when(F.col("model") == m, F.col("sentiment"))).alias(f"_p{i}") for i, m in enumerate(models)])
    return compare_columns(wide, gold, {m: F.col(f"_p{i}") for i, m in enumerate(models)}, key)


def compare_columns(predictions: DataFrame, gold: DataFrame, models: dict[str, Column | None], key: str = "id") -> DataFrame:
    """``compare_models`` for predictions that stand side by side: one column of sentiments per model, none for a failed one."""
    coded = predictions.select(key, *[
        (F.lit(None).cast("int") if column is None else F.when(column.isNotNull(), val.sentiment_code(column))).alias(f"_m{i}") for i, column in enumerate(models.values())])
    joined = gold.select(key, F.col("gold").alias("_gold")).join(coded, key, "left")
    sums = joined.agg(
        F.count("*").alias("_total"),
        *[F.count(f"_m{i}").alias(f"_seen{i}") for i in range(len(models))],
        *[F.count_if(F.col("_gold") == F.coalesce(f"_m{i}", F.lit(1))).alias(f"_hit{i}") for i in range(len(models))])
    rows = F.array(*[F.struct(
        F.lit(m).alias("model"),
        F.when(F.col(f"_seen{i}") > 0, F.col(f"_hit{i}")).otherwise(0).alias("correct"),
        F.col("_total").alias("total")) for i, m in enumerate(models)])
    return (sums.select(F.inline(rows))
            .select("model", (F.col("correct") / F.nullif(F.col("total"), F.lit(0))).alias("accuracy"), "correct", "total")
            .orderBy(F.col("accuracy").desc(), "model"))


def metric_lines(df: DataFrame, labels: list) -> DataFrame:
    """All metrics as one long table ``(section, metric, label, value)``."""
    def line(section, metric, label, value):
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        label.cast("string").alias("label"), value.cast("double").alias("value"))

    none = F.lit(None)
    # The same small aggregation feeds every section; Spark computes it once and reuses it.
    pairs = pair_counts(df)
    acc = accuracy(pairs, weight="n").select(F.inline(F.array(*[
        line("accuracy", m, none, F.col(m)) for m in ("total", "correct", "accuracy")])))
    report = class_report(pairs, labels, weight="n")
    per_class = report.select(F.inline(F.array(*[
        line("class", m, F.col("label"), F.col(m)) for m in ("precision", "recall", "f1", "support")])))
    means = report_averages(report).select(F.inline(F.array(*[
        line("average", m, F.col("average"), F.col(m)) for m in ("precision", "recall", "f1")])))
    cells = confusion_matrix(pairs, labels, weight="n").select(F.inline(F.array(*[
        line("confusion", f"pred_{p}", F.col("gold"), F.col(f"pred_{p}")) for p in labels])))
    return acc.unionByName(per_class).unionByName(means).unionByName(cells)


def render_metrics(lines: DataFrame) -> DataFrame:
    """One text line per metric, ready for a text sink."""
    text = F.concat_ws(" ", "section", "metric", "label", F.format_string("%.4f", "value"))
    return lines.orderBy("section", "label", "metric").select(text.alias("value"))
