"""Queries on predictions, samples and table profiles.

Gold is the supplied ``quality`` (0 or 1), the prediction is the vote of the document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import values as val
from postlens.operators import evaluate, ranking, scoring, summary, themes
from postlens.plans import common as c
from postlens.plans.cleaning import HTML_TEXT, sql_labelling
from postlens.plans.common import OTHER_LEXICONS, VOCABULARIES, Query, table
from postlens.plans.opinion import _TOP3
from postlens.session import materialize, scratch_path
from postlens.sources import posts


def _frame(spark, folder, text: bool = False):
    """Predictions beside gold; only labelled documents are scored."""
    gold = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("RDuygu"))
    pred = c.document_sentiment(spark, folder, among=gold).select("doc_id", val.sentiment_code(F.col("sentiment")).alias("Tduygu"))
    # Stored as narrow rows: a filter on the prediction would otherwise move below the scoring and run it again.
    pred = materialize(pred, "predictions")
    frame = evaluate.prepare(gold.join(pred, "doc_id"), numeric_gold=True)
    return frame.join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id") if text else frame


def accuracy(spark, folder):
    return evaluate.accuracy(_frame(spark, folder))


def confusion(spark, folder):
    return evaluate.confusion_matrix(_frame(spark, folder), [0, 1, 2])


def class_report(spark, folder):
    return evaluate.class_report(evaluate.pair_counts(_frame(spark, folder)), [0, 1, 2], weight="n")


def macro_weighted(spark, folder):
    return evaluate.report_averages(evaluate.class_report(_frame(spark, folder), [0, 1, 2]))


def error_types(spark, folder):
    return evaluate.error_types(_frame(spark, folder))


def sample_errors(spark, folder):
    return evaluate.sample_errors(_frame(spark, folder, text=True), "doc_id", column="text")


def sample_correct(spark, folder):
    return evaluate.sample_correct(_frame(spark, folder, text=True), "doc_id", column="text")


def crosstab(spark, folder):
    return evaluate.crosstab(_frame(spark, folder), "gold", "pred", [0, 1, 2]).select(
        "gold", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"), F.col("2").alias("pred_2"))


def metric_lines(spark, folder):
    return evaluate.metric_lines(_frame(spark, folder), [0, 1, 2]).withColumn("value", F.round("value", 6))


def metrics_stored(spark, folder):
    """The metric table written and read back."""
    path = scratch_path(spark, "metrics")
    posts.write_metrics(evaluate.metric_lines(_frame(spark, folder), [0, 1, 2]), path)
    return posts.read_metrics(spark, path).withColumn("value", F.round("value", 6))


def compare_models(spark, folder):
    gold = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("gold"))
    scored = scoring.verdicts(c.documents(spark, folder, gold), {n: scoring.lexicon_scorer(x) for n, x in OTHER_LEXICONS.items()})
    return evaluate.compare_columns(scored, gold, {**{n: F.col("verdicts")[n] for n in OTHER_LEXICONS}, "absent": None}, "doc_id")


def _categories(spark, folder):
    docs = c.analysable_documents(spark, folder)
    scored = docs.withColumn("theme_scores", themes.vocabulary_scores(F.col("text"), VOCABULARIES))
    themed = themes.theme_result(scored, round_scores=False)
    return evaluate.prepare_categories(themed, "lang", "main_topic")


def category_accuracy(spark, folder):
    return evaluate.accuracy(_categories(spark, folder))


def category_report(spark, folder):
    return evaluate.class_report(_categories(spark, folder))


def value_counts_pct(spark, folder):
    return summary.value_counts(table(spark, folder, "documents"), "source")


def top_values(spark, folder):
    return summary.top_values(table(spark, folder, "documents"), "source")


def profile(spark, folder):
    return summary.profile(table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left"))


def stratified_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return ranking.stratified_sample(docs, "lang", "doc_id", 20)


def large_sample(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return ranking.stratified_sample(lines, "l_returnflag", "id", 2000, seed=7)


def shuffled(spark, folder):
    return ranking.rank_within(table(spark, folder, "labels").select("doc_id"), [],
                               [ranking.seeded_order("doc_id"), "doc_id"], "position")


def union_parts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return posts.union_parts(*[docs.where(F.col("lang") == x) for x in VOCABULARIES])


def predictions_stored(spark, folder):
    path = scratch_path(spark, "predictions")
    posts.write_predictions(_frame(spark, folder).select("doc_id", "RDuygu", "Tduygu"), path)
    return spark.read.parquet(path)


def labelled_sheet(spark, folder):
    path = scratch_path(spark, "labelled") + ".csv"
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    sheet = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("quality").cast("string").alias("RDuygu"),
                        F.col("lang").alias("Rkategori"))
    posts.write_predictions(sheet, path)
    return posts.read_labelled(spark, path).select("id", F.md5("body").alias("digest"), "RDuygu", "Rkategori")


def labelling_file(spark, folder):
    path = scratch_path(spark, "for-labelling")
    posts.write_for_labelling(table(spark, folder, "pages"), path, "html")
    rows = spark.read.csv(path, schema="body string, sentiment string", header=True, escape='"')
    return rows.select(F.md5("body").alias("digest"), F.length("body").alias("n"))


_FRAME = f"""{c.sql_sentiment()}, frame AS (
  SELECT doc_id, quality AS gold, CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END AS pred, text
  FROM labels JOIN voted USING (doc_id) JOIN documents USING (doc_id))"""
_REPORT = f"""{_FRAME}, grid AS (SELECT unnest([0, 1, 2]) AS label),
sums AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS pp,
  count(*) FILTER (gold = label) AS support FROM grid CROSS JOIN frame GROUP BY label),
report AS (SELECT label, coalesce(tp / nullif(pp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall,
  coalesce(2 * tp / nullif(pp + support, 0), 0)::DOUBLE AS f1, support FROM sums)"""
_AVG = """means AS (SELECT 'macro' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support) AS support FROM report
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM report)"""


def _model_sql():
    ctes, picks = [], []
    for name, lexicon in OTHER_LEXICONS.items():
        ctes.append(c.sql_scored(lexicon).replace("hits AS", f"hits_{name} AS").replace("FROM hits)", f"FROM hits_{name})")
                    .replace("scored AS", f"scored_{name} AS") + "," + c.sql_vote(cte=f"scored_{name}", out=f"v_{name}"))
        picks.append(f"SELECT '{name}' AS model, doc_id, sentiment FROM v_{name}")
    return f"""WITH {c.sql_sentences()}, {', '.join(ctes)}, preds AS ({' UNION ALL '.join(picks)}),
marks AS (SELECT model, quality AS gold, CASE sentiment WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END AS pred
  FROM labels JOIN preds USING (doc_id)),
rows AS (SELECT model, count(*) FILTER (gold = pred) AS correct, count(*) AS total FROM marks GROUP BY model)
SELECT model, correct / total AS accuracy, correct, total FROM rows
UNION ALL SELECT 'absent', 0.0, 0, count(*) FROM labels"""


_CATS = f"""{_TOP3}, cats AS (SELECT lang AS gold, main_topic AS pred FROM result JOIN documents USING (doc_id)),
folded AS (SELECT lower(gold) AS gold, lower(pred) AS pred FROM cats)"""

_METRICS = f"""
WITH {_REPORT}, {_AVG},
a AS (SELECT count(*)::DOUBLE AS total, (count(*) FILTER (gold = pred))::DOUBLE AS correct, avg((gold = pred)::INT) AS accuracy FROM frame),
cells AS (SELECT g, p, count(*) FILTER (gold = g AND pred = p) AS n FROM frame
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS g) CROSS JOIN (SELECT unnest([0, 1, 2]) AS p) GROUP BY g, p),
rows AS (
  SELECT 'accuracy' AS section, metric, NULL AS label, value FROM (UNPIVOT a ON total, correct, accuracy INTO NAME metric VALUE value)
  UNION ALL SELECT 'class', metric, label::VARCHAR, value FROM (UNPIVOT (SELECT label, precision, recall, f1, support::DOUBLE AS support FROM report)
    ON precision, recall, f1, support INTO NAME metric VALUE value)
  UNION ALL SELECT 'average', metric, average, value FROM (UNPIVOT (SELECT average, precision, recall, f1 FROM means)
    ON precision, recall, f1 INTO NAME metric VALUE value)
  UNION ALL SELECT 'confusion', 'pred_' || p, g::VARCHAR, n FROM cells)
SELECT section, metric, label, round(value, 6) AS value FROM rows"""

QUERIES = {
    "accuracy": Query(accuracy, f"""
WITH {_FRAME} SELECT count(*) AS total, count(*) FILTER (gold = pred) AS correct, avg((gold = pred)::INT) AS accuracy FROM frame"""),
    "confusion": Query(confusion, f"""
WITH {_FRAME} SELECT g AS gold, count(*) FILTER (gold = g AND pred = 0) AS pred_0, count(*) FILTER (gold = g AND pred = 1) AS pred_1,
  count(*) FILTER (gold = g AND pred = 2) AS pred_2 FROM frame CROSS JOIN (SELECT unnest([0, 1, 2]) AS g) GROUP BY g"""),
    "class_report": Query(class_report, f"WITH {_REPORT} SELECT * FROM report"),
    "macro_weighted": Query(macro_weighted, f"WITH {_REPORT}, {_AVG} SELECT * FROM means"),
    "error_types": Query(error_types, f"""
WITH {_FRAME} SELECT gold, pred, count(*) AS n, count(*) / (SELECT count(*) FROM frame) AS rate FROM frame
WHERE gold <> pred GROUP BY gold, pred"""),
    "sample_errors": Query(sample_errors, f"""
WITH {_FRAME} SELECT doc_id, gold, pred, text[1:100] || '...' AS preview FROM frame WHERE gold <> pred ORDER BY doc_id LIMIT 10"""),
    "sample_correct": Query(sample_correct, f"""
WITH {_FRAME} SELECT doc_id, gold, text[1:100] || '...' AS preview FROM frame WHERE gold = pred ORDER BY doc_id LIMIT 5"""),
    "crosstab": Query(crosstab, f"""
WITH {_FRAME} SELECT gold, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1,
  count(*) FILTER (pred = 2) AS pred_2 FROM frame GROUP BY gold"""),
    "metric_lines": Query(metric_lines, _METRICS),
    "metrics_stored": Query(metrics_stored, _METRICS),
    "compare_models": Query(compare_models, _model_sql()),
    "category_accuracy": Query(category_accuracy, f"""
WITH {_CATS} SELECT count(*) AS total, count(*) FILTER (gold = pred) AS correct, avg((gold = pred)::INT) AS accuracy FROM folded"""),
    "category_report": Query(category_report, f"""
WITH {_CATS}, grid AS (SELECT gold AS label FROM folded UNION SELECT pred FROM folded),
sums AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS pp,
  count(*) FILTER (gold = label) AS support FROM grid CROSS JOIN folded GROUP BY label)
SELECT label, coalesce(tp / nullif(pp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall,
  coalesce(2 * tp / nullif(pp + support, 0), 0)::DOUBLE AS f1, support FROM sums"""),
    "value_counts_pct": Query(value_counts_pct, """
SELECT source, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents) AS pct FROM documents GROUP BY source"""),
    "top_values": Query(top_values, """
SELECT source, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents) AS pct FROM documents
GROUP BY source ORDER BY n DESC, source LIMIT 7"""),
    "profile": Query(profile, """
WITH j AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'doc_id' AS "column", 'bigint' AS type, count(*) AS rows, count(*) FILTER (doc_id IS NULL) AS nulls, 0 AS empties FROM j
UNION ALL SELECT 'text', 'string', count(*), count(*) FILTER (text IS NULL), count(*) FILTER (text = '') FROM j
UNION ALL SELECT 'lang', 'string', count(*), count(*) FILTER (lang IS NULL), count(*) FILTER (lang = '') FROM j
UNION ALL SELECT 'source', 'string', count(*), count(*) FILTER (source IS NULL), count(*) FILTER (source = '') FROM j
UNION ALL SELECT 'n_chars', 'bigint', count(*), count(*) FILTER (n_chars IS NULL), 0 FROM j
UNION ALL SELECT 'quality', 'int', count(*), count(*) FILTER (quality IS NULL), 0 FROM j
UNION ALL SELECT 'toxic', 'int', count(*), count(*) FILTER (toxic IS NULL), 0 FROM j"""),
    "stratified_sample": Query(stratified_sample, """
SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) <= 20"""),
    "large_sample": Query(large_sample, """
WITH l AS (SELECT l_returnflag, l_orderkey || '-' || l_linenumber AS id FROM lineitem)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('7-' || id), id) <= 2000"""),
    "shuffled": Query(shuffled, "SELECT doc_id, row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) AS position FROM labels"),
    "union_parts": Query(union_parts, "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')"),
    "predictions_stored": Query(predictions_stored, f'WITH {_FRAME} SELECT doc_id, gold AS "RDuygu", pred AS "Tduygu" FROM frame'),
    "labelled_sheet": Query(labelled_sheet, """
SELECT doc_id AS id, md5(text) AS digest, quality::VARCHAR AS "RDuygu", lang AS "Rkategori" FROM documents JOIN labels USING (doc_id)"""),
    "labelling_file": Query(labelling_file, f"""
WITH b AS (SELECT {sql_labelling(HTML_TEXT)} AS body FROM pages) SELECT md5(body) AS digest, length(body) AS n FROM b WHERE length(body) > 10"""),
}
