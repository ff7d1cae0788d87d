import pytest
from pyspark.sql import functions as F

from postlens.operators import evaluate, scoring, summary

# Published evaluation: rows are gold 0, 1, 2 and columns predicted 0, 1, 2.
CELLS = [[8, 10, 7], [3, 28, 2], [6, 18, 28]]


@pytest.fixture(scope="module")
def published(spark):
    rows = [(g, p) for g in range(3) for p in range(3) for _ in range(CELLS[g][p])]
    return spark.createDataFrame([(i, str(g), p) for i, (g, p) in enumerate(rows)], "id int, RDuygu string, Tduygu int")


def test_published_sentiment_metrics(published):
    frame = evaluate.prepare(published)
    acc = evaluate.accuracy(frame).first()
    assert (acc["total"], acc["correct"], round(acc["accuracy"], 4)) == (110, 64, 0.5818)
    matrix = {r["gold"]: [r["pred_0"], r["pred_1"], r["pred_2"]] for r in evaluate.confusion_matrix(frame, [0, 1, 2]).collect()}
    assert matrix == dict(enumerate(CELLS))
    report = {r["label"]: tuple(round(r[x], 2) for x in ("precision", "recall", "f1")) + (r["support"],)
              for r in evaluate.class_report(frame, [0, 1, 2]).collect()}
    assert report == {0: (.47, .32, .38, 25), 1: (.50, .85, .63, 33), 2: (.76, .54, .63, 52)}
    means = {r["average"]: tuple(round(r[x], 2) for x in ("precision", "recall", "f1"))
             for r in evaluate.report_averages(evaluate.class_report(frame, [0, 1, 2])).collect()}
    assert means == {"macro": (.58, .57, .55), "weighted": (.61, .58, .57)}


def test_published_category_metrics(spark):
    # (gold, predicted, rows): the published gold and predicted counts per category.
    pairs = [
        ("Kultur", "Kültür", 47), ("Kultur", "Sağlık", 13), ("Kultur", "Dünya", 12), ("Kultur", "Teknoloji", 12),
        ("Teknoloji", "Teknoloji", 16), ("Teknoloji", "Siyaset", 1), ("siyaset", "Siyaset", 1), ("siyaset", "Ekonomi", 3),
        ("siyaset", "Teknoloji", 1), ("siyaset", "Sağlık", 1), ("saglik", "Siyaset", 1), ("Dunya", "Dünya", 1),
        ("ekonomi", "Ekonomi", 1),
    ]
    df = spark.createDataFrame([(g, p) for g, p, n in pairs for _ in range(n)], "Rkategori string, Tkategori string")
    frame = evaluate.prepare_categories(df, mode="plain")
    acc = evaluate.accuracy(frame).first()
    assert (acc["total"], acc["correct"], acc["accuracy"]) == (110, 66, 0.6)
    report = evaluate.class_report(frame)
    rows = {r["label"]: tuple(round(r[x], 2) for x in ("precision", "recall", "f1")) + (r["support"],) for r in report.collect()}
    assert rows == {
        "dunya": (.08, 1.0, .14, 1), "ekonomi": (.25, 1.0, .40, 1), "kultur": (1.0, .56, .72, 84), "saglik": (0, 0, 0, 1),
        "saglk": (0, 0, 0, 0), "siyaset": (.33, .17, .22, 6), "teknoloji": (.55, .94, .70, 17)}
    means = {r["average"]: tuple(round(r[x], 2) for x in ("precision", "recall", "f1")) for r in evaluate.report_averages(report).collect()}
    assert means == {"macro": (.32, .52, .31), "weighted": (.87, .60, .67)}
    turkish = evaluate.class_report(evaluate.prepare_categories(df))
    assert {r["label"] for r in turkish.collect()} == {"kultur", "teknoloji", "siyaset", "dunya", "ekonomi", "saglik"}


def test_empty_and_missing_cells(spark):
    empty = spark.createDataFrame([], "gold int, pred int")
    assert evaluate.accuracy(empty).first()["accuracy"] is None
    only = spark.createDataFrame([(0, 0)], "gold int, pred int")
    assert [tuple(r) for r in evaluate.confusion_matrix(only, [0, 1]).collect()] == [(0, 1, 0), (1, 0, 0)]
    assert {r["label"]: r["f1"] for r in evaluate.class_report(only, [0, 1]).collect()} == {0: 1.0, 1: 0.0}


def test_errors_count_nulls(spark):
    df = spark.createDataFrame([(1, "a", 0, 0), (2, "b", 0, 1), (3, "c", None, None), (4, "d", 0, 1)], "id int, body string, gold int, pred int")
    got = [(r["gold"], r["pred"], r["n"], r["rate"]) for r in evaluate.error_types(df).collect()]
    assert got == [(0, 1, 2, .5), (None, None, 1, .25)]
    assert [r["id"] for r in evaluate.sample_errors(df, "id").collect()] == [2, 3, 4]
    assert evaluate.sample_correct(df, "id").first()["preview"] == "a..."


def test_model_comparison(spark):
    gold = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "id int, gold int")
    preds = spark.createDataFrame([("a", 1, "positive"), ("a", 2, "negative"), ("b", 1, "negative")], "model string, id int, sentiment string")
    rows = [tuple(r) for r in evaluate.compare_models(preds, gold, ["a", "b", "c"]).collect()]
    assert rows == [("a", 1.0, 3, 3), ("b", pytest.approx(1 / 3), 1, 3), ("c", 0.0, 0, 3)]


def test_raw_comparison(spark):
    df = spark.createDataFrame([("0", 0), ("olumsuz", 0)], "RDuygu string, Tduygu int")
    assert evaluate.accuracy(evaluate.prepare(df)).first()["correct"] == 2
    raw = evaluate.prepare(df.withColumn("Tduygu", F.col("Tduygu").cast("string")), normalize_gold=False)
    assert evaluate.accuracy(raw).first()["correct"] == 1


def test_value_counts_and_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("", 3)], "s string, n int")
    assert [tuple(r) for r in summary.value_counts(df, "s").collect()] == [("a", 2, 50.0), ("", 1, 25.0)]
    assert [tuple(r) for r in summary.profile(df).collect()] == [("s", "string", 4, 1, 1), ("n", "int", 4, 1, 0)]


def test_metric_lines_render(published):
    lines = evaluate.metric_lines(evaluate.prepare(published), [0, 1, 2])
    text = [r[0] for r in evaluate.render_metrics(lines).collect()]
    assert "accuracy accuracy 0.5818" in text and "confusion pred_1 1 28.0000" in text


def test_one_pass_compares_models_as_separate_passes_do(spark):
    texts = [(i, t) for i, t in enumerate(["Harika film. Rezalet son.", "Rezalet.", "Harika. Harika.", "", None, "düz cümle"] * 5)]
    docs = spark.createDataFrame(texts, "id int, text string")
    gold = spark.createDataFrame([(i, i % 3) for i in range(28)], "id int, gold int")
    lexicons = {"a": scoring.Lexicon(["harika"], ["rezalet"]), "b": scoring.Lexicon(["rezalet"], ["harika"])}
    side = scoring.verdicts(docs.where("text is not null"), {n: scoring.lexicon_scorer(x) for n, x in lexicons.items()})
    parts = [scoring.analyse_sentiment(docs.where("text is not null"), "text", scoring.lexicon_scorer(x)).selectExpr(f"'{n}' AS model", "id", "sentiment")
             for n, x in lexicons.items()]
    long = evaluate.compare_models(parts[0].unionByName(parts[1]), gold, ["a", "b", "none"])
    wide = evaluate.compare_columns(side, gold, {"a": side["verdicts.a"], "b": side["verdicts.b"], "none": None})
    assert [tuple(r) for r in wide.collect()] == [tuple(r) for r in long.collect()]


def test_predictions_are_scored_once(spark, tmp_path):
    """The vote stands in no plan of a metric: its narrow rows were stored before."""
    from postlens.plans import evaluation
    plan = evaluation.accuracy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("Relation") == 2
