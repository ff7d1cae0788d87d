import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import filters, ranking, scoring, search, summary, themes

SCORED = "id int, scored array<struct<label:string,score:double>>"


def _rows(count=1500):
    rng = random.Random(11)
    return [(i, [(rng.choice(scoring.LABELS), rng.choice([rng.randint(300, 999), 500, 600, 350]))
                 for _ in range(rng.randint(1, 10))]) for i in range(count)]


def test_vote_properties(spark):
    rows = _rows(600)
    other = {"positive": "negative", "negative": "positive", "neutral": "neutral"}
    df = spark.createDataFrame([(i, [(a, m / 1000) for a, m in r]) for i, r in rows], SCORED)
    mirrored = spark.createDataFrame([(i, [(other[a], m / 1000) for a, m in r]) for i, r in rows], SCORED)
    got = {r["id"]: r for r in scoring.vote(df).collect()}
    mirror = {r["id"]: r for r in scoring.vote(mirrored).collect()}
    for i, r in rows:
        found, strongest = got[i], max(m for _, m in r) / 1000
        low, high = (.45, .85) if found["sentiment"] == "neutral" else (.6, .99)
        assert low <= found["confidence"] <= high or found["confidence"] == pytest.approx(strongest)
        sign = {"positive": 1, "negative": -1, "neutral": 0}[found["sentiment"]]
        assert found["score"] == pytest.approx(sign * found["confidence"], abs=1e-9)
        if len({a for a, _ in r}) == 1 and r[0][0] != "neutral":
            assert found["sentiment"] == r[0][0]
        if not {"positive", "negative"} <= {a for a, _ in r}:  # no tie between the two sides to be broken
            assert mirror[i]["sentiment"] == other[found["sentiment"]]
            assert mirror[i]["confidence"] == pytest.approx(found["confidence"])


def test_long_form_equals_array_form(spark):
    rows = _rows(300)
    arrays = spark.createDataFrame([(i, [(a, m / 1000) for a, m in r]) for i, r in rows], SCORED)
    long = spark.createDataFrame([(i, j, a, m / 1000) for i, r in rows for j, (a, m) in enumerate(r)],
                                 "id int, sent_idx int, label string, score double")
    a = scoring.vote(arrays).select("id", "sentiment", "confidence", "score", "label")
    b = scoring.vote_sentences(long, "id").select("id", "sentiment", "confidence", "score", "label")
    assert a.exceptAll(b).count() == 0 and b.count() == 300


@pytest.mark.parametrize("rows, expected", [
    ([("positive", .9)], ("positive", .90)),
    ([("positive", .6), ("negative", .6)], ("positive", .60)),
    ([("neutral", .4), ("positive", .35), ("neutral", .3)], ("positive", .60)),
    ([("neutral", .5)], ("neutral", .50)),
    # .9 against .9 * 1.1: the strongest sentence, the first of two equals, wins within the gap.
    ([("negative", .9), ("positive", .9)], ("negative", .90)),
    # Seven times .5 against .9 * 3: the gap of .8 is too large, and .4375 a sentence is raised to .65.
    ([("negative", .5)] * 7 + [("positive", .9)], ("negative", .65)),
    # 5 * .6 against .6 * 2 and a strongest sentence of the same side: 3.0 + 1.2 over six.
    ([("positive", .6)] * 5 + [("positive", .6)], ("positive", .70)),
    # Neutral leads with .9 a sentence, which is cut to .85.
    ([("neutral", .9), ("neutral", .9)], ("neutral", .85)),
    # Neutral leads weakly and the other side stays at .3: neutral, raised to .45.
    ([("neutral", .4), ("positive", .3), ("neutral", .4)], ("neutral", .45)),
])
def test_vote_fixtures(spark, rows, expected):
    r = scoring.vote(spark.createDataFrame([(1, rows)], SCORED)).first()
    assert (r["sentiment"], round(r["confidence"], 2)) == expected


def test_turkish_sentiment_and_error_row(spark):
    df = spark.createDataFrame([(1, "Harika bir ürün. Çok iyi, memnun kaldım."), (2, "Rezalet, berbat."), (3, None), (4, "Masa.")],
                               "id int, text string")
    got = {r["id"]: r for r in scoring.analyse_sentiment(df).collect()}
    assert [got[i]["sentiment"] for i in (1, 2, 3, 4)] == ["positive", "negative", "neutral", "neutral"]
    assert (got[3]["confidence"], got[3]["label"]) == (0.0, None) and got[3]["error"]
    assert got[1]["error"] is None


def test_override_flips_only_confident_verdicts(spark):
    df = spark.createDataFrame([
        (1, "negative", -.9, .9, "iyi ve harika"), (2, "negative", -.7, .7, "iyi ve harika"),
        (3, "positive", .99, .99, "kötü ve berbat"), (4, "positive", .8, .8, "kötü ama iyi")],
        "id int, sentiment string, score double, confidence double, last string")
    got = {r["id"]: (r["sentiment"], round(r["confidence"], 2)) for r in scoring.lexicon_override(df, F.col("last")).collect()}
    assert got == {1: ("positive", .85), 2: ("negative", .7), 3: ("negative", .85), 4: ("positive", .8)}


def test_user_model_runs_behind_the_contract(spark):
    def load():
        return lambda sentences: [("LABEL_2" if "a" in s else "olumsuz", 0.9) for s in sentences]

    df = spark.createDataFrame([(1, "ada. aba"), (2, "b. c"), (3, "")], "id int, text string")
    got = {r["id"]: r["sentiment"] for r in scoring.analyse_sentiment(df, scorer=scoring.ModelScorer(load)).collect()}
    assert got == {1: "positive", 2: "negative", 3: "negative"}
    plan = scoring.analyse_sentiment(df, scorer=scoring.ModelScorer(load)).where("sentiment = 'positive'")
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and plan.count() == 1


def test_weights_are_configurable(spark):
    rows = [(1, [("negative", .9), ("positive", .8)])]
    flat = scoring.LastWeights(1.0, 1.0, 1.0)
    heavy = scoring.LastWeights(5.0, 5.0, 5.0)
    df = spark.createDataFrame(rows, SCORED)
    assert scoring.vote(df, weights=flat).first()["sentiment"] == "negative"
    assert scoring.vote(df, weights=heavy).first()["sentiment"] == "positive"


@pytest.mark.parametrize("scores, labels, ambiguous", [
    ([("A", .5), ("B", .45), ("C", .03), ("D", .02)], ["A", "B"], True),
    ([(x, .125) for x in "ABCDEFGH"], ["A"], False),
    ([("A", .5), ("B", .4)], ["A", "B"], False),
    ([("LABEL_5", .3), ("LABEL_1", .29), ("world", .2), ("health", .16)], ["Spor", "Ekonomi", "Dünya"], True),
    ([], ["Genel"], False),
])
def test_theme_rule(spark, scores, labels, ambiguous):
    df = spark.createDataFrame([(1, scores)], "id int, theme_scores array<struct<label:string,score:double>>")
    r = themes.theme_result(df).first()
    assert r["themes"] == labels and r["main_topic"] == labels[0] and r["is_ambiguous"] == ambiguous
    assert set(r["scores"]) == (set(labels) if scores else set())
    assert (r["error"] is None) == bool(scores)


def test_theme_model_learns_separable_words(spark):
    rows = [(i, "gol maç takım", "spor") if i % 2 else (i, "borsa faiz dolar", "ekonomi") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, theme string")
    model = themes.train_theme_model(df, features=1 << 8)
    got = themes.analyse_theme(themes.score_themes(df, model))
    assert got.where(F.lower("main_topic") != F.col("theme")).count() == 0
    assert "probability" not in got.columns and "keywords" in got.columns


def test_batch_summary_counts_skipped_rows(spark):
    df = spark.createDataFrame([(1, "uzun metin", "positive", "Spor"), (2, " a ", "neutral", None), (3, "x" * 150, "neutral", None)],
                               "id int, text string, sentiment string, main_topic string")
    got = {(r["kind"], r["label"]): r["n"] for r in summary.batch_summary(df).collect()}
    assert got == {("total_entries", ""): 3, ("sentiment", "positive"): 1, ("sentiment", "neutral"): 1,
                   ("theme", "Spor"): 1, ("theme", "Genel"): 1}
    entries = summary.batch_entries(df).collect()
    assert {r["entry_id"] for r in entries} == {1, 3} and max(len(r["text"]) for r in entries) == 103


def test_filter_keeps_rows_without_analysis(spark):
    entries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    analysis = spark.createDataFrame([(1, "positive", ["Spor"]), (2, "negative", ["Spor"]), (3, "positive", ["Dünya"])],
                                     "id int, sentiment string, themes array<string>")
    rows = search.attach_analysis(entries, analysis)
    assert {r["id"] for r in filters.filter_analysed(rows, "positive", "Spor").collect()} == {1, 4}
    assert filters.filter_analysed(rows).count() == 4


@pytest.mark.parametrize("text, verdict", [("ab", "too_short"), ("x" * 5000, "ok"), ("x" * 5001, "too_long"), (None, "too_short")])
def test_text_verdict(one, text, verdict):
    assert one(filters.text_verdict, text) == verdict


def test_row_filters(spark):
    df = spark.createDataFrame([("https://a.b/c",), ("bak https://a.b",), ("(bkz: pena)",), ("uzun bir metin içinde bkz geçer",)], "body string")
    assert filters.drop_url_only(df).count() == 3
    assert [r[0] for r in filters.drop_short_crossref(df).collect() if "bkz" in r[0]] == ["uzun bir metin içinde bkz geçer"]
    with pytest.raises(ValueError):
        filters.require_columns(df, ["body", "RDuygu"])


def test_rank_sentences(spark):
    rows = [(d, i) for d in (1, 2) for i in range(14 if d == 1 else 3)]
    got = ranking.rank_sentences(spark.createDataFrame(rows, "doc_id int, sent_idx int")).collect()
    assert sorted(r["sent_idx"] for r in got if r["doc_id"] == 1) == list(range(4, 14))
    assert {(r["sent_idx"], r["total"]) for r in got if r["is_last"]} == {(13, 10), (2, 3)}


def test_batches_by_length_bound_padding_and_size():
    import random
    rng = random.Random(5)
    for budget in (64, 500, 16_384):
        lengths = [min(256, int(rng.expovariate(1 / 20))) for _ in range(2000)]
        batches = list(scoring.length_batches(lengths, budget))
        assert sorted(i for b in batches for i in b) == list(range(2000))
        sizes = [[max(lengths[i], 1) for i in b] for b in batches]
        assert all(len(s) == 1 or max(s) * len(s) <= budget for s in sizes)
        assert sum(max(s) * len(s) for s in sizes) <= 1.2 * sum(map(sum, sizes))
    assert list(scoring.length_batches([], 10)) == []


def test_model_results_go_back_to_their_sentences(spark):
    def load():
        def model(sentences):
            assert len(sentences) * max(len(s.split()) for s in sentences) <= 30 or len(sentences) == 1
            return [("positive", len(s.split()) / 100) for s in sentences]
        return model

    texts = [(i, ". ".join(" ".join(["söz"] * (1 + (i * 7 + j * 5) % 20)) for j in range(i % 6 + 1)) + ".") for i in range(80)]
    df = scoring.with_sentences(spark.createDataFrame(texts, "id int, text string"))
    scored = scoring.ModelScorer(load, budget=30, max_words=12).apply(df)
    for r in scored.collect():
        assert [round(x["score"] * 100) for x in r["scored"]] == [min(12, len(s.split())) for s in r["sentences"]]
