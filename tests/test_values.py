import random

import pytest
from pyspark.sql import functions as F

from postlens.functions import values as val


@pytest.mark.parametrize("text, created, updated", [
    ("28.01.2021 03:49 ~ 03:50", "28.01.2021 03:49", "28.01.2021 03:50"),
    ("28.01.2021 03:49 ~ 29.01.2021 05:00", "28.01.2021 03:49", "29.01.2021 05:00"),
    ("15.02.1999", "15.02.1999", None),
    ("15.02.1999 ~ 16.02.1999 10:00", "15.02.1999", "16.02.1999 10:00"),
])
def test_edit_dates(one, text, created, updated):
    assert tuple(one(val.parse_edit_date, text)) == (created, updated)


def test_edit_dates_give_back_both_times(spark):
    rng = random.Random(5)
    day = lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1999, 2024)}"
    time = lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}"
    rows = []
    for _ in range(200):
        first, later, at, then = day(), day(), time(), time()
        rows += [(f"{first} {at} ~ {later} {then}", f"{first} {at}", f"{later} {then}"), (f"{first} {at} ~ {then}", f"{first} {at}", f"{first} {then}"),
                 (f"{first} {at}", f"{first} {at}", None), (first, first, None)]
    df = spark.createDataFrame(rows, "t string, c string, u string")
    got = df.select(val.parse_edit_date(F.col("t")).alias("r"), "c", "u").select("r.*", "c", "u").collect()
    assert all((r["created_at"], r["updated_at"]) == (r["c"], r["u"]) for r in got)


def test_typed_dates(one):
    assert str(one(val.to_post_ts, "28.01.2021 03:49")) == "2021-01-28 03:49:00"
    assert str(one(val.to_post_ts, "15.02.1999")) == "1999-02-15 00:00:00"
    assert one(val.to_post_ts, "dün") is None


def test_counts_and_defaults(one):
    assert one(val.parse_count, "230 başlık") == 230
    assert one(val.parse_count, None) == 1
    assert one(lambda a, b: val.first_truthy(a, b, default="z"), "", "x", schema="a string, b string") == "x"
    assert one(lambda a: val.first_truthy(a, default="z"), "") == "z"
    assert one(lambda a: val.first_truthy(a, default=5, empty=0), 0, schema="a int") == 5
    assert one(val.split_tags, " a,b ") == ["a", "b"]
    assert one(val.split_tags, "  ") is None


@pytest.mark.parametrize("text, code", [("-1", 0), ("2.0", -1), ("Olumlu", 2), (" nötr ", 1), ("?", -1), (None, -1)])
def test_gold_text(one, text, code):
    assert one(val.gold_code, text) == code


@pytest.mark.parametrize("number, code", [(-1.0, -1), (2.0, 2), (1.9, 1), (float("nan"), -1), (7.0, -1)])
def test_gold_numbers(one, number, code):
    assert one(lambda c: val.gold_code(c, numeric=True), number, schema="v double") == code


@pytest.mark.parametrize("label, score, expected", [
    ("LABEL_2", .7, ("positive", .7)), ("OLUMSUZ", .6, ("negative", .6)), ("foo", .9, ("neutral", .5)),
    ("label_1", .4, ("neutral", .4)), ("LABEL_7", .9, ("neutral", .5)), ("Nötr", .3, ("neutral", .3)), (None, .8, ("neutral", .8)),
])
def test_canonical(one, label, score, expected):
    assert tuple(one(val.canonical_sentiment, label, score, schema="l string, s double")) == expected


def test_best_candidate(one):
    rows = "k array<struct<label string, score double>>".replace("label string, score double", "label:string,score:double")
    assert tuple(one(val.best_candidate, [("a", .2), ("b", .9), ("c", .9)], schema=rows)) == ("b", .9)
    assert tuple(one(val.best_candidate, [], schema=rows)) == ("neutral", .5)
    assert tuple(one(val.best_candidate, None, schema=rows)) == ("neutral", .5)


@pytest.mark.parametrize("code, name", [("LABEL_4", "Siyaset"), ("Sport ", "Spor"), ("bilim X", "Bilim x")])
def test_theme_label(one, code, name):
    assert one(val.theme_label, code) == name


def test_sentiment_codes(one):
    assert [one(val.sentiment_code, s) for s in ("negative", "neutral", "positive", "x", None)] == [0, 1, 2, 1, 1]


def test_round2_equals_python(spark):
    rng = random.Random(1)
    numbers = [2.675, 0.125, 0.375, -0.125, 0.5, 1.005] + [rng.uniform(-1, 1) for _ in range(300)] + [i / 1000 for i in range(400)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r[0] for r in df.select(val.round2(F.col("x"))).collect()]
    assert got == [round(x, 2) for x in numbers]
