import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import language_id as lid

SCHEMA = "doc_id long, text string, lang string, source string, score string, accepted string, held_out int"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "su", "ta"], "bb": ["sch", "ung", "der", "ent", "ü", "br"], "cc": ["qu", "eau", "ti", "ou", "é", "ne"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def documents(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((i, sentence(rng, lang, rng.choice([3, 8, 40, 200])), lang, rng.choice(["x", "y"]), "s", "t", 0))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = documents(1, 600)
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, docs, lid.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 3


def test_held_out_accuracy_and_calibration(spark, trained):
    rows, docs, model = trained
    found = {r.doc_id: r for r in lid.identify(docs, model).collect()}
    held = [r for r in rows if fold(r[0]) == 1]
    right = [found[r[0]].lang_pred == r[2] for r in held]
    assert np.mean(right) > 0.97
    accepted = [ok for ok, r in zip(right, held) if found[r[0]].accepted]
    assert len(accepted) > 0.9 * len(held) and np.mean(accepted) > 0.98
    # Scores are probabilities: their mean is near the share of right answers.
    assert abs(np.mean([found[r[0]].score for r in held]) - np.mean(right)) < 0.04


def test_only_texts_decide(spark, trained):
    rows, docs, model = trained
    other = docs.withColumns({"lang": F.lit("cc"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10_000})
    plain = {r.doc_id + 10_000: (r.lang_pred, r.score) for r in lid.identify(docs, model).collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(other, model).collect()} == plain


def test_held_out_labels_teach_nothing(spark, trained):
    rows, docs, model = trained
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    spoiled = spark.createDataFrame([r if fold(r[0]) != 1 else (r[0], "lie " + r[1], "zz", *r[3:]) for r in rows], SCHEMA).repartition(3)
    again = lid.train(spoiled, learn)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)


def test_scores_equal_plain_counting(monkeypatch):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(lid.BUCKETS, 3))
    text = "Ağaç 12 évé, " * 700 + "tail"
    points = lid.letters(text)
    assert "".join(map(chr, lid.letters("A1b--Ç "))) == " a b ç "
    plain = []
    for start in range(len(points)):
        for n in range(1, 5):
            part = points[start:start + n]
            if len(part) == n and (n > 1 or part[0] != 32):
                h = 0
                for j, p in enumerate(part):
                    h = (h * 0x100000001B3 + int(p) + j + 1) % 2 ** 64
                plain.append((h * 0x9E3779B97F4A7C15 % 2 ** 64 >> 40) % lid.BUCKETS)
    assert sorted(plain) == sorted(lid.buckets(points).tolist())
    want = weights[plain].mean(axis=0)
    for step in (lid.STRETCH, 1000, 7, len(points) - 1):
        monkeypatch.setattr(lid, "STRETCH", step)
        assert np.allclose(lid.mean_scores(points, weights), want)


def test_odd_texts(spark, trained):
    _, _, model = trained
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 34 !? \U0001f600", "aa"), (4, "a", None), (None, "kalo mine", "aa"), (6, "derung " * 60_000, None),
            (6, "derung " * 60_000, None), (7, "ΑΒΓ δε", "aa")]
    docs = spark.createDataFrame([(*r, "s", "x", "y", 1) for r in rows], SCHEMA)
    found = [(r.doc_id, r.lang_pred, r.accepted) for r in lid.identify(docs, model).collect()]
    assert found[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert found[5] == found[6] == (6, "bb", True) and found[4][1] == "aa" and found[7][1] in model.languages
    out = lid.identify(docs, model, reject=True)
    assert out.columns == ["doc_id", "lang", "source", "held_out", "lang_pred", "score", "accepted"]
    assert {r.lang_pred for r in out.collect() if not r.accepted} <= {"und"}
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert lid.identify(docs.limit(0), model).collect() == []
    none = lid.train(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in lid.identify(docs, none).collect()} == {("und", 0.0)}
    one = lid.train(docs, F.lit(True))
    assert one.languages == ["aa"] and {r.lang_pred for r in lid.identify(docs, one).collect()} == {"aa", "und"}
