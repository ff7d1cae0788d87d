import itertools
import math
import random
import time
from collections import Counter

import pytest

from postlens.operators import respelling as sp


def test_best_path_equals_all_paths():
    rng = random.Random(2)
    for _ in range(150):
        forms = [[(f"{i}{c}", rng.randrange(6)) for c in "abc"[:rng.randrange(1, 4)]] for i in range(rng.randrange(1, 6))]
        pairs = [{(a, b): rng.randrange(8) for a, _ in x for b, _ in y if rng.random() < 0.6} for x, y in zip(forms, forms[1:])] + [{}]

        def score(path):
            return sum(math.log1p(n) for _, n in path) + sum(math.log1p(pairs[i].get((a[0], b[0]), 0)) for i, (a, b) in enumerate(zip(path, path[1:])))

        best = max(map(score, itertools.product(*forms)))
        found = sp.best_path(forms, pairs)
        chosen = [next(o for o in options if o[0] == name) for options, name in zip(forms, found)]
        assert abs(score(chosen) - best) < 1e-9
    assert sp.best_path([], []) == []


CORPUS = ["dün açık kapı gördüm", "açık hava güzel", "acık daha kal", "kapı açık", "kuş uçtu", "kus dedi", "kuş uçtu gitti", "kus dedi yine", "ılık su"]


def test_neighbours_decide_between_forms(spark):
    spelling = sp.learn(spark.createDataFrame([(t,) for t in [*CORPUS, None, ""]], "text string"))
    asked = [(1, "kus uctu"), (2, "kus dedi"), (3, "acik kapi"), (4, "kapı acik bilinmez"), (5, None), (6, ""), (7, "ilik  su"), (7, "ilik  su")]
    df = spark.createDataFrame(asked, "id int, text string")
    got = {r.id: r.restored for r in sp.restore(df.where("id < 7"), spelling, ["id"]).collect()}
    assert got == {1: "kuş uçtu", 2: "kus dedi", 3: "açık kapı", 4: "kapı açık bilinmez", 5: "", 6: ""}
    alone = {r.id: r.restored for r in sp.restore(df.where("id < 7"), spelling, ["id"], neighbours=False).collect()}
    assert alone[1] == "kus uçtu" and alone[3] == "açık kapı"
    assert sp.restore(df.limit(0), spelling, ["id"]).collect() == []
    shouted = spark.createDataFrame([(9, "KUS UCTU!")], "id int, text string")
    assert sp.normalize_and_restore(shouted, spelling, ["id"]).first().restored == "kuş uçtu"


def test_a_word_table_will_do(spark):
    table = spark.createDataFrame([("şeker", 5), ("seker", 1), ("çay", 2)], "form string, n long")
    df = spark.createDataFrame([(1, "seker ve cay")], "id int, text string")
    assert sp.restore(df, sp.from_words(table), ["id"]).first().restored == "şeker ve çay"


def test_folded_texts_are_mostly_restored(spark):
    rng = random.Random(7)
    stems = ["".join(rng.choices(["ka", "çı", "şe", "gu", "ğü", "ol", "ör"], k=rng.randrange(1, 4))) for _ in range(120)]
    follow = {s: rng.choices(stems, k=3) for s in stems}
    texts = []
    for i in range(400):
        words = [rng.choice(stems)]
        while len(words) < 12:
            words.append(rng.choice(follow[words[-1]]))
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "id int, text string")
    folded = df.select("id", sp.fold(df["text"]).alias("text"))
    got = {r.id: r.restored.split() for r in sp.restore(folded, sp.learn(df.where("id >= 100")), ["id"]).where("id < 100").collect()}
    words = [(a, b) for i, t in texts[:100] for a, b in zip(t.split(), got[i])]
    assert sum(a == b for a, b in words) / len(words) > 0.97


def test_a_long_text_takes_time_in_proportion(spark):
    text = " ".join(f"açık{i}" for i in range(80_000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    sp.restore(df.limit(0), sp.learn(df.limit(0)), ["id"]).collect()
    begin = time.monotonic()
    spelling = sp.learn(df)
    folded = df.select("id", sp.fold(df["text"]).alias("text"))
    assert sp.restore(folded, spelling, ["id"]).first().restored == text
    assert sp.restore(folded, spelling, ["id"], neighbours=False).first().restored == text
    assert time.monotonic() - begin < 60


def _by_all_paths(words, forms, pairs):
    """The path with the largest product; of equal ones the one with the earlier forms, from the last word back."""
    options = [forms.get(w, [(w, 0)]) if w == w.translate(str.maketrans(*sp.TURKISH)) else [(w, 0)] for w in words]

    def key(path):
        own = math.prod(1 + options[i][k][1] for i, k in enumerate(path))
        near = math.prod(1 + pairs.get((options[i][k][0], options[i + 1][m][0]), 0) for i, (k, m) in enumerate(zip(path, path[1:])))
        return own * near, [-k for k in path[::-1]]
    best = max(itertools.product(*[range(len(o)) for o in options]), key=key, default=())
    return " ".join(options[i][k][0] for i, k in enumerate(best))


@pytest.mark.parametrize("hot", [0, 5, 1 << 16])
def test_bounds_and_joins_leave_the_best_path(spark, monkeypatch, hot):
    monkeypatch.setattr(sp, "HOT", hot)
    rng = random.Random(11)
    words = ["su", "şu", "kus", "kuş", "küs", "on", "ön", "dag", "dağ", "ev", "bir", "iç"]
    corpus = [" ".join(rng.choices(words, weights=[9, 2, 7, 3, 1, 30, 1, 2, 2, 5, 5, 4], k=rng.randrange(1, 8))) for _ in range(120)]
    forms, pairs = Counter(w for t in corpus for w in t.split()), Counter(p for t in corpus for p in itertools.pairwise(t.split()))
    known = {}
    for w, n in sorted(forms.items(), key=lambda x: (-x[1], x[0])):
        known.setdefault(w.translate(str.maketrans(*sp.TURKISH)), []).append((w, n))
    asked = [(i, " ".join(rng.choices([*known, "yok", "önce", "ön"], k=rng.randrange(0, 7)))) for i in range(150)]
    asked += [(None, "kus su"), (200, "kus"), (200, "su on dag"), (200, "kus")]
    spelling = sp.learn(spark.createDataFrame([(t,) for t in corpus], "text string"))
    got = sorted((str(r.id), r.restored) for r in sp.restore(spark.createDataFrame(asked, "id int, text string"), spelling, ["id"]).collect())
    # Texts that share their keys are read word by word beside each other.
    merged = _by_all_paths(["kus", "kus", "su", "on", "dag"], known, pairs)
    assert got == sorted([(str(i), _by_all_paths(t.split(), known, pairs)) for i, t in asked[:150]] + [("None", "")] + [("200", merged)] * 3)


def test_only_neighbours_that_decide_are_counted(spark):
    spelling = sp.learn(spark.createDataFrame([("ev bir su su bir ev", ), ("ev bir şu", )], "text string"))
    assert sorted(tuple(r) for r in spelling.pairs.collect()) == [("bir", "su", 1), ("bir", "şu", 1), ("su", "bir", 1), ("su", "su", 1)]


def test_equal_paths_are_told_apart_by_their_forms_wherever_they_are():
    # (1 + 5)(1 + 2) and (1 + 2)(1 + 5), behind texts of different sums.
    for n in range(200):
        forms = [[("x", n), ("y", n + 1)], [("z", 3)], [("a", 5), ("b", 2)]]
        assert sp.best_path(forms, [{}, {("z", "a"): 2, ("z", "b"): 5}, {}])[2] == "a"
