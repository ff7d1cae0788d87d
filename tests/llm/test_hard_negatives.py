import math
import random

import numpy as np
import pytest

from postlens.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, row string, low int, cell string, anchor_id int"


def by_force(rows, step=10):
    """The stated rule over all pairs, with whole-number arithmetic."""
    kept = []
    for i, (vec, e, label) in enumerate(rows):
        if e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, vec, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a in kept:
        if a[1] is None or a[1] % step:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[3], b[3])), b[1] is None, b[1] or 0, b[0], b) for b in kept if b[0] != a[0]),
                        key=lambda t: t[:4])
        for p in [t for t in scored if t[4][2] == a[2]][:5]:
            fits = [t for t in scored if t[4][2] != a[2] and 30 * -p[0] <= 100 * -t[0] <= 90 * -p[0]][:10]
            out += [(a[1], p[4][1], r + 1, n[4][1], -p[0], -n[0]) for r, n in enumerate(fits)]
    return sorted(map(str, out))


def mined(spark, rows, parts=4, step=10):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(parts)
    return sorted(str(tuple(r)) for r in hard.mine(df, f"vec_id % {step} = 0").collect())


def vectors(seed, n, dims=24, labels=4, spread=0.6, hot=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        label = 0 if rng.random() < hot else int(rng.integers(labels))
        v = spread * centres[label] + rng.normal(size=dims)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], label))
    return rows


@pytest.mark.parametrize("seed,spread", [(1, 0.6), (2, 2.0)])
def test_negatives_equal_all_pairs(spark, monkeypatch, seed, spread):
    for name, value in (("CHUNK", 64), ("STEP", 8), ("ANCHOR_BLOCK", 9), ("ROWS_PER_CELL", 100)):
        monkeypatch.setattr(hard, name, value)
    rows = vectors(seed, 400, spread=spread)
    assert mined(spark, rows) == by_force(rows)


def test_odd_vectors(spark):
    rows = vectors(3, 60, dims=6)
    rows += [(None, rows[5][1], 0), (None, rows[6][1], 1), (70, None, 1), (80, rows[1][1], None), (90, [float("nan")] * 6, 1),
             (100, [float("inf")] + [0.0] * 5, 1), (110, [None] * 6, 2), (120, [], 3), (130, rows[2][1][:3], 1),
             (20, rows[20][1], rows[20][2]), (20, rows[7][1], 2), (140, [0.0] * 6, 0), (150, [900.0] + [0.5] * 5, 2),
             (160, [-3.0] * 6, 1)] + [(200 + i, rows[3][1], 3) for i in range(15)]
    assert mined(spark, rows) == by_force(rows)
    assert mined(spark, [(i, e, 0) for i, (_, e, _) in enumerate(rows)]) == []
    assert mined(spark, rows[1:9]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert hard.mine(empty, "vec_id % 10 = 0").collect() == []


def test_bounds_lose_no_pair_and_cut_most():
    rng = random.Random(5)
    draw = np.random.default_rng(5)
    for dims in (1, 7, 16, 40):
        ours = draw.integers(-60, 60, (40, dims)).astype(np.float32)
        # Most of the rows' weight is in their first dimensions, so that suffixes can be left out.
        theirs = (draw.normal(size=(300, dims)) * 60 / (1 + np.arange(dims))).round().astype(np.float32)
        scores = ours @ theirs.T
        threshold = np.array([np.quantile(s, rng.choice([0.9, 0.99])) for s in scores])
        threshold[3] = -np.inf
        i, j = hard._survivors(ours, hard._suffix_norms(ours), theirs, hard._suffix_norms(theirs), threshold, np.ones(scores.shape, bool))
        left = np.zeros(scores.shape, bool)
        left[i, j] = True
        assert not (~left & (scores >= threshold[:, None])).any()
        assert dims < 16 or left.mean() < 0.5
