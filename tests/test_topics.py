import math
import random

import numpy as np
import pytest

from postlens.operators import density, graph, text_topics, topics

SCHEMA = "id long, embedding array<double>, planted int"


def planted(seed, sizes, noise, dims=16, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dims))
    rows = [([float(x) for x in centres[c] + rng.normal(size=dims) * spread], c) for c, n in enumerate(sizes) for _ in range(n)]
    rows += [([float(x) for x in rng.normal(size=dims)], -1) for _ in range(noise)]
    random.Random(seed).shuffle(rows)
    return [(i, v, c) for i, (v, c) in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 150])
def test_planted_clusters_come_out_with_their_number(spark, block):
    rows = planted(3, (200, 120, 70, 40), 50)
    found = topics.discover_topics(spark.createDataFrame(rows, SCHEMA).repartition(3), 20, block=block).collect()
    for cluster in range(4):
        names = [r.topic for r in found if r.planted == cluster]
        main = max(set(names), key=names.count)
        # Clusters are numbered by size; most of a cluster is in one topic and no topic mixes clusters.
        assert main == cluster and names.count(main) > 0.75 * len(names) and set(names) <= {main, -1}
    assert sum(r.topic != -1 for r in found if r.planted == -1) <= 2
    assert {r.topic for r in found} == {-1, 0, 1, 2, 3}


def test_a_crowd_of_equal_vectors_is_one_topic(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(400)] + [(1000 + i, [float(x) for x in np.random.default_rng(i).normal(size=3)], -1) for i in range(30)]
    rows += [(2000, None, -1), (2001, [0.0, 0.0, 0.0], -1), (2002, [], -1)]
    found = {r.id: r.topic for r in topics.discover_topics(spark.createDataFrame(rows, SCHEMA), 50, block=64).collect()}
    assert len(found) == len(rows) and found[2000] == -1
    assert len({found[i] for i in range(400)}) == 1 and found[0] == 0
    assert topics.discover_topics(spark.createDataFrame(rows, SCHEMA).limit(0)).collect() == []
    assert {r.topic for r in topics.discover_topics(spark.createDataFrame(rows[-3:], SCHEMA)).collect()} == {-1}


def test_neighbours_equal_all_pairs_in_one_block_and_most_of_them_in_many(spark):
    rows = [(i, v) for i, v, _ in planted(5, (150, 100), 50)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    distance = 1 - unit @ unit.T
    np.fill_diagonal(distance, 9)
    want = {(i, int(j)) for i in range(len(rows)) for j in np.argsort(distance[i], kind="stable")[:8]}
    exact = {(r.a, r.b) for r in density.neighbours(df, 8).collect()}
    assert exact == want
    near = {(r.a, r.b) for r in density.neighbours(df, 8, block=100).collect()}
    assert len(near) == len(want) and len(near & want) > 0.6 * len(want)


def test_components_of_chains_stars_and_separate_graphs(spark):
    rng = random.Random(2)
    names = list(range(300))
    rng.shuffle(names)
    links = [(0, *p) for p in zip(names, names[1:])] + [(1, 5, i) for i in range(6, 80)] + [(1, 200, 201), (1, 201, 202), (1, 7, 7)]
    found = {(r.g, r.node): r.root for r in graph.components(spark.createDataFrame(links, "g int, a long, b long"), ["g"]).collect()}
    assert {found[0, n] for n in names} == {0}
    assert {found[1, n] for n in range(5, 80)} == {5} and found[1, 202] == found[1, 200] == 200
    assert len(found) == 300 + 75 + 3


def test_texts_get_the_topic_with_the_nearest_terms(spark, tmp_path):
    known = [("spor", "futbol maç takım gol futbol lig"), ("spor", "takım transfer futbol teknik"), ("ekonomi", "borsa dolar faiz banka"),
             ("ekonomi", "dolar kuru banka kredi faiz"), (None, "futbol dolar"), ("boş", "")]
    model = text_topics.fit(spark.createDataFrame(known, "topic string, text string"), "topic")
    text_topics.save(model, str(tmp_path / "model"))
    new = [(1, "Futbol takımı ve futbol"), (2, "faiz, borsa; kredi"), (3, "bilinmeyen sözler"), (4, None), (5, ""), (6, "futbol dolar dolar faiz")]
    df = spark.createDataFrame(new, "id int, text string")
    found = {r.id: r for r in text_topics.assign(df, text_topics.load(spark, str(tmp_path / "model")), ["id"]).collect()}
    assert [found[i].topic for i in range(1, 7)] == ["spor", "ekonomi", None, None, None, "ekonomi"]
    assert found[1].probability == 1 and 0.5 < found[6].probability < 1 and found[3].similarity == 0
    # By hand: counts per topic, ln(1 + A / f), unit vectors.
    counts = {"spor": {}, "ekonomi": {}}
    for topic, text in known[:4]:
        for word in text.split():
            if len(word) > 3:
                counts[topic][word] = counts[topic].get(word, 0) + 1
    average = sum(sum(c.values()) for c in counts.values()) / 2
    idf = {w: math.log(1 + average / sum(c.get(w, 0) for c in counts.values())) for c in counts.values() for w in c}
    text = {"futbol": 1, "dolar": 2, "faiz": 1}
    dots = {t: sum(text.get(w, 0) * idf[w] * n * idf[w] for w, n in c.items()) / math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
            for t, c in counts.items()}
    length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in text.items()))
    assert found[6].similarity == pytest.approx(dots["ekonomi"] / length)
    assert found[6].probability == pytest.approx(dots["ekonomi"] / sum(dots.values()))
    strict = text_topics.assign(df, model, ["id"], least=0.99)
    assert {r.topic for r in strict.collect()} == {None}
    assert text_topics.assign(df.limit(0), model, ["id"]).collect() == []
