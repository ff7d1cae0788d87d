import random

import random

from postlens.operators import search, topics

TOPICS = "id int, title string, slug string, entry_count int"


def _topics(spark):
    return spark.createDataFrame([
        (1, "pena", "/pena--1", 50), (2, "pena kulübü", "/pena-kulubu--2", 90), (3, "Bas gitar pena", "/bas-gitar-pena--3", 10),
        (4, "işık şöleni", "/isik-soleni--4", 5), (5, "gitar", "/gitar--5", 7), (6, "gitar", "/gitar--6", 9)], TOPICS)


def test_resolution_tiers(spark):
    asked = spark.createDataFrame([(q,) for q in (
        " Pena ", "bas gitar", "isik-soleni", "yokboyle", "pena gitar", "hiç yok", "pena--31782", "gitar", "pena")], "query string")
    got = {r["query"]: (r["tier"], r["id"], r["path"]) for r in search.resolve_topic(asked, _topics(spark)).collect()}
    assert got == {
        " Pena ": ("exact", 1, "pena--1"), "pena": ("exact", 1, "pena--1"),
        "bas gitar": ("starts_with", 3, "bas-gitar-pena--3"), "isik-soleni": ("exact", 4, "isik-soleni--4"),
        "yokboyle": ("as_typed", None, "yokboyle"), "pena gitar": ("first_result", 3, "bas-gitar-pena--3"),
        "hiç yok": ("not_found", None, None), "pena--31782": ("direct", 31782, "pena--31782"), "gitar": ("exact", 6, "gitar--6")}


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the"] * 6 + ["kedi", "köpek", "kuş", "balık", "at"]
    titles = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), f"/t--{i}", rng.randint(1, 9)) for i in range(300)]
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(40)] + ["", "yok the"]
    got = search.search_topics(spark.createDataFrame([(q,) for q in queries], "query string"),
                               spark.createDataFrame(titles, TOPICS), 5).collect()
    for q in set(queries):
        wanted = set(q.split())
        hits = sorted((t for t in titles if wanted and wanted <= set(t[1].split())), key=lambda t: (-t[3], t[0]))
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == [t[0] for t in hits[:5]]
        assert all(r["thread_count"] == len(hits) for r in mine)


def test_autocomplete(spark):
    titles = spark.createDataFrame([("pena", 5), ("Pena kulübü", 9), ("bas pena", 99)] + [(f"penalar {i}", 0) for i in range(9)], "text string, weight int")
    nicks = spark.createDataFrame([("penaci", 1)], "text string, weight int")
    asked = spark.createDataFrame([("PENA",), ("p",), ("zz",)], "query string")
    rows = search.autocomplete(asked, titles, nicks).collect()
    assert {r["query"] for r in rows} == {"PENA"}
    listed = [r["text"] for r in sorted((r for r in rows if r["kind"] == "title"), key=lambda r: r["rank"])]
    assert len(listed) == 8 and listed[:2] == ["Pena kulübü", "pena"]
    assert [r["text"] for r in rows if r["kind"] == "nick"] == ["penaci"]


def test_daily_entries_keep_list_order(spark):
    ids = spark.createDataFrame([(1, 30), (2, 10), (3, 99)], "pos int, id int")
    entries = spark.createDataFrame([(10, "on"), (20, "yirmi"), (30, "otuz")], "id int, body string")
    assert [r["body"] for r in search.daily_entries(ids, entries).collect()] == ["otuz", "on"]


def test_topics_from_embeddings(spark):
    rng = random.Random(6)
    centres = [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]
    rows = [(i, [rng.gauss(c[0], .3), rng.gauss(c[1], .3)]) for i, c in enumerate(centres * 20)] + [(99, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    found = topics.cluster_topics(df, min_size=10, k=4)
    info = {r["topic"]: r["size"] for r in topics.topic_info(found).collect()}
    assert info[topics.OUTLIER] == 1 and sorted(info.values()) == [1, 20, 20, 20]
    assert topics.topic_count(found).first()["n"] == 3


def _titles(spark, n=900):
    """Every title holds one frequent word, which fills several blocks of an index."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(["Ortak", *rng.sample(words, 3)]), f"/s--{i}", rng.randrange(40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, title string, slug string, entry_count long")


def _matches(rows, query):
    wanted = set(query.lower().split())
    return sorted(((-c, i) for i, t, _, c in rows if wanted <= set(t.lower().split())))


def test_an_index_answers_without_the_titles(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 20)
    rows, topics = _titles(spark)
    index = search.index_topics(topics, 20)
    assert index.blocks.where("word = 'ortak'").count() == 45 and max(len(r.postings) for r in index.blocks.collect()) == 20
    asked = ["ortak", "w1", "W2 w3", "ortak w4 w5", "w6 none", "none", "", "w1 w2 w3 w4"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    found = search.search_topics(queries, index, 7)
    assert "createDataFrame" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((-r.entry_count, r.id))
        assert r.thread_count == len(_matches(rows, r.query))
    assert got == {q: _matches(rows, q)[:7] for q in asked if q and _matches(rows, q)}
    first = {}
    for r in search.first_topics(queries, index, 3).orderBy("query", "rank").collect():
        first.setdefault(r.query, []).append((-r.entry_count, r.id))
    assert first == {q: _matches(rows, q)[:3] for q in asked if q and _matches(rows, q)}
    assert search.first_topics(queries.limit(0), index).collect() == []


def test_suggestion_nodes_hold_the_best_of_every_beginning(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choices("abÇ ", k=rng.randrange(1, 25))).strip(): rng.randrange(30) for _ in range(500)}
    titles = spark.createDataFrame([(t, w) for t, w in texts.items()] + [("ab", 99), ("ab", 1)], "text string, weight long")
    nicks = spark.createDataFrame([("abla", 5), ("x", 3)], "text string, weight long")
    texts["ab"] = 99
    index = search.index_suggestions(titles, nicks, 3)
    got = {}
    for r in index.where("kind = 'title'").orderBy("prefix", "rank").collect():
        got.setdefault(r.prefix, []).append(r.text)
    want = {}
    for t in texts:
        for n in range(2, len(t) + 1):
            want.setdefault(t.lower()[:n], []).append((-texts[t], t))
    assert got == {p: [t for _, t in sorted(ts)[:3]] for p, ts in want.items()}
    asked = spark.createDataFrame([(" AB ",), ("a",), ("zz",)], "query string")
    assert {(r.query, r.kind) for r in search.suggest(asked, index).collect()} == {(" AB ", "title"), (" AB ", "nick")}
    assert search.index_suggestions(titles.limit(0), nicks.limit(0)).collect() == []
