import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postlens.operators import ranking, summary


def _skewed(spark, n=3000):
    """One group holds most of the rows; another key is null."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randint(0, 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, k string, v int")


def test_rank_within_is_exact_under_skew(spark):
    rows, df = _skewed(spark)
    ranked = ranking.rank_within(df, ["k"], [F.col("v").desc(), "id"], "rank", "size").collect()
    for key in ("hot", "a", None):
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))
        got = {r["id"]: (r["rank"], r["size"]) for r in ranked if r["k"] == key}
        assert got == {r[0]: (i + 1, len(group)) for i, r in enumerate(group)}


def test_rank_within_spreads_the_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, df = _skewed(spark)
        stored = df.repartitionByRange(F.col("k"), F.col("v"), F.col("id")).where("k = 'hot'")
        assert stored.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_top_k_small_and_large(spark):
    rows, df = _skewed(spark)
    for k in (5, 1500):
        got = ranking.top_k(df, ["k"], ["v", "id"], k).collect()
        for key in ("hot", "a", None):
            want = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))[:k]
            assert [r["id"] for r in sorted((g for g in got if g["k"] == key), key=lambda g: g["rank"])] == [r[0] for r in want]


def test_top_k_is_cut_before_the_shuffle(spark):
    _, df = _skewed(spark)
    plan = ranking.top_k(df, ["k"], ["v", "id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_stratified_sample_and_shuffle(spark):
    rows, df = _skewed(spark, 400)
    once = {r["id"] for r in ranking.stratified_sample(df, "k", "id", 7).collect()}
    again = {r["id"] for r in ranking.stratified_sample(df.repartition(3), "k", "id", 7).collect()}
    assert once == again and len(once) == 21
    for everything in (None, "all", 0, -1):
        assert ranking.stratified_sample(df, "k", "id", everything).count() == 400
    order = [r["id"] for r in ranking.shuffle_rows(df, "id").collect()]
    assert sorted(order) == list(range(400)) and order != sorted(order)


def test_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", 0)], "t string, id int")
    got = {(r["t"], r["id"]): r for r in ranking.paginate(df, ["t"], ["id"], 10).collect()}
    r = got["a", 20]
    assert (r["page"], r["total_page"], r["has_prev"], r["has_next"]) == (3, 3, True, False)
    assert (got["b", 0]["total_page"], got["b", 0]["has_next"]) == (1, False)
    assert [r["id"] for r in ranking.one_page(df.where("t = 'a'"), ["id"], 3, 10).collect()] == [20, 21, 22]


def test_day_key(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 59, 59),), (datetime(2024, 1, 2, 4),)], "ts timestamp_ntz")
    assert [str(r[0]) for r in df.select(ranking.day_key(F.col("ts"))).collect()] == ["2024-01-01", "2024-01-02"]


def test_order_modes_and_authors(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "x", "ada" if i % 2 else "bob", t + timedelta(hours=i), 10 - i) for i in range(8)],
                               "id int, topic string, author string, created_at timestamp_ntz, fav_count int")
    nice = ranking.order_entries(df, "nice").orderBy("position").collect()
    plain = ranking.order_entries(df).orderBy("position").collect()
    assert [r["id"] for r in nice] == [r["id"] for r in plain] == list(range(8))
    assert [r["id"] for r in ranking.latest_by_author(df, 1, 2, "ada").collect()] == [7, 5]
    assert {r["id"] for r in ranking.latest_by_author(df, 2, 2).collect()} == {3, 1, 2, 0}


def test_activity_and_sizes(spark):
    now = datetime(2024, 3, 31, 12)
    df = spark.createDataFrame([("a", now - timedelta(days=d)) for d in (0, 1, 6, 20, 90)] + [("b", now)], "author string, ts timestamp_ntz")
    r = {r["author"]: r for r in summary.user_activity(df, now).collect()}["a"]
    assert (r["total"], r["last_month"], r["last_week"], r["today"], r["last_entry"]) == (5, 4, 3, 1, now)
    assert summary.topic_sizes(df.withColumnRenamed("author", "topic"), per_page=2).where("topic = 'a'").first()["total_page"] == 3


def test_metadata_lists_topics_as_rows(spark):
    df = spark.createDataFrame([("spor",), ("spor",), ("bilim",)], "topic string")
    rows = [(r["key"], r["value"]) for r in summary.dataset_metadata(df, collected_at=now_fixed()).collect()]
    assert sorted(rows) == [("collected_at", "2024-01-01 00:00:00"), ("topic", "bilim"), ("topic", "spor"), ("total_entries", "3")]


def now_fixed():
    return datetime(2024, 1, 1)


def test_samples_by_threshold_equal_sorting(spark):
    import hashlib
    rows = [(i, "hot" if i % 3 else None) for i in range(4000)] + [(5000 + i, "few") for i in range(7)]
    df = spark.createDataFrame(rows, "id long, s string")
    for n in (1, 5, 50, 2666, 3000):
        for border in (1, 40, 1000):
            got = sorted(r.id for r in ranking.stratified_sample(df, "s", "id", n, seed=9, border_rows=border).collect())
            want = [i for s in ("hot", None, "few") for i in sorted(
                (i for i, x in rows if x == s), key=lambda i: hashlib.md5(f"9-{i}".encode()).hexdigest())[:n]]
            assert got == sorted(want), (n, border)
    plan = ranking.stratified_sample(df, "s", "id", 2000)._jdf.queryExecution().optimizedPlan().toString()
    # The one window of the plan is over border rows, which the threshold has cut out before.
    assert plan.count("Window") == 1 and "_prefix" in plan[plan.index("Window"):]
    assert ranking.stratified_sample(df.limit(0), "s", "id", 3).collect() == []
