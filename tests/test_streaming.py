import random
from datetime import datetime, timedelta

import numpy as np

from postlens.operators import scoring
from postlens.plans import activity
from postlens.streaming import jobs, outages

EVENTS = "event_id int, user_id int, ts timestamp_ntz, event_type string, value double"
START = datetime(2024, 1, 1)


def _events(spark, n=4000, seed=3):
    """One source makes most of the calls."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([1] * 6 + [2, 3]), START + timedelta(seconds=rng.uniform(0, 20000)),
             rng.choice(["error", "error", "view"]), rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, EVENTS)


def _outages(rows, ttl):
    found = set()
    for user in {r[1] for r in rows}:
        until = None
        for t in sorted(r[2] for r in rows if r[1] == user and r[3] == "error"):
            if until is None or t >= until:
                found.add((user, t))
                until = t + timedelta(seconds=ttl)
    return found


def test_outages_equal_the_plain_chain(spark):
    rows, df = _events(spark)
    for ttl, block, fan_in in ((30, 4096, 16), (30, 5, 2), (7, 3, 3), (400, 16, 4), (5000, 2, 2), (50000, 7, 16)):
        got = outages.outage_windows(df, ttl, block=block, fan_in=fan_in).collect()
        assert {(r["user_id"], r["outage_start"]) for r in got} == _outages(rows, ttl), (ttl, block)
        assert len(got) == len(_outages(rows, ttl))


def test_step_functions_compose_to_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        times = np.unique([rng.randrange(3000) for _ in range(rng.randrange(2, 200))])
        ttl, cuts = rng.choice([1, 7, 60, 500, 4000]), sorted(rng.sample(range(1, len(times)), min(5, len(times) - 1)))
        parts = [outages.step_of(p, ttl) for p in np.split(times, cuts)]
        together, half = outages.compose_all(parts, ttl), len(parts) // 2
        for until in [outages.NEVER, *range(int(times[0]) - 5, int(times[0]) + ttl + 1, max(1, ttl // 40))]:
            found = outages.chain(times, until, ttl)
            end = found[-1] + ttl if found else until
            assert outages.apply_step(together, until) == end
            # Associative: the grouping does not matter.
            if half:
                split = outages.compose_all([outages.compose_all(parts[:half], ttl), outages.compose_all(parts[half:], ttl)], ttl)
                assert outages.apply_step(split, until) == end
        # No more steps than failures that an earlier outage can meet.
        assert len(together[0]) <= np.searchsorted(times, times[0] + ttl) + 1


def test_outages_without_failures_and_with_odd_rows(spark):
    assert outages.outage_windows(spark.createDataFrame([], EVENTS), 30).collect() == []
    rows = [(1, None, START, "error", 0.0), (2, 1, None, "error", 0.0), (3, 1, START, "error", 0.0), (4, 1, START, "error", 0.0), (5, 2, START, None, 0.0)]
    assert [(r.user_id, r.outage_start) for r in outages.outage_windows(spark.createDataFrame(rows, EVENTS), 30).collect()] == [(1, START)]


def test_a_hot_source_spreads_over_blocks(spark):
    _, df = _events(spark, 3000)
    blocks = outages.failure_blocks(df, "user_id", "ts", "event_type = 'error'", 50)
    sizes = [(r["key"], r["n"], len(r["times"])) for r in blocks.collect()]
    assert max(s for _, _, s in sizes) <= 50
    for key in {k for k, _, _ in sizes}:
        numbers = sorted(n for k, n, _ in sizes if k == key)
        assert numbers == list(range(len(numbers)))
    assert max(sum(k == key for k, _, _ in sizes) for key in (1, 2, 3)) > 20


def test_outage_fixture(spark):
    calls = [(i, 1, START + timedelta(seconds=s), kind, 0.0) for i, (s, kind) in enumerate(
        [(0, "error"), (10, "view"), (29, "error"), (30, "error")])]
    df = spark.createDataFrame(calls, EVENTS)
    found = outages.outage_windows(df, 30)
    assert {(r["outage_start"] - START).seconds for r in found.collect()} == {0, 30}
    refused = outages.refused_calls(df, found, 30).collect()
    assert {r["event_id"] for r in refused} == {1, 2}


def _streamed(spark, folder, batches, ttl, lateness):
    """Run the batches one after the other, then an event of another source that ends all waiting; the rows and the state left."""
    closing = [(-1, 99, START + timedelta(days=400), "view", 0.0)]
    for part in [*batches, closing]:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (outages.outage_stream(stream, ttl, lateness_seconds=lateness).writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def _at(*seconds, user=1):
    return [(i, user, START + timedelta(seconds=s), "error", 0.0) for i, s in enumerate(seconds)]


def test_outage_stream_takes_rows_in_any_order(spark, tmp_path):
    rows, _ = _events(spark, 600)
    random.Random(5).shuffle(rows)
    got, left = _streamed(spark, tmp_path, [rows[i::4] for i in range(4)], 30, 30_000)
    assert not any(r["late"] for r in got)
    assert {(r["user_id"], r["outage_start"]) for r in got} == _outages(rows, 30) and len(got) == len(_outages(rows, 30))
    assert left == 0  # all state has expired


def test_outage_stream_puts_earlier_failures_first(spark, tmp_path):
    got, _ = _streamed(spark, tmp_path, [_at(100, 110), _at(0, 10)], 30, 600)
    assert {(r["outage_start"] - START).seconds for r in got} == {0, 100} and not any(r["late"] for r in got)


def test_outage_stream_sets_late_failures_aside(spark, tmp_path):
    got, left = _streamed(spark, tmp_path, [_at(100, 110), _at(1000, user=2), _at(50, 960), _at(5000, user=2)], 30, 200)
    seconds = {((r["outage_start"] - START).seconds, r["late"], r["outage_end"] is None) for r in got if r["user_id"] == 1}
    assert seconds == {(100, False, False), (50, True, True), (960, False, False)} and left == 0


def test_outage_stream_keeps_the_state_of_many_sources_in_few_groups(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, f"s{rng.randrange(400)}", START + timedelta(seconds=rng.randrange(5000)), "error", 0.0) for i in range(3000)]
    schema = EVENTS.replace("user_id int", "user_id string")
    for part in [*(rows[i::3] for i in range(3)), [(-1, "other", START + timedelta(days=1), "view", 0.0)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (outages.outage_stream(stream, 400, lateness_seconds=6000, groups=5).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) == 5 and held[-1] == 0
    got = spark.read.parquet(f"{tmp_path}/out").where("not late").collect()
    assert {(r["user_id"], r["outage_start"]) for r in got} == _outages(rows, 400) and len(got) == len(_outages(rows, 400))


def test_scored_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "Harika. " * (i % 12) + "Rezalet.") for i in range(60)], "doc_id int, text string")
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    stream = jobs.post_stream(spark, source, docs.schema, files_per_trigger=1)
    jobs.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = scoring.analyse_sentiment(docs)
    assert streamed.count() == 60 and streamed.exceptAll(batch.select(streamed.columns)).count() == 0


def test_table_streams_read_files_and_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the and. of de. " * (i % 3)) for i in range(40)], "doc_id long, text string")
    events = spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i % 3), i % 4, "view", 1.0) for i in range(60)],
                                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    for kind, pieces in (("folder", 3), ("file", 1)):
        for name, rows in (("documents", docs), ("events", events)):
            at = tmp_path / kind / f"{name}.parquet"
            rows.repartition(pieces).write.parquet(str(at))
            if kind == "file":
                whole = next(at.glob("part-*")).read_bytes()
                at.rename(tmp_path / f"{name}-written")
                at.write_bytes(whole)
        found = activity.score_stream(spark, str(tmp_path / kind)).collect()
        assert sorted(r.doc_id for r in found) == list(range(40))
        batch = {tuple(r) for r in activity.rate_audit(spark, str(tmp_path / kind)).collect()}
        rates = {tuple(r) for r in activity.rate_audit_stream(spark, str(tmp_path / kind)).collect()}
        assert batch and rates == batch


def test_rate_audit(spark):
    rows = [(i, 1, START + timedelta(minutes=i), "view", 0.0) for i in range(20)]
    got = [(r["window_start"], r["requests"]) for r in jobs.rate_audit(spark.createDataFrame(rows, EVENTS), limit=10).collect()]
    assert got == [(START, 15)]


def test_daily_refresh_takes_late_entries(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "daily")
    schema = "id int, ts timestamp_ntz, fav_count int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.daily_refresh(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "state"),
                           str(tmp_path / "history"), 1).awaitTermination()
        stored = spark.read.schema("id int, day date").parquet(table)
        return {(str(r["day"]), r["id"]) for r in stored.collect()}

    assert arrive([(1, datetime(2024, 1, 1, 10), 3)]) == set()
    assert arrive([(2, datetime(2024, 1, 2, 3), 5), (3, datetime(2024, 1, 2, 5), 1)]) == {("2024-01-01", 2)}
    assert arrive([(4, datetime(2024, 1, 1, 11), 99), (5, datetime(2024, 1, 3, 5), 1)]) == {("2024-01-01", 4), ("2024-01-02", 3)}
    assert arrive([(6, datetime(2024, 1, 2, 9), 7)]) == {("2024-01-01", 4), ("2024-01-02", 6)}
    assert arrive([(7, datetime(2023, 12, 31, 9), 1)]) == {("2023-12-31", 7), ("2024-01-01", 4), ("2024-01-02", 6)}


def test_daily_state_is_a_short_list_a_day(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, START + timedelta(hours=rng.uniform(0, 24 * 9)), rng.randrange(50)) for i in range(900)]
    schema = "id int, ts timestamp_ntz, fav_count int"
    for part in range(9):
        spark.createDataFrame(rows[part::9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.daily_refresh(stream, str(tmp_path / "daily"), str(tmp_path / "state"), str(tmp_path / "history"), 4).awaitTermination()
    days = {}
    for i, ts, fav in rows:
        days.setdefault((ts - timedelta(hours=4)).date(), []).append((-fav, i))
    want = {(d, r + 1, i) for d, x in days.items() if d < max(days) for r, (_, i) in enumerate(sorted(x)[:4])}
    got = spark.read.parquet(str(tmp_path / "daily"))
    assert {(r.day, r["rank"], r.id) for r in got.collect()} == want
    held = spark.read.parquet(str(tmp_path / "history" / "best")).groupBy("day").count().collect()
    assert len(held) == len(days) and max(r["count"] for r in held) == 4


def test_scoring_needs_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = scoring.analyse_sentiment(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
