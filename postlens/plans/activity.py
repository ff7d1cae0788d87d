"""Queries over time: authors, days, rates, outages, and the streaming jobs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from postlens.operators import ranking, scoring, search, summary
from postlens.plans import common as c
from postlens.plans.common import LEXICON, Query, table
from postlens.session import materialize, scratch_path
from postlens.sources import snapshots
from postlens.streaming import jobs, outages

AS_OF = datetime(2024, 1, 29, 12, 0)
TTL = 6 * 3600
KEYS = {"ts": "ts", "favourites": "value", "id_column": "event_id"}


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def user_activity(spark, folder):
    return summary.user_activity(_events(spark, folder), AS_OF, "user_id")


def daily_best(spark, folder):
    return ranking.daily_best(_events(spark, folder), 5, **KEYS).select("day", "rank", "event_id", "value")


def daily_entries(spark, folder):
    best = ranking.daily_best(_events(spark, folder), 5, **KEYS).where("day = date'2024-01-10'")
    ids = best.select(F.col("rank").alias("pos"), F.col("event_id").alias("id"))
    return search.daily_entries(ids, _events(spark, folder).withColumnRenamed("event_id", "id")).select("pos", "id", "user_id", "value")


def daily_snapshot(spark, folder):
    """Asked twice: the second call reads what the first one stored."""
    path = scratch_path(spark, "daily")
    first = snapshots.daily_snapshot(_events(spark, folder), path, date(2024, 1, 10), 5, **KEYS)
    first.count()
    return snapshots.daily_snapshot(_events(spark, folder), path, date(2024, 1, 10), 5, **KEYS).select("day", "rank", "event_id")


def rate_audit(spark, folder):
    return jobs.rate_audit(_events(spark, folder), limit=1)


def outage_windows(spark, folder):
    return outages.outage_windows(_events(spark, folder), TTL)


def refused_calls(spark, folder):
    events = _events(spark, folder)
    return outages.refused_calls(events, outage_windows(spark, folder), TTL).select("event_id", "user_id", "outage_start")


def _stream(spark, folder, name):
    # A table is a file or a folder of files; as a pattern, the path may name either.
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.[p]arquet")


def _drained(query):
    query.awaitTermination()
    return query


def score_stream(spark, folder):
    sink, state = scratch_path(spark, "scored"), scratch_path(spark, "state")
    docs = _stream(spark, folder, "documents").select("doc_id", "text")
    _drained(jobs.score_stream(docs, sink, state, "text", scoring.lexicon_scorer(LEXICON)))
    return spark.read.parquet(sink).select("doc_id", "sentiment", "confidence", "score", "label")


def rate_audit_stream(spark, folder):
    sink, state = scratch_path(spark, "rates"), scratch_path(spark, "state")
    found = jobs.rate_audit(_stream(spark, folder, "events"), limit=1)
    # Update mode: the last state of every window, whether or not the watermark has passed it.
    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    _drained(found.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    rows = spark.read.parquet(sink)
    return rows.groupBy("window_start", "user_id").agg(F.max("requests").alias("requests"))


ARRIVAL_HOURS, DELAY_HOURS, FILES = 96, 48, 2


def _arrivals(spark, folder, closing_hours=None):
    """The events as files that arrive out of order: each event up to two days late, ``FILES`` files for every four days.

    ``closing_hours`` adds a last file with one event of another kind, so much later than all others.
    """
    path = scratch_path(spark, "arrivals")
    hours = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) + F.col("event_id") * 37 % DELAY_HOURS
    events = materialize(_events(spark, folder).withColumn("slot", F.floor(hours / ARRIVAL_HOURS)), "arrivals")
    # One value per four days.
    for row in events.select("slot").distinct().orderBy("slot").collect():
        events.where(F.col("slot") == row["slot"]).drop("slot").repartition(FILES, "event_id").write.mode("append").parquet(path)
    if closing_hours:
        last = events.agg(F.max("ts").alias("ts")).select(
            F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.make_dt_interval(hours=F.lit(closing_hours))).alias("ts"),
            F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"))
        last.write.mode("append").parquet(path)
    return jobs.post_stream(spark, path, events.drop("slot").schema, FILES)


def _outage_rows(spark, folder, lateness_hours, closing_hours=None):
    sink, state = scratch_path(spark, "outages"), scratch_path(spark, "state")
    found = outages.outage_stream(_arrivals(spark, folder, closing_hours), TTL, lateness_seconds=lateness_hours * 3600)
    _drained(found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    return spark.read.parquet(sink)


def outage_stream(spark, folder):
    return _outage_rows(spark, folder, 72, closing_hours=100).where("not late").drop("late")


def late_failures(spark, folder):
    """Failures that come more than a day behind the newest event of earlier files."""
    return _outage_rows(spark, folder, 24).where("late").select("user_id", F.col("outage_start").alias("ts"))


def daily_refresh(spark, folder):
    path, state, history = (scratch_path(spark, x) for x in ("daily", "state", "history"))
    source = scratch_path(spark, "arrivals")
    events = table(spark, folder, "events").drop("props")
    # Files that each hold a random part of all days, one to a micro-batch.
    events.repartition(6, "event_id").write.parquet(source)
    _drained(jobs.daily_refresh(jobs.post_stream(spark, source, events.schema, 1), path, state, history, 5, **KEYS))
    return spark.read.parquet(path).select("day", "rank", "event_id")


_DAYS = """days AS (SELECT *, (ts - INTERVAL 4 HOURS)::DATE AS day FROM events),
best AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS rank FROM days QUALIFY rank <= 5)"""
_OUTAGES = """e AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error'),
o AS (SELECT user_id, min(ts) AS outage_start FROM e GROUP BY user_id
  UNION ALL SELECT o.user_id, min(e.ts) FROM o JOIN e ON e.user_id = o.user_id AND e.ts >= o.outage_start + INTERVAL 6 HOURS
  GROUP BY o.user_id)"""
_AUDIT = """SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS window_start, user_id, count(*) AS requests FROM events
GROUP BY ALL HAVING count(*) > 1"""

QUERIES = {
    "user_activity": Query(user_activity, """
WITH a AS (SELECT *, TIMESTAMP '2024-01-29 12:00:00' AS t FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (ts BETWEEN t - INTERVAL 30 DAYS AND t) AS last_month,
  count(*) FILTER (ts BETWEEN t - INTERVAL 7 DAYS AND t) AS last_week,
  count(*) FILTER (ts BETWEEN date_trunc('day', t) AND t) AS today, max(ts) AS last_entry FROM a GROUP BY user_id"""),
    "daily_best": Query(daily_best, f"WITH {_DAYS} SELECT day, rank, event_id, value FROM best"),
    "daily_entries": Query(daily_entries, f"WITH {_DAYS} SELECT rank AS pos, event_id AS id, user_id, value FROM best WHERE day = '2024-01-10'"),
    "daily_snapshot": Query(daily_snapshot, f"WITH {_DAYS} SELECT day, rank, event_id FROM best WHERE day = '2024-01-10'"),
    "rate_audit": Query(rate_audit, _AUDIT),
    "outage_windows": Query(outage_windows, f"""
WITH RECURSIVE {_OUTAGES} SELECT user_id, outage_start, outage_start + INTERVAL 6 HOURS AS outage_end FROM o"""),
    "refused_calls": Query(refused_calls, f"""
WITH RECURSIVE {_OUTAGES} SELECT event_id, user_id, outage_start FROM events JOIN o USING (user_id)
WHERE ts > outage_start AND ts < outage_start + INTERVAL 6 HOURS"""),
    "score_stream": Query(score_stream, f"WITH {c.sql_sentiment()} SELECT doc_id, sentiment, confidence, score, label FROM voted"),
    "rate_audit_stream": Query(rate_audit_stream, _AUDIT),
    "outage_stream": Query(outage_stream, f"""
WITH RECURSIVE {_OUTAGES} SELECT user_id, outage_start, outage_start + INTERVAL 6 HOURS AS outage_end FROM o"""),
    "late_failures": Query(late_failures, f"""
WITH a AS (SELECT *, floor((floor(epoch(ts) / 3600) + event_id * 37 % {DELAY_HOURS}) / {ARRIVAL_HOURS}) AS slot FROM events),
m AS (SELECT slot, max(max(ts)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a GROUP BY slot)
SELECT DISTINCT user_id, ts FROM a JOIN m USING (slot)
WHERE event_type = 'error' AND ts < date_trunc('milliseconds', newest) - INTERVAL 24 HOURS"""),
    "daily_refresh": Query(daily_refresh, f"""
WITH {_DAYS} SELECT day, rank, event_id FROM best WHERE day < (SELECT max(day) FROM days)"""),
}
