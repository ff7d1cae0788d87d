"""Streaming forms of the jobs; each shares its logic with the batch form."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postlens.operators import scoring
from postlens.operators.ranking import day_key, top_k
from postlens.session import materialize


def post_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def score_stream(posts: DataFrame, sink: str, checkpoint: str, column: str = "text",
                 scorer: scoring.Scorer | scoring.ModelScorer | None = None) -> StreamingQuery:
    """Score posts as files arrive and append them to a Parquet table.

    The vote runs inside each row, so the stream keeps no state; the checkpoint
    gives exactly-once output and resumes after a stop.
    """
    scored = scoring.analyse_sentiment(posts, column, scorer)
    return (scored.writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def rate_audit(events: DataFrame, window: str = "15 minutes", limit: int = 100, ts: str = "ts",
               client: str = "user_id", late: str = "15 minutes") -> DataFrame:
    """Clients with more than ``limit`` requests in a fixed window (batch or stream)."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = timed.withWatermark(ts, late) if events.isStreaming else timed
    counts = source.groupBy(F.window(F.col(ts), window).alias("w"), client).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col(client), "requests")


def daily_refresh(entries: DataFrame, path: str, checkpoint: str, history: str, k: int = 50,
                  ts: str = "ts", favourites: str = "fav_count", id_column: str = "id") -> StreamingQuery:
    """Keep the daily table up to date while entries arrive, in any order.

    The state of a day, below ``history``, is its best ``k`` entries so far: lists
    that merge. A micro-batch merges its own best entries into the states of its
    days and writes the lists of those that are closed, which a day is once a
    later one has begun. It reads the states of these days and a note of the
    newest day, by name; what came before has no other files. Merging the same
    entries again changes nothing, so a repeated micro-batch is safe.
    """
    order = [F.col(favourites).desc(), F.col(id_column)]

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("day", day_key(F.col(ts)))
        fresh = materialize(top_k(dated.where("day is not null"), ["day"], order, k).drop("rank"), "fresh")
        # One value per calendar day of the micro-batch.
        days = {row[0] for row in fresh.select("day").distinct().collect()}
        before = _newest_day(spark, f"{history}/newest/batch={batch_id - 1}")
        newest = max([*days, *([before] if before else [])], default=None)
        if newest is None:
            return
        touched = sorted(days | ({before} if before else set()))
        held = [f"{history}/best/day={day}" for day in touched if _exists(spark, f"{history}/best/day={day}")]
        known = fresh
        if held:
            old = spark.read.schema(fresh.schema).option("basePath", f"{history}/best").parquet(*held)
            known = old.select(fresh.columns).unionByName(fresh).dropDuplicates(["day", id_column])
        best = materialize(top_k(known, ["day"], order, k), "best")
        _overwrite_days(best.drop("rank"), f"{history}/best")
        _overwrite_days(best.where(F.col("day") < F.lit(newest)), path)
        spark.createDataFrame([(newest,)], "day date").coalesce(1).write.mode("overwrite").parquet(f"{history}/newest/batch={batch_id}")

    return (entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _newest_day(spark: SparkSession, path: str) -> date | None:
    return spark.read.schema("day date").parquet(path).first()[0] if _exists(spark, path) else None


def _overwrite_days(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
