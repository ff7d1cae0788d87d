"""Outage windows: after a failed call, calls are refused for a fixed time.

A refused call cannot fail, so it does not extend the outage: the next outage
starts at the first failure at or after the end of the current one. That chain
is order-dependent, yet it need not be followed by one task per source.

A stretch of failures acts on the end of an incoming outage as a monotone step
function: it maps that end to the end of the last outage that begins in the
stretch. Such functions compose, and composition is associative. So the sorted
failures are cut into blocks of bounded size, wherever they lie; each block
yields its function, functions are composed in a tree with bounded fan-in, and
the tree hands every block the end of the outage it starts with. Then all
blocks list their outages at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlens.operators.ranking import rank_within
from postlens.operators.rows import unnest
from postlens.session import materialize

MICROS = 1_000_000
NEVER = np.iinfo(np.int64).min
#: Failures in one block, and functions that are composed in one step.
BLOCK, FAN_IN = 4096, 16
#: A late row is seen, not dropped by the engine, while it is less than this older than the newest one.
LATE_DAYS = 36_500
#: Groups of sources that share state in a stream.
GROUPS = 1024

Step = tuple[np.ndarray, np.ndarray]
_LONGS = T.ArrayType(T.LongType())
_STEP = T.StructType([T.StructField("bounds", _LONGS), T.StructField("outs", _LONGS)])


# --- step functions -----------------------------------------------------------------------------

def step_of(times: np.ndarray, ttl: int) -> Step:
    """Step function of sorted failures: an outage ending at or before ``bounds[i]`` leads to one ending at ``outs[i]``.

    An outage that ends after the last bound is not changed.
    """
    following = np.searchsorted(times, times + ttl)
    ends = times + ttl
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            ends[i] = ends[following[i]]
    return _slim(times, ends, int(times[0]) + ttl)


def _slim(bounds: np.ndarray, outs: np.ndarray, reach: int) -> Step:
    """Without steps of no height, and without those that no outage from before the first bound can meet."""
    used = min(len(bounds), int(np.searchsorted(bounds, reach)) + 1)
    bounds, outs = bounds[:used], outs[:used]
    high = np.append(outs[1:] != outs[:-1], True)
    return bounds[high], outs[high]


def apply_step(step: Step, until: int) -> int:
    at = int(np.searchsorted(step[0], until))
    return int(step[1][at]) if at < len(step[0]) else until


def compose(first: Step, second: Step, reach: int) -> Step:
    """First ``first``, then ``second``, whose bounds lie after those of ``first``."""
    through = np.searchsorted(second[0], first[1])
    inside = through < len(second[0])
    outs = np.where(inside, second[1][np.minimum(through, len(second[0]) - 1)], first[1])
    later = second[0] > first[0][-1]
    return _slim(np.concatenate([first[0], second[0][later]]), np.concatenate([outs, second[1][later]]), reach)


def compose_all(steps: list[Step], ttl: int) -> Step:
    """Composition of functions in order; it meets outages that begin before ``first bound`` only."""
    reach = int(steps[0][0][0]) + ttl
    whole = steps[0]
    for step in steps[1:]:
        whole = compose(whole, step, reach)
    return whole


def chain(times: np.ndarray, until: int, ttl: int) -> list[int]:
    """Starts of the outages among sorted failures when the current one ends at ``until``."""
    found, i = [], int(np.searchsorted(times, until))
    while i < len(times):
        found.append(int(times[i]))
        i = int(np.searchsorted(times, times[i] + ttl))
    return found


# --- batch --------------------------------------------------------------------------------------

def _cut(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, at)`` rows to blocks ``(key, first, times)`` of at most ``size`` failures of one key."""
    key, times, keys, firsts, blocks = None, [], [], [], []

    def close() -> None:
        nonlocal times
        if times:
            keys.append(key)
            firsts.append(times[0])
            blocks.append(times)
            times = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(firsts, pa.int64()),
                                           pa.array(blocks, pa.list_(pa.int64()))], schema=schema)
        keys.clear(), firsts.clear(), blocks.clear()
        return made

    for rows in batches:
        for k, at in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if k != key or len(times) >= size:
                close()
                key = k
            times.append(at)
        if len(blocks) >= 256:
            yield batch()
    close()
    yield batch()


def failure_blocks(events: DataFrame, key: str, ts: str, failed: str, size: int = BLOCK) -> DataFrame:
    """``(key, n, times)``: the distinct failures of every source in order, cut into blocks n = 0, 1, 2 …

    Failures are range-partitioned by source and time, so one source may fill
    many partitions; a block never crosses one. Rows without source or time are
    no failures.
    """
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    failures = events.where(failed).select(F.col(key).alias("key"), moment.alias("at")).where(
        "key is not null and at is not null").distinct()
    by = ["key", "at"]
    sorted_rows = failures.repartitionByRange(*by).sortWithinPartitions(*by)
    out = T.StructType([failures.schema["key"], T.StructField("first", T.LongType()), T.StructField("times", _LONGS)])
    arrow = pa.schema([("key", _arrow_type(failures)), ("first", pa.int64()), ("times", pa.list_(pa.int64()))])
    blocks = materialize(sorted_rows.mapInArrow(partial(_cut, size=size, schema=arrow), out), "failures")
    numbers = rank_within(blocks.select("key", "first"), ["key"], ["first"], "n")
    return materialize(blocks.join(numbers, ["key", "first"]).select("key", (F.col("n") - 1).alias("n"), "times"), "blocks")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema["key"].dataType)


def incoming_ends(steps: DataFrame, ttl: int, fan_in: int = FAN_IN) -> DataFrame:
    """``(key, n, until)``: the end of the outage that every function of ``(key, n, step)`` starts with.

    Up the tree, ``fan_in`` neighbours become one function; down again, each
    function hands its incoming end to its parts. The number of levels is the
    logarithm of the largest number of blocks of a source.
    """
    @F.pandas_udf(_STEP)
    def together(bounds: pd.Series, outs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compose_all(list(zip(b, o)), ttl) for b, o in zip(bounds, outs)], columns=["bounds", "outs"])

    @F.pandas_udf(_LONGS)
    def handed(bounds: pd.Series, outs: pd.Series, until: pd.Series) -> pd.Series:
        rows = []
        for b, o, end in zip(bounds, outs, until):
            row = []
            for step in zip(b, o):
                row.append(end)
                end = apply_step(step, end)
            rows.append(row)
        return pd.Series(rows)

    levels, now = [], steps
    while (now.agg(F.max("n")).first()[0] or 0) > 0:
        # At most fan_in functions a row.
        parts = materialize(now.groupBy("key", F.floor(F.col("n") / fan_in).cast("long").alias("g")).agg(
            F.sort_array(F.collect_list(F.struct("n", "step"))).alias("parts")), "parts")
        levels.append(parts)
        now = materialize(parts.select("key", F.col("g").alias("n"), together("parts.step.bounds", "parts.step.outs").alias("step")), "steps")
    ends = now.select("key", "n", F.lit(int(NEVER)).alias("until"))
    for parts in reversed(levels):
        met = parts.join(ends.withColumnRenamed("n", "g"), ["key", "g"])
        given = F.arrays_zip(F.col("parts.n").alias("n"), handed("parts.step.bounds", "parts.step.outs", "until").alias("until"))
        ends = materialize(unnest(met, ["key"], given, "z").select("key", "z.n", "z.until"), "ends")
    return ends


def outage_windows(events: DataFrame, ttl_seconds: float = 30, key: str = "user_id", ts: str = "ts",
                   failed: str = "event_type = 'error'", block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """``(key, outage_start, outage_end)`` of every outage of every source.

    No array holds more than ``block`` failures, or ``fan_in`` functions; a
    function has a step per failure of one ``ttl`` at most.
    """
    ttl = int(ttl_seconds * MICROS)

    @F.pandas_udf(_STEP)
    def step(times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([step_of(t, ttl) for t in times], columns=["bounds", "outs"])

    @F.pandas_udf(_LONGS)
    def starts(times: pd.Series, until: pd.Series) -> pd.Series:
        return pd.Series([chain(t, u, ttl) for t, u in zip(times, until)])

    blocks = failure_blocks(events, key, ts, failed, block)
    steps = materialize(blocks.select("key", "n", step("times").alias("step")), "steps")
    listed = unnest(blocks.join(incoming_ends(steps, ttl, fan_in), ["key", "n"]), ["key"], starts("times", "until"), "start")
    return _windows(listed, key, ttl)


def _windows(listed: DataFrame, key: str, ttl: int, *more: str) -> DataFrame:
    return listed.select(
        F.col("key").alias(key), F.timestamp_micros("start").cast("timestamp_ntz").alias("outage_start"),
        F.timestamp_micros(F.col("start") + ttl).cast("timestamp_ntz").alias("outage_end"), *more)


def refused_calls(events: DataFrame, outages: DataFrame, ttl_seconds: float = 30, key: str = "user_id",
                  ts: str = "ts") -> DataFrame:
    """Calls made during an outage of their source, with its ``outage_start``.

    Outages of one source do not overlap and last ``ttl``, so each touches two
    time slots at most and the range condition becomes an equi-join on the slot.
    """
    ttl = int(ttl_seconds * MICROS)

    def slot(column: str):
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / ttl).cast("bigint")

    first = slot("outage_start")
    windows = outages.select(F.col(key).alias("_key"), "outage_start", "outage_end",
                             F.explode(F.array(first, first + 1)).alias("_slot_o"))
    calls = events.withColumn("_slot", slot(ts))
    during = ((F.col(key) == F.col("_key")) & (F.col("_slot") == F.col("_slot_o"))
              & (F.col(ts) > F.col("outage_start")) & (F.col(ts) < F.col("outage_end")))
    return calls.join(windows, during).select(*events.columns, "outage_start")


# --- stream -------------------------------------------------------------------------------------

def outage_stream(events: DataFrame, ttl_seconds: float = 30, key: str = "user_id", ts: str = "ts",
                  failed: str = "event_type = 'error'", lateness_seconds: float = 3600, groups: int = GROUPS) -> DataFrame:
    """The outages of a stream whose rows come in any order: ``(key, outage_start, outage_end, late)``.

    Failures wait in keyed state until the watermark, the newest event time seen
    less ``lateness_seconds``, has passed them; then those of a source are followed
    in order. An event-time timer releases them when their source is silent. A
    failure that comes after the watermark has passed it is not followed: it
    leaves as a row with ``late`` true, its time as ``outage_start`` and no end.
    State goes once the last outage is over and nothing waits. The outages are
    those of the batch form if no row is late; the last ``lateness_seconds``
    stay open until a later event of any kind, or any source, moves the watermark.

    State per source: the end of its last outage and its failures of the last
    ``lateness_seconds``. Sources share the state of one of ``groups`` hash groups,
    so a micro-batch calls Python ``groups`` times at most, however many sources
    there are. ``groups`` stays as it is for the life of a checkpoint; raise it
    where a group's share of all waiting failures is too much for one task.
    """
    ttl = int(ttl_seconds * MICROS)
    # The engine drops rows behind the watermark of its event-time column unseen. That column runs ahead of
    # the true time by LATE_DAYS and so does the delay: the watermark is the true one, and late rows arrive.
    ahead = events.withColumn("_clock", F.col(ts).cast("timestamp") + F.make_dt_interval(F.lit(LATE_DAYS)))
    delay = f"{LATE_DAYS * 86_400_000 + int(lateness_seconds * 1000)} milliseconds"
    key_type = events.schema[key].dataType
    # In state a source is a number or, if of another type, its text.
    source_type = "bigint" if isinstance(key_type, T.IntegralType) else "string"
    dtype = np.int64 if source_type == "bigint" else object
    # The filter looks at the clock, so that it stays above the watermark and every event moves time on.
    failures = ahead.withWatermark("_clock", delay).where(F.when(F.expr(failed), F.col("_clock")).isNotNull()).where(
        F.col(key).isNotNull()).select(F.col(key).cast(source_type).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), "_clock")
    grouped = failures.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        sources, until, counts, waiting = state.get if state.exists else ([], [], [], [])
        held, parts = len(sources), list(batches)
        # The held sources are distinct, so their numbers are 0, 1, 2 …
        number, names = pd.factorize(np.concatenate([np.asarray(sources, dtype), *[b["key"].to_numpy(dtype) for b in parts]]))
        owner = np.concatenate([np.repeat(np.arange(held), np.asarray(counts, np.int64)), number[held:]])
        at = np.concatenate([np.asarray(waiting, np.int64), *[b["at"].to_numpy(np.int64) for b in parts]])
        came = np.arange(len(at)) >= len(waiting)
        # Distinct failures by source and time; of equal ones, that which waits.
        order = np.lexsort((came, at, owner))
        owner, at, came = owner[order], at[order], came[order]
        fresh = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1]))[:len(at)]
        owner, at, came = owner[fresh], at[fresh], came[fresh]
        passed = at < now * 1000
        late = passed & came & bool(now)
        ends, found = [*until, *[int(NEVER)] * (len(names) - held)], []
        for who, time in zip(owner[passed & ~late].tolist(), at[passed & ~late].tolist()):
            if time >= ends[who]:
                found.append((who, time, False))
                ends[who] = time + ttl
        ends, waits = np.asarray(ends, np.int64), np.bincount(owner[~passed], minlength=len(names))
        keep = (waits > 0) | (ends > now * 1000)
        if keep.any():
            state.update((names[keep].tolist(), ends[keep].tolist(), waits[keep].tolist(), at[~passed].tolist()))
            # A whole millisecond that lies after the first moment of interest and after the watermark.
            first = int(np.concatenate([at[~passed], ends[keep & (waits == 0)]]).min())
            state.setTimeoutTimestamp(max(first // 1000 + 1, now + 1))
        elif state.exists:
            state.remove()
        rows = found + [(who, time, True) for who, time in zip(owner[late].tolist(), at[late].tolist())]
        yield pd.DataFrame({"key": names[[r[0] for r in rows]] if rows else np.zeros(0, dtype),
                            "start": pd.Series([r[1] for r in rows], dtype="int64"), "late": pd.Series([r[2] for r in rows], dtype="bool")})

    held_type = f"sources array<{source_type}>, until array<bigint>, counts array<bigint>, waiting array<bigint>"
    listed = grouped.groupBy("group").applyInPandasWithState(
        step, f"key {source_type}, start bigint, late boolean", held_type, "append", GroupStateTimeout.EventTimeTimeout)
    found = _windows(listed.withColumn("key", F.col("key").cast(key_type)), key, ttl, "late")
    return found.withColumn("outage_end", F.when(~F.col("late"), F.col("outage_end")))
