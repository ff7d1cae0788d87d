"""Hard negatives of anchor vectors by threshold joins with suffix-norm bounds.

For every anchor two threshold joins run against all rows: one for its nearest
rows of the same label (the positives), then one for rows of other labels whose
score lies in a window below each positive's score.

A join deals all rows to cells of (block of anchors, bucket of rows). Inside a
cell the anchors come first and stay in memory, at most ``ANCHOR_BLOCK`` of
them; the rows stream past in chunks and are not kept. For each chunk an
inverted index maps groups of dimensions to the rows that have them indexed.
The index leaves out a row's last dimensions when the norm of that suffix,
times the largest one among the anchors, cannot reach the threshold. Partial
scores are accumulated group by group; after each group a pair goes as soon as
its partial score and the product of both remaining norms (Cauchy-Schwarz) stay
below the anchor's threshold. What is left is scored in full.

Thresholds start high, just below the upper end of the windows. A window that
finds too few rows is joined again with a lower threshold, at last with its
lower end. Inside a task a full window raises its own threshold to the score of
its last row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Query, stage, table
from postlens.operators.ranking import top_k

SCALE = 256
#: Anchors that one task holds at a time.
ANCHOR_BLOCK = 32_768
#: Rows of one cell, about.
ROWS_PER_CELL = 65_536
#: Anchors and rows of one step inside a task, and dimensions of one posting group.
STEP, CHUNK, GROUP = 256, 4096, 8
#: First thresholds in percent of the positive's score; the last round always takes the whole window.
STEPS = (85, 60)
#: Pairs are scored in full once at most this share of them is left.
FEW = 1 / 16

_ROW = "row long, id long, label long, anchor boolean, wide boolean, vector binary"
_HIT = pa.schema([("anchor_row", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
HIT = "anchor_row long, slot int, row long, id long, score long"


# --- rows ---------------------------------------------------------------------------------------

def _quantised(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Each component x becomes floor(scale * x), packed in 16 or 64 bits."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("wide", pa.bool_()),
                        ("vector", pa.binary())])
    for batch in batches:
        lists = batch.column(4)
        flat = np.floor(scale * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64))
        if len(flat) and np.abs(flat).max() >= 2.0 ** 62:
            raise OverflowError("a scaled component does not fit in 63 bits")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        wide, packed = [], []
        for a, b in zip(ends, ends[1:]):
            values = flat[a:b]
            wide.append(bool(b > a and (values.min() < -32768 or values.max() > 32767)))
            packed.append(values.astype("<i8" if wide[-1] else "<i2").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(wide, pa.bool_()), pa.array(packed, pa.binary())], schema=schema)


def usable_rows(rows: DataFrame, is_anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding",
                label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """Stored rows with label and finite vector: ``(row, id, label, anchor, wide, vector)``, scaled to whole numbers."""
    chosen = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long"), F.col(label_col).cast("long"),
        F.coalesce(chosen, F.lit(False)), F.col(vector_col).cast("array<double>"))
    return stage(sound.mapInArrow(partial(_quantised, scale=scale), _ROW), "vectors")


# --- one task -----------------------------------------------------------------------------------

def _matrix(wide: list, vectors: list) -> np.ndarray:
    """Vectors as rows of whole numbers, shorter ones filled up with zeros."""
    if not any(wide) and len({len(v) for v in vectors}) == 1 and vectors[0]:
        return np.frombuffer(b"".join(vectors), "<i2").reshape(len(vectors), -1)
    parts = [np.frombuffer(v, "<i8" if w else "<i2") for w, v in zip(wide, vectors)]
    filled = np.zeros((len(parts), max(map(len, parts))), np.int64)
    for i, p in enumerate(parts):
        filled[i, :len(p)] = p
    return filled


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


def _suffix_norms(matrix: np.ndarray) -> np.ndarray:
    """Norm of what is left of each row from every group of dimensions on, rounded up a little."""
    squares = matrix.astype(np.float64) ** 2
    left = np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(matrix), 1))], axis=1)
    starts = [*range(0, matrix.shape[1], GROUP), matrix.shape[1]]
    return np.sqrt(left[:, starts]) * (1 + 1e-6)


class _Windows:
    """The best rows of every window of every anchor of a block, and the thresholds that follow from them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.astype(np.float64), high.astype(np.float64), k
        self.slots = low.shape[1]
        # (key, score, row without id, id, row) of the candidates.
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def threshold(self) -> np.ndarray:
        """The lowest score that any window of each anchor can still use."""
        return self.low.min(axis=1)

    def add(self, anchor: np.ndarray, score: np.ndarray, nameless: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        parts = []
        for slot in range(self.slots):
            fits = (score >= self.low[anchor, slot]) & (score <= self.high[anchor, slot])
            parts.append((anchor[fits] * self.slots + slot, score[fits], nameless[fits], ids[fits], rows[fits]))
        joined = [np.concatenate([b, *[p[i] for p in parts]]) for i, b in enumerate(self.best)]
        key, value = joined[0], joined[1]
        order = np.lexsort((joined[4], joined[3], joined[2], -value, key))
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        place = np.arange(len(key)) - np.repeat(new, np.diff(np.r_[new, len(key)]))
        kept = order[place < self.k]
        self.best = [x[kept] for x in joined]
        full = order[place == self.k - 1]
        at = np.unravel_index(joined[0][full], self.low.shape)
        self.low[at] = np.maximum(self.low[at], joined[1][full].astype(np.float64))


class _Block:
    """Anchors of one cell, in the order of dimensions that the join follows."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.rows, self.labels, self.same = rows, labels, same
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.vectors, self.norms = vectors[:, self.order], _norms(vectors)
        self.windows = _Windows(low, high, k)

    def meet(self, rows: np.ndarray, nameless: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        size = max(vectors.shape[1], self.vectors.shape[1])
        ours = np.pad(self.vectors, ((0, 0), (0, size - self.vectors.shape[1])))
        theirs = np.pad(vectors, ((0, 0), (0, size - vectors.shape[1])))
        theirs = theirs[:, np.concatenate([self.order, np.arange(len(self.order), size)])]
        # Sums of whole numbers up to the product of both norms are exact in these types.
        reach = float(self.norms.max()) * float(_norms(theirs).max())
        if reach >= 2.0 ** 63:
            raise OverflowError("a score may not fit in 63 bits")
        kind = np.float32 if reach < 2 ** 24 else np.float64 if reach < 2 ** 53 else np.int64
        theirs_k, theirs_left = theirs.astype(kind), _suffix_norms(theirs)
        for start in range(0, len(ours), STEP):
            part = slice(start, start + STEP)
            meets = self.labels[part, None] == labels[None, :]
            if not self.same:
                meets = ~meets
            meets &= self.rows[part, None] != rows[None, :]
            mine, threshold = ours[part].astype(kind), self.windows.threshold()[part]
            i, j = _survivors(mine, _suffix_norms(ours[part]), theirs_k, theirs_left, threshold, meets)
            if len(i) > FEW * meets.size:
                score = (mine @ theirs_k.T)[i, j].astype(np.int64)
            else:
                score = np.einsum("ij,ij->i", mine[i], theirs_k[j]).astype(np.int64)
            good = score >= threshold[i]
            i, j, score = i[good], j[good], score[good]
            if len(i):
                self.windows.add(i + start, score, nameless[j], ids[j], rows[j])

    def hits(self) -> pa.RecordBatch:
        key, score, nameless, ids, rows = self.windows.best
        anchor, slot = np.divmod(key, self.windows.slots)
        return pa.RecordBatch.from_arrays([
            pa.array(self.rows[anchor]), pa.array(slot.astype(np.int32)), pa.array(rows), pa.array(ids, mask=nameless), pa.array(score)],
            schema=_HIT)


def _survivors(ours: np.ndarray, ours_left: np.ndarray, theirs: np.ndarray, theirs_left: np.ndarray, threshold: np.ndarray,
               alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may reach their anchor's ``threshold``, by accumulated partial scores and remaining norms."""
    groups = ours_left.shape[1] - 1
    lowest = threshold.min()
    if np.isneginf(threshold).all():
        return np.nonzero(alive)
    # A row is indexed up to the first group from which on its suffix cannot matter to any anchor here.
    idle = ours_left.max(axis=0)[None, :] * theirs_left < lowest
    indexed = np.where(idle.any(axis=1), idle.argmax(axis=1), groups)
    partial_scores = np.zeros(alive.shape, np.float64 if ours.dtype == np.int64 else ours.dtype)
    # More than any rounding of the bounds.
    slack = 1 + 1e-6 * float(ours_left[:, 0].max()) * float(theirs_left[:, 0].max())
    # A row whose whole norm is too small has no posting at all.
    alive[:, indexed == 0] = False
    for g in range(groups):
        posting = np.flatnonzero(indexed > g)
        if not len(posting) or np.count_nonzero(alive) <= FEW * alive.size:
            break
        dims = slice(g * GROUP, (g + 1) * GROUP)
        whole = len(posting) == theirs.shape[0]
        gained = ours[:, dims] @ (theirs if whole else theirs[posting])[:, dims].T
        bound = ours_left[:, g + 1, None].astype(np.float32) * theirs_left[posting, g + 1][None, :].astype(np.float32) + slack
        if whole:
            partial_scores += gained
            alive &= partial_scores + bound >= threshold[:, None]
        else:
            partial_scores[:, posting] += gained
            alive[:, posting] &= partial_scores[:, posting] + bound >= threshold[:, None]
    return np.nonzero(alive)


def _join(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a cell, anchors first: ``(cell, is_row, row, id, label, wide, vector, low, high)``."""
    cell, block, anchors, chunk = None, None, [], []

    def finish() -> Iterator[pa.RecordBatch]:
        nonlocal block, anchors
        flow()
        if block is not None:
            yield block.hits()
        block, anchors = None, []

    def flow() -> None:
        nonlocal block, chunk
        if not chunk:
            return
        if block is None and anchors:
            slots = max(len(a[5]) for a in anchors)
            # A window without rows fills up anchors that have fewer windows.
            low, high = np.full((len(anchors), slots), np.inf), np.full((len(anchors), slots), -np.inf)
            for i, a in enumerate(anchors):
                low[i, :len(a[5])], high[i, :len(a[6])] = a[5], a[6]
            block = _Block(np.array([a[0] for a in anchors]), np.array([a[2] for a in anchors]),
                           _matrix([a[3] for a in anchors], [a[4] for a in anchors]), low, high, k, same)
            anchors.clear()
        if block is not None:
            ids = np.array([0 if c[1] is None else c[1] for c in chunk], np.int64)
            block.meet(np.array([c[0] for c in chunk]), np.array([c[1] is None for c in chunk]), ids, np.array([c[2] for c in chunk]),
                       _matrix([c[3] for c in chunk], [c[4] for c in chunk]))
        chunk = []

    for batch in batches:
        for at, is_row, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if at != cell:
                yield from finish()
                cell = at
            if is_row:
                chunk.append(row)
                if len(chunk) >= CHUNK:
                    flow()
            else:
                anchors.append(row)
    yield from finish()


# --- the joins ----------------------------------------------------------------------------------

def threshold_join(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """First ``k`` rows of every window of every anchor: ``(anchor_row, slot, row, id, score, rank)``.

    ``anchors`` are rows with ``low`` and ``high``, arrays of the ends of their
    windows. Higher scores come first, ties by smaller id (null last). ``same``
    asks for rows of the anchor's label, else for those of other labels.
    """
    spark = rows.sparkSession
    # Two counts of stored narrow tables; cells are a function of them alone.
    blocks = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_PER_CELL))
    fields = ["row", "id", "label", "wide", "vector", "low", "high"]

    def cells(block: Column, bucket: Column) -> Column:
        return (block * buckets + bucket).cast("int").alias("cell")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = F.lit(None).cast("array<double>")
    placed = rows.withColumn("b", each(blocks)).select(
        cells(F.col("b"), F.pmod(F.xxhash64("row"), F.lit(buckets))), F.lit(True).alias("is_row"),
        *[none.alias(f) if f in ("low", "high") else F.col(f) for f in fields])
    held = anchors.withColumn("b", each(buckets)).select(
        cells(F.pmod(F.xxhash64("row"), F.lit(blocks)), F.col("b")), F.lit(False).alias("is_row"), *fields)
    joined = held.unionByName(placed).repartitionById(blocks * buckets, F.col("cell")).sortWithinPartitions("cell", "is_row").mapInArrow(
        partial(_join, k=k, same=same), HIT)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    return stage(top_k(stage(joined, "cell-hits"), ["anchor_row", "slot"], order, k), "hits")


def mine(rows: DataFrame, is_anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, steps: tuple = STEPS, scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows without label, without vector, or with a null or non-finite component
    take no part. Scores are inner products of the scaled vectors, a shorter
    vector filled up with zeros. The positives of an anchor are its first
    ``positives`` other rows of the same label; the negatives of a positive are
    the first ``negatives`` rows of other labels with a score from ``low`` to
    ``high`` percent of the positive's (none if that score is negative). Higher
    scores come first, ties by smaller id, a null id last. Rows that repeat an
    id are rows of their own, also as anchors; a row is never its own positive.
    An empty table, or one without anchors, gives an empty result. Other columns
    are ignored, whatever their names. Scores must fit in 63 bits.
    """
    stored = usable_rows(rows, is_anchor, id_col, vector_col, label_col, scale)
    anchors = stored.where("anchor")

    def windows(lows: Column, highs: Column) -> list[Column]:
        return [lows.cast("array<double>").alias("low"), highs.cast("array<double>").alias("high")]

    everything = windows(F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf"))))
    near = threshold_join(anchors.select("*", *everything), stored, positives, True).select(
        "anchor_row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Whole numbers: 100 * score between low * p and high * p.
    p = F.col("positive_score")
    floor = F.when(p >= 0, F.ceil(p.cast("decimal(20,0)") * low / 100)).cast("long")
    ceiling = F.when(p >= 0, F.floor(p.cast("decimal(20,0)") * high / 100)).cast("long")
    open_windows = stage(near.where(p >= 0).select("*", floor.alias("floor"), ceiling.alias("ceiling")), "windows")
    found = None
    for percent in [*steps, None]:
        start = F.col("floor") if percent is None else F.greatest(
            F.col("floor"), F.least(F.col("ceiling"), F.ceil(p.cast("decimal(20,0)") * percent / 100).cast("long")))
        asked = open_windows.withColumn("start", start)
        packed = asked.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "start", "ceiling"))).alias("w"))
        placed = stage(anchors.join(packed, anchors["row"] == packed["anchor_row"]).select(
            *anchors.columns, *windows(F.col("w.start"), F.col("w.ceiling")), F.col("w.place").alias("places")), "asked")
        hits = threshold_join(placed.drop("places"), stored, negatives, False)
        named = hits.join(placed.select(F.col("row").alias("anchor_row"), "places"), "anchor_row").select(
            "anchor_row", F.element_at("places", F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"),
            F.col("score").alias("negative_score"))
        counted = named.groupBy("anchor_row", "place").agg(F.count(F.lit(1)).alias("n"))
        state = stage(asked.join(counted, ["anchor_row", "place"], "left").withColumn(
            "done", (F.coalesce("n", F.lit(0)) >= negatives) | (F.col("start") <= F.col("floor"))).drop("n", "start"), "state")
        full = named.join(state.where("done").drop("done", "floor", "ceiling"), ["anchor_row", "place"])
        found = full if found is None else found.unionByName(full)
        open_windows = state.where("not done").drop("done")
        if open_windows.isEmpty():
            break
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return found.join(names, "anchor_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _run(spark, folder):
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(rows.withColumn("label", label), "vec_id % 100 = 0")


_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w AS rank, n.vec_id AS negative_id, p.score AS positive_score,
       n.score AS negative_score
FROM p JOIN s AS n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) QUALIFY row_number() OVER w <= 10"""

QUERIES = {"op13_hard_negatives": Query(_run, _SQL)}
