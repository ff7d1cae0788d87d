"""Repeated passages across documents by content-defined chunking with a gear hash.

1. A rolling gear hash of the last sixteen bytes cuts every text where the hash
   has five zero bits, so cuts depend on nearby content only and come back after
   an insertion. Chunks get 128-bit digests.
2. Digests are counted with map-side combining; only chunks of repeated digests
   go on. Each is assigned to its first occurrence, in the document with the
   least id, and neighbours with neighbouring first occurrences form runs.
3. A run of more than ``MIN_WORDS`` words is a repeated passage. A shorter run is a
   seed: the two texts are compared around it, and the longest common stretch
   counts. So shared stretches of ``MIN_WORDS`` words or fewer are left alone.
4. The first holder of a chunk may hold only a part of what later documents share, and a shared stretch
   may hold no whole chunk. So windows of ``MIN_WORDS`` + 1 words that are not inside a passage of step 3
   get a digest and a first holder of their own; neighbouring windows with neighbouring first holders are
   passages too. Only windows with a repeated anchor need a digest: anchors are the shorter windows whose hash is
   least among a run of neighbours, so equal windows hold an equal anchor, whatever stands around them. Anchors
   that lie so deep in a passage that all their windows do are not counted.

Every document but the first loses its copy. Chunks are computed twice instead
of being stored, and hot digests are joined from stored tables, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import WORD_GAP, Query, may_be_among, null_safe, release, stage, table, whole

#: Repeated passages have more words than this.
MIN_WORDS = 50
MIN_CHUNK, MAX_CHUNK = 16, 256
#: Characters of a run below which it is no seed; so much text hardly ever recurs by chance.
MIN_SEED = 40
CUT_BITS, CUT_SHIFT, WINDOW_STEPS = 31, 11, (1, 2, 4, 8)
BATCH_ROWS = 100_000
#: Windows of a text whose hashes are in memory at once.
BLOCK_WORDS = 1 << 16

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
LONG_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
#: An odd number and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[ord(c) for c in WORD_GAP]] = True


def chunk_ends(data: np.ndarray) -> list[int]:
    """End offsets of the chunks of UTF-8 bytes; a character is never cut."""
    if not len(data):
        return []
    hashed = GEAR[data]
    for step in WINDOW_STEPS:
        longer = hashed.copy()
        longer[step:] += hashed[:-step] << np.uint32(step)
        hashed = longer
    first = (data & 0xC0) != 0x80
    cut = (hashed >> np.uint32(CUT_SHIFT)) & np.uint32(CUT_BITS) == 0
    cut[:-1] &= first[1:]
    ends, last = [], 0
    for end in [*(np.flatnonzero(cut[:-1]) + 1).tolist(), len(data)]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            while not first[last]:
                last -= 1
            ends.append(last)
        if end - last >= MIN_CHUNK or end == len(data):
            ends.append(end)
            last = end
    return ends


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, _at, _start, _end, _words, _digest): the chunks of every text, numbered, in code points.

    ``_h`` is a hash of the text that tells rows with equal ids apart.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text")).select(
        "_id", F.xxhash64("_text").alias("_h"), "_text")
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "_h", "_at", "_start", "_end", "_words", "_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, places, starts, ends_out, counts, digests = [], [], [], [], [], []

            def out(batch=batch, owners=owners, places=places, starts=starts, ends_out=ends_out, counts=counts, digests=digests):
                which = pa.array(owners, pa.int32())
                found = pa.RecordBatch.from_arrays([
                    batch.column(0).take(which), batch.column(1).take(which), pa.array(places, pa.int32()), pa.array(starts, pa.int32()),
                    pa.array(ends_out, pa.int32()), pa.array(counts, pa.int32()), pa.array(digests, pa.binary())], names)
                for held in (owners, places, starts, ends_out, counts, digests):
                    held.clear()
                return found

            for row, text in enumerate(batch.column(2)):
                raw = text.as_buffer().to_pybytes()
                data = np.frombuffer(raw, np.uint8)
                ends = chunk_ends(data)
                if not ends:
                    continue
                bounds = [0, *ends]
                gap = _IS_GAP[data]
                begins = ~gap
                begins[1:] &= gap[:-1]
                chars = np.add.reduceat((data & 0xC0) != 0x80, bounds[:-1])
                last = np.cumsum(chars)
                owners += [row] * len(ends)
                places += range(len(ends))
                starts += (last - chars).tolist()
                ends_out += last.tolist()
                counts += np.add.reduceat(begins, bounds[:-1]).tolist()
                digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(bounds, ends, strict=False)]
                if len(owners) >= BATCH_ROWS:
                    yield out()
            if owners:
                yield out()

    return rows.mapInArrow(run, f"_id {kind}, _h long, _at int, _start int, _end int, _words int, _digest binary")


def longest_common(text: str, at: int, other: str, other_at: int, length: int) -> tuple[int, int, int]:
    """(start, other start, length) of the common stretch around an equal one."""
    a, b = at, other_at
    while a and b and text[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
    end, other_end = at + length, other_at + length
    while end < len(text) and other_end < len(other) and text[end] == other[other_end]:
        end, other_end = end + 1, other_end + 1
    return a, b, end - a


def count_whole_words(text: str, start: int, end: int) -> int:
    """Words of ``text`` that lie in [start, end) from their first to their last character."""
    cut = text[start:end]
    found = len(cut.encode().split())
    if cut and found:
        if start and text[start - 1] not in WORD_GAP and cut[0] not in WORD_GAP:
            found -= 1
        if found and end < len(text) and text[end] not in WORD_GAP and cut[-1] not in WORD_GAP:
            found -= 1
    return found


def _grown(seeds: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Seeds grown to the longest common stretch with the first document, those with more than ``min_words`` words."""
    # One row for each pair of texts, so that each text travels once for it.
    spot = F.struct(F.col("_start").alias("at"), F.col("_end").alias("end"), F.col("_fstart").alias("other"))
    seeds = stage(seeds.groupBy("_id", "_h", "_fid", "_fh").agg(F.collect_set(spot).alias("_spots")), "seeds")
    wanted = stage(seeds.select("_id", "_h").unionByName(seeds.select(F.col("_fid").alias("_id"), F.col("_fh").alias("_h")))
                   .distinct().select(null_safe(F.col("_id")).alias("_key"), F.col("_h").alias("_hash")), "wanted")
    named = docs.select(null_safe(F.col(id_col)).alias("_key"), whole(F.col(text_col)).alias("_text"))
    texts = named.select("_key", F.xxhash64("_text").alias("_hash"), "_text").where(may_be_among(F.col("_hash"), wanted.select("_hash")))
    texts = texts.join(wanted, ["_key", "_hash"], "left_semi")
    texts = stage(texts.dropDuplicates(["_key", "_hash"]), "texts")
    own = texts.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "_text")
    other = texts.select(F.col("_key").alias("_fk"), F.col("_hash").alias("_fh"), F.col("_text").alias("_other"))
    pairs = seeds.withColumn("_k", null_safe(F.col("_id"))).withColumn("_fk", null_safe(F.col("_fid"))).join(own, ["_k", "_h"]).join(other, ["_fk", "_fh"])
    kind = seeds.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _h long, _start int, _end int, _words int, _fid {kind}, _fh long, _fstart int, _fend int"
    names = [x.split()[0] for x in schema.split(", ")]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, (spots, text, other) in enumerate(zip(*batch.columns[4:], strict=True)):
                text, other, seen = text.as_py(), other.as_py(), set()
                for spot in spots.as_py():
                    a, b, length = longest_common(text, spot["at"], other, spot["other"], spot["end"] - spot["at"])
                    words = count_whole_words(text, a, a + length) if (a, b) not in seen else 0
                    seen.add((a, b))
                    if words > min_words:
                        which.append(i)
                        rows.append((a, a + length, words, b, b + length))
            got = [pa.array(c, pa.int32()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            own_id, own_h, first_id, first_h = (c.take(pa.array(which, pa.int32())) for c in batch.columns[:4])
            yield pa.RecordBatch.from_arrays([own_id, own_h, *got[:3], first_id, first_h, *got[3:]], names)

    return pairs.select("_id", "_h", "_fid", "_fh", "_spots", "_text", "_other").mapInArrow(grow, schema)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of UTF-8 bytes begin and end."""
    gap = np.concatenate([[True], _IS_GAP[data], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def neighbours(size: int) -> int:
    """How many anchors in a row a window of ``size`` words holds: a power of two, about two thirds of the words at most."""
    return 1 << max(0, (2 * size // 3).bit_length() - 1)


def _over_runs(values: np.ndarray, length: int, pick) -> np.ndarray:
    """The least or greatest of each run of ``length`` (a power of two) values."""
    step = 1
    while step < length:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the first words, hashes) of the anchors of a text, for windows of ``size`` words.

    Equal bytes have equal hashes wherever they stand, and an anchor is the least of a run of neighbours
    that one window holds; so of two equal windows each has the same anchors of its own run.
    """
    run = neighbours(size)
    words = size - run + 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(begins) - size + 1, BLOCK_WORDS):
        a, b = begins[at:at + BLOCK_WORDS + size - 1], ends[at:at + BLOCK_WORDS + size - 1]
        cut = data[a[0]:b[-1]]
        first, last = a[:len(a) - words + 1] - a[0], b[words - 1:] - a[0]
        power = np.cumprod(np.full(len(cut), BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LONG_GEAR[cut] * power)])
        back = np.cumprod(np.full(len(cut), INVERSE, np.uint64))
        hashed = (sums[last] - sums[first]) * back[first]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(BASE)
        hashed ^= hashed >> np.uint64(29)
        least = np.pad(_over_runs(hashed, run, np.minimum), run - 1)
        chosen = np.flatnonzero(hashed == _over_runs(least, run, np.maximum))
        places.append(chosen + at)
        hashes.append(hashed[chosen])
    place, which = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[which]


def _anchor_table(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, _h, _start, _end, _low, _high, _anchor): the anchors of all texts, in code points; all windows that hold
    an anchor lie in its _low to _high."""
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "_h", "_start", "_end", "_low", "_high", "_anchor"]
    words = size - neighbours(size) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                owners, found = [np.zeros(0, np.int32)], [np.zeros((5, 0), np.int64)]
                for i in range(low, min(low + 1000, batch.num_rows)):
                    data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                    begins, ends = word_bounds(data)
                    if len(begins) < size:
                        continue
                    place, hashed = anchors(data, begins, ends, size)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    owners.append(np.full(len(place), i, np.int32))
                    low_word, high_word = np.maximum(place + words - size, 0), np.minimum(place + size, len(begins)) - 1
                    found.append(np.stack([chars[x] for x in (
                        begins[place], ends[place + words - 1], begins[low_word], ends[high_word])] + [hashed.view(np.int64)]))
                own, (*spots, hashed) = pa.array(np.concatenate(owners)), np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(own), batch.column(1).take(own), *[pa.array(x.astype(np.int32)) for x in spots], pa.array(hashed)], names)

    return rows.mapInArrow(run, f"_id {kind}, _h long, _start int, _end int, _low int, _high int, _anchor long")


def _windows(passages: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(_id, _h, _at, _start, _end, _digest): the windows of ``min_words`` + 1 words that hold a repeated anchor.

    Windows inside one of ``passages`` are left out: its first document, which comes earlier, holds them too. So an
    anchor all of whose windows are left out does not count, and the first document's windows need no digest either
    where all its followers are covered.
    """
    size = min_words + 1
    key = null_safe(F.col("_id")).alias("_key")
    spot = F.struct(F.col("_start").alias("a"), F.col("_end").alias("b"))
    gone = stage(passages.groupBy(key, "_h").agg(F.collect_set(spot).alias("_gone")), "gone")
    around = stage(_anchor_table(docs, id_col, text_col, size).select(key, "_h", "_start", "_end", "_low", "_high", "_anchor"), "around")
    covered = F.exists("_gone", lambda x: (x["a"] <= F.col("_low")) & (F.col("_high") <= x["b"]))
    maybe = may_be_among(F.col("_h"), gone.select("_h"))
    open_ = around.where(~maybe).unionByName(
        around.where(maybe).join(gone, ["_key", "_h"], "left").where(~F.coalesce(covered, F.lit(False))).drop("_gone"))
    often = stage(open_.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_anchor"), "anchors")
    found = open_.where(may_be_among(F.col("_anchor"), often)).join(often, "_anchor", "left_semi")
    near = found.groupBy("_key", "_h").agg(F.collect_set(spot).alias("_near"))
    marks = stage(near.join(gone, ["_key", "_h"], "left").withColumn("_gone", F.coalesce("_gone", F.array())), "marks")
    release(around)
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), null_safe(F.col(id_col)).alias("_key"), F.xxhash64(text).alias("_h"), text.alias("_text"))
    rows = rows.where(may_be_among(F.col("_h"), marks.select("_h")))
    rows = rows.join(marks, ["_key", "_h"]).select("_id", "_h", "_text", "_near", "_gone")
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "_h", "_at", "_start", "_end", "_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                data = np.frombuffer(raw, np.uint8)
                begins, ends = word_bounds(data)
                if len(begins) < size:
                    continue
                begins, ends = begins[:len(begins) - size + 1], ends[size - 1:]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                starts, stops = chars[begins], chars[ends]
                take = np.zeros(len(starts) + 1, np.int64)
                for x in batch.column(3)[i].as_py():
                    take[np.searchsorted(stops, x["b"])] += 1
                    take[np.searchsorted(starts, x["a"], "right")] -= 1
                take = np.cumsum(take[:-1]) > 0
                for x in batch.column(4)[i].as_py():
                    take[np.searchsorted(starts, x["a"]):np.searchsorted(stops, x["b"], "right")] = False
                which = np.flatnonzero(take)
                for part in range(0, len(which), BATCH_ROWS):
                    at = which[part:part + BATCH_ROWS]
                    own = pa.array(np.full(len(at), i, np.int32))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(own), batch.column(1).take(own), *[pa.array(c.astype(np.int32)) for c in (at, starts[at], stops[at])],
                        pa.array([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)],
                                 pa.binary())], names)

    return stage(rows.mapInArrow(run, f"_id {kind}, _h long, _at int, _start int, _end int, _digest binary"), "windows")


def _firsts(found: DataFrame, name: str) -> DataFrame:
    """(_digest, _fid, _fh, _fstart, _fat): the first occurrence of each digest that several documents hold."""
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_h")
    firsts = found.groupBy("_digest").agg(
        F.min(F.struct(order.alias("_doc"), "_start", "_at")).alias("_first"), F.max(order).alias("_last"))
    return stage(firsts.where(F.col("_first._doc") != F.col("_last")).select(
        "_digest", F.col("_first._doc._id").alias("_fid"), F.col("_first._doc._h").alias("_fh"),
        F.col("_first._start").alias("_fstart"), F.col("_first._at").alias("_fat")), name)


def _runs(found: DataFrame, firsts: DataFrame, name: str, words) -> DataFrame:
    """Runs of neighbours in ``found`` whose first occurrences are neighbours in another document."""
    same = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_h") == F.col("_fh"))
    marked = found.join(firsts, "_digest").where(~same).drop("_digest").withColumn("_shift", F.col("_at") - F.col("_fat")).distinct()
    pair = ["_id", "_h", "_fid", "_fh", "_shift"]
    island = F.col("_at") - F.row_number().over(Window.partitionBy(*pair).orderBy("_at"))
    runs = marked.withColumn("_island", island).groupBy(*pair, "_island").agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), words.cast("int").alias("_words"), F.min("_fstart").alias("_fstart"))
    return stage(runs.withColumn("_fend", F.col("_fstart") + F.col("_end") - F.col("_start")), name)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, text_hash, start, end, n_words, first_id, kept), one per repeated passage and document.

    Offsets are code points, ``end`` exclusive. ``first_id`` is the document that
    keeps the passage; its own row has kept = true. Passages of a document that
    touch or overlap are one row (with the least first_id); a kept passage has a
    row for each extent in which others repeat it. Copies of a whole document are
    passages too. Rows equal in id and text are one document, rows that share
    only the id are told apart by ``text_hash`` (Spark's xxhash64 of the text). Null ids come last as first
    documents. A null or empty text has no passages; documents without repeats
    have no row, and an empty table none at all. Other columns are ignored,
    whatever their names.
    """
    cut = chunks(docs, id_col, text_col)
    often = stage(cut.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"), "digests")
    found = stage(cut.where(may_be_among(F.col("_digest"), often)).join(often, "_digest", "left_semi"), "chunks")
    firsts = _firsts(found, "firsts")
    runs = _runs(found, firsts, "runs", F.sum("_words"))
    for done in (often, found, firsts):
        release(done)
    columns = ["_id", "_h", "_start", "_end", "_words", "_fid", "_fh", "_fstart", "_fend"]
    long = runs.where(F.col("_words") > min_words).select(*columns)
    short = runs.where((F.col("_words") <= min_words) & (F.col("_end") - F.col("_start") >= MIN_SEED))
    passages = stage(long.unionByName(_grown(short, docs, id_col, text_col, min_words).select(*columns)), "passages")
    windows = _windows(passages, docs, id_col, text_col, min_words)
    firsts = _firsts(windows, "window-firsts")
    more = _runs(windows, firsts, "window-runs", F.count(F.lit(1)) + min_words)
    for done in (windows, firsts):
        release(done)
    passages = passages.unionByName(more.select(*columns))

    by_doc = Window.partitionBy("_id", "_h").orderBy("_start", "_end")
    reach = F.max("_end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = passages.withColumn("_new", F.when(reach >= F.col("_start"), 0).otherwise(1))
    apart = apart.withColumn("_group", F.sum("_new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    dropped = apart.groupBy("_id", "_h", "_group").agg(
        F.min("_start").alias("start"), F.max("_end").alias("end"), F.max("_words").alias("n_words"), F.min("_fid").alias("first_id"))
    kept = passages.groupBy("_fid", "_fh", "_fstart", "_fend").agg(F.max("_words").alias("n_words"))
    rows = dropped.select("_id", "_h", "start", "end", "n_words", "first_id", F.lit(False).alias("kept")).unionByName(kept.select(
        F.col("_fid").alias("_id"), F.col("_fh").alias("_h"), F.col("_fstart").alias("start"), F.col("_fend").alias("end"), "n_words",
        F.col("_fid").alias("first_id"), F.lit(True).alias("kept")))
    return rows.withColumnsRenamed({"_id": id_col, "_h": "text_hash"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the passages that are not kept; other columns and null texts unchanged."""
    spans = find_repeats(docs, id_col, text_col, min_words).where("not kept")
    name = f"_gone_{'_'.join(docs.columns)}"
    cuts = stage(spans.groupBy(F.struct(null_safe(F.col(id_col)).alias("k"), F.col("text_hash").alias("h")).alias(name + "_key")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").alias("a"), F.col("end").alias("b")))).alias(name)), "cuts")
    key = F.struct(null_safe(F.col(id_col)).alias("k"), F.xxhash64(whole(F.col(text_col))).alias("h"))
    body = F.col(text_col)
    left = F.aggregate(name, F.struct(F.lit("").alias("t"), F.lit(0).alias("at")), lambda acc, x: F.struct(
        F.concat(acc["t"], F.substr(body, acc["at"] + 1, x["a"] - acc["at"])).alias("t"), x["b"].alias("at")),
        lambda acc: F.concat(acc["t"], F.substr(body, acc["at"] + 1)))
    joined = docs.withColumn(name + "_key", key).join(cuts, name + "_key", "left")
    return joined.select(*[F.when(F.col(name).isNull(), body).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def _run(spark, folder):
    return find_repeats(table(spark, folder, "documents"))


QUERIES = {"op8_substring_dedup": Query(_run)}
