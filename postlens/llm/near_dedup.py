"""Near-duplicate documents by bottom-k sketches, and the components of their links.

1. Each text becomes the set of its five-word shingles; one hash function gives
   the sketch, the ``SKETCH`` smallest hashes. Texts with equal sets are one
   class and go on as one node.
2. Inverted lists of retained values generate candidates. Two sets with Jaccard
   similarity J share about J of the sketch of their union, so their sketches
   overlap in at least ``least_overlap`` values. By the prefix rule it is enough
   to list a node under its ``size - least_overlap + 1`` rarest values; that is
   exact, and keeps passages that many documents share out of the lists.
3. A list is first joined as a star: every node with the list's most central one. The
   union-sketch estimate filters the pairs, and the exact similarity of the full
   sets confirms the links. Lists that are one component now, as lists of copies
   are, are done. Of the others, short ones are expanded into the pairs across
   components. The nodes of long ones, mostly texts that share a long passage,
   are listed anew under the rarest quarter of their full sets, where sets that
   share less than the threshold asks for hardly meet, and the same is done there.
   So no link between components is missed and no list of copies is expanded
   into all its pairs.
4. Components come from contracting the links, on stored tables, round by round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import LOWER, UPPER, Query, keep_once, null_safe, only, stage, table, unused, whole, without

SHINGLE = 5
PERCENT = 75
SKETCH = 64
#: Standard deviations by which the overlap of two sketches may fall short of its mean.
DEVIATIONS = 5
#: Nodes of a list that is expanded into pairs without a look at the full sets.
SHORT_LIST = 16
MAX_MEMO = 200_000
#: Rows that a task handles together.
BATCH_ROWS = 500

MULTIPLIERS = [xxhash.xxh64_intdigest(b"shingle", i) | 1 for i in range(SHINGLE)]


def split_words(text: str) -> list[bytes]:
    """The words of a text with A-Z in lower case."""
    return text.encode().lower().split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


WORD_HASHES = _WordHashes()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles; a shorter text is one shingle."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1) >> 1] if words else [], np.int64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = sum(hashes[i:i + n] * np.uint64(m) for i, m in enumerate(MULTIPLIERS))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(1)).astype(np.int64))


def shingle_set(words: list[bytes]) -> set:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def least_overlap(size: int, sketch: int = SKETCH) -> int:
    """Least number of values that the sketches of linked sets share, for one of ``size`` shingles.

    Exact when the sketches are the whole sets, else five deviations below the mean.
    """
    if size * 100 <= sketch * PERCENT:
        return max(1, -(-size * PERCENT // 100))
    held = min(size, sketch)
    share = PERCENT / 100
    return max(1, math.ceil(share * held - DEVIATIONS * math.sqrt(share * (1 - share) * held)))


def sketches(docs: DataFrame, id_col: str, text_col: str, sketch: int = SKETCH) -> DataFrame:
    """One row per row of ``docs``: _id, _digest (of the text), _n (shingles), _set (digest of the set), _sketch, _list (values to be listed)."""
    text = whole(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.md5(text.cast("binary")).alias("_digest"), text.alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, held, listed = [], [], [], []
            for text in batch.column(2):
                found = shingle_hashes(split_words(text.as_py()))
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                held.append(found[:sketch])
                listed.append(min(len(found), sketch) - least_overlap(len(found), sketch) + 1)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array([], np.int64), *held])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), values, pa.array(listed, pa.int32())],
                ["_id", "_digest", "_n", "_set", "_sketch", "_list"])

    return rows.mapInArrow(run, f"_id {kind}, _digest string, _n long, _set binary, _sketch array<long>, _list int")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(_value, _node, _n, _pos) from (_node, _n, _values, _list): each node under the ``_list`` rarest of its values.

    ``_pos`` is the value's place, from 1, in the node's order from rare to common.
    """
    values = nodes.select("_node", F.explode("_values").alias("_value"))
    shared = stage(values.groupBy("_value").agg(F.count(F.lit(1)).alias("_count")).where("_count > 1"), "values")
    rare = values.join(shared, "_value").groupBy("_node").agg(F.collect_list(F.struct("_count", "_value")).alias("_shared"))
    # Values of a single node are the rarest of all; they use up places of the prefix and need no list.
    alone = F.col("_held") - F.size("_shared")
    picked = F.slice(F.sort_array("_shared"), F.lit(1), F.greatest(F.col("_list") - alone, F.lit(0)))
    sizes = nodes.select("_node", "_n", "_list", F.size("_values").alias("_held"))
    listed = sizes.join(rare, "_node").select("_node", "_n", alone.alias("_alone"), F.posexplode(picked["_value"]).alias("_i", "_value"))
    return stage(listed.select("_value", "_node", "_n", (F.col("_alone") + F.col("_i") + 1).alias("_pos")), "lists")


def may_link(a: str, b: str, exact: bool) -> Column:
    """Whether the sizes of two nodes allow a link and, in lists of full sets, the places of the common value do.

    Linked sets share at least 75/175 of their added sizes, so their first common value comes early enough in both.
    """
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    if not exact:
        return sizes
    shared = F.ceil((n_a + n_b) * PERCENT / (100 + PERCENT))
    return sizes & (F.col(f"{a}pos") <= n_a - shared + 1) & (F.col(f"{b}pos") <= n_b - shared + 1)


def star_pairs(lists: DataFrame, exact: bool) -> DataFrame:
    """The pairs (_a, _b), _a < _b, of each list's most central node with the others.

    Central is the node with the fewest rarer values, like the text that copies were edited from.
    """
    stars = stage(lists.groupBy("_value").agg(F.min(F.struct("_pos", "_node", "_n")).alias("_x"), F.count(F.lit(1)).alias("_count"))
                  .where("_count > 1").select("_value", F.col("_x._node").alias("_c"), F.col("_x._n").alias("_c_n"), F.col("_x._pos").alias("_c_pos")), "stars")
    return lists.join(stars, "_value").where((F.col("_c") != F.col("_node")) & may_link("_c_", "_", exact)).select(
        F.least("_c", "_node").alias("_a"), F.greatest("_c", "_node").alias("_b")).distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(_value, _node, _n, _pos, _root, _size) of the lists that hold several components."""
    marked = stage(lists.join(labels, "_node", "left").select("_value", "_node", "_n", "_pos", F.coalesce("_root", "_node").alias("_root")), "marked")
    mixed = stage(marked.groupBy("_value").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"), F.count(F.lit(1)).alias("_size"))
                  .where("_low < _high").select("_value", "_size"), "mixed")
    return stage(marked.join(mixed, "_value"), "open")


def pairs_across(lists: DataFrame, exact: bool) -> DataFrame:
    """The pairs (_a, _b) of open lists that lie in different components."""
    other = lists.select("_value", F.col("_node").alias("_b"), F.col("_n").alias("_b_n"), F.col("_pos").alias("_b_pos"), F.col("_root").alias("_b_root"))
    return lists.join(other, "_value").where(
        (F.col("_node") < F.col("_b")) & (F.col("_root") != F.col("_b_root")) & may_link("_", "_b_", exact)).select(
        F.col("_node").alias("_a"), "_b").distinct()


def may_be_linked(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> bool:
    """Whether the sketch of the union of two sets, made from theirs, allows a link."""
    both = np.intersect1d(a[:sketch], b[:sketch], assume_unique=True)
    union = np.union1d(a[:sketch], b[:sketch])[:sketch]
    shared = np.searchsorted(both, union[-1], side="right")
    mean = PERCENT / 100 * len(union)
    return shared >= mean - DEVIATIONS * math.sqrt(mean * (1 - PERCENT / 100))


def texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_node, _words) of stored ``nodes`` (_node, _first, _set): the words of a text of each node, joined by blanks."""
    named = docs.select(null_safe(F.col(id_col)).alias("_key"), whole(F.col(text_col)).alias("_text"))
    wanted = stage(nodes.select("_node", "_set", null_safe(F.col("_first")).alias("_key")), "wanted-texts")
    texts = only(named, wanted, "_key").select("_node", "_set", "_text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An id may name several texts; the set's digest tells which one belongs to the node.
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = [(node.as_py(), b" ".join(words)) for node, digest, text in zip(*batch.slice(at, BATCH_ROWS).columns, strict=True)
                        if xxhash.xxh3_128_digest(shingle_hashes(words := split_words(text.as_py())).tobytes()) == digest.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["_node", "_words"])

    return texts.mapInArrow(pick, "_node long, _words binary")


def full_sets(texts: DataFrame) -> DataFrame:
    """(_node, _n, _values, _list) with all shingles of each text and the length of the exact prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, words in zip(*batch.columns, strict=True):
                found = shingle_hashes(words.as_py().split(b" "))
                places = len(found) - max(1, -(-len(found) * PERCENT // 100)) + 1
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([found], pa.list_(pa.int64())),
                                                  pa.array([places], pa.int32())], ["_node", "_n", "_values", "_list"])

    return texts.mapInArrow(run, "_node long, _n long, _values array<long>, _list int").dropDuplicates(["_node"])


def estimated(pairs: DataFrame, nodes: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """The pairs that the sketch of their union lets pass; only the sketches of nodes in pairs travel."""
    ends = stage(pairs.select(F.col("_a").alias("_node")).unionByName(pairs.select(F.col("_b").alias("_node"))).distinct(), "ends-of-pairs")
    held = stage(only(nodes.select("_node", "_sketch"), ends, "_node"), "sketches-of-pairs")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy() for c in batch.columns[:2])
            keep = np.array([may_be_linked(x, y, sketch) for x, y in zip(
                *[c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["_a", "_b"])

    joined = pairs.join(held.select(F.col("_node").alias("_a"), F.col("_sketch").alias("_sa")), "_a").join(
        held.select(F.col("_node").alias("_b"), F.col("_sketch").alias("_sb")), "_b")
    return stage(joined.select("_a", "_b", "_sa", "_sb").mapInArrow(estimate, "_a long, _b long"), "likely")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, sketch: int = SKETCH) -> DataFrame:
    """The pairs that the estimate lets pass and whose full shingle sets, compared word by word, have the similarity."""
    pairs = estimated(pairs, nodes, sketch)
    ends = stage(pairs.select(F.col("_a").alias("_node")).unionByName(pairs.select(F.col("_b").alias("_node"))).distinct(), "ends-of-likely")
    wanted = stage(only(nodes.select("_node", "_first", "_set"), ends, "_node"), "wanted")
    words = stage(texts_of(wanted, docs, id_col, text_col), "words")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, b, a_words, b_words in zip(*batch.columns, strict=True):
                if a.as_py() != known:
                    known, own = a.as_py(), shingle_set(a_words.as_py().split(b" "))
                found = shingle_set(b_words.as_py().split(b" "))
                both = len(own & found)
                if 100 * both >= PERCENT * (len(own) + len(found) - both):
                    a_out.append(known)
                    b_out.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["_a", "_b"])

    joined = pairs.join(words.select(F.col("_node").alias("_a"), F.col("_words").alias("_wa")), "_a").join(
        words.select(F.col("_node").alias("_b"), F.col("_words").alias("_wb")), "_b")
    return stage(joined.select("_a", "_b", "_wa", "_wb").mapInArrow(compare, "_a long, _b long").distinct(), "links")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(_node, _root) for every node of ``links``: the least node that it reaches.

    ``labels`` are earlier results to go on from. Each round hangs every root on
    its least neighbour, shortens the chains, and contracts the links; at least
    half of the linked roots go in a round. All joins are between stored tables,
    so AQE splits hot roots.
    """
    both = links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    fresh = both.select(F.col("_a").alias("_node")).distinct()
    if labels is None:
        labels = stage(fresh.select("_node", F.col("_node").alias("_root")), "labels")
    else:
        labels = stage(labels.unionByName(fresh.join(labels, "_node", "left_anti").select("_node", F.col("_node").alias("_root"))), "labels")
        both = stage(both, "ends")
        for side in ("_a", "_b"):
            roots = labels.select(F.col("_node").alias(side), F.col("_root").alias("_r"))
            both = both.join(roots, side).drop(side).withColumnRenamed("_r", side)
    edges = stage(both.select("_a", "_b").where("_a <> _b").distinct(), "edges")
    while not edges.isEmpty():
        hung = stage(edges.groupBy("_a").agg(F.min("_b").alias("_to")).where("_to < _a").select(F.col("_a").alias("_from"), "_to"), "hung")
        for _ in range(2):
            further = hung.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
            hung = stage(hung.join(further, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to")), "hung")

        def moved(df: DataFrame, column: str, hung: DataFrame = hung) -> DataFrame:
            target = hung.select(F.col("_from").alias(column), F.col("_to").alias("_moved"))
            out = df.join(target, column, "left")
            return out.withColumn(column, F.coalesce("_moved", column)).drop("_moved")

        labels = stage(moved(labels, "_root").select("_node", "_root"), "labels")
        edges = stage(moved(moved(edges, "_a"), "_b").select("_a", "_b").where("_a <> _b").distinct(), "edges")
    return labels


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable), kept (the id is that one).

    Texts are linked when 100 * shared shingles >= 75 * all shingles. A null text
    and a text without words have no shingles and no links. Rows that share an id
    are told apart by their texts; of a group's rows with the least id all are
    kept. Null ids are greater than all others; a group of null ids has a null
    component and is kept. An empty table gives an empty result. Other columns
    are ignored, whatever their names.

    A link that is just at the threshold is missed only if two sketches of
    ``sketch`` values overlap five deviations below the mean.
    """
    joined = _grouped(docs, id_col, text_col, sketch)
    return joined.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
                         F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, sketch: int) -> DataFrame:
    """One row per row of ``docs``: _id, _digest, _n, _component, and _head, the record (id, digest) of its group's first row if it has a group."""
    rows = stage(sketches(docs, id_col, text_col, sketch), "sketches")
    record = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_digest").alias("digest"))
    classes = rows.where("_n > 0").groupBy("_set").agg(
        F.min("_id").alias("_first"), F.min(record).alias("_head"), F.any_value(F.struct("_n", "_sketch", "_list")).alias("_x"))
    nodes = stage(classes.select(F.monotonically_increasing_id().alias("_node"), "_set", "_first", "_head", "_x.*"), "nodes")
    tried = None
    labels = stage(nodes.select("_node", F.col("_node").alias("_root")).limit(0), "labels")

    def link(pairs: DataFrame) -> None:
        """Check the pairs that were not checked before, and merge the components that they join."""
        nonlocal tried, labels
        pairs = stage(pairs if tried is None else pairs.join(tried, ["_a", "_b"], "left_anti"), "tried")
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = components(confirmed(pairs, nodes, docs, id_col, text_col, sketch), labels)

    lists = inverted_lists(nodes.select("_node", "_n", F.col("_sketch").alias("_values"), "_list"))
    link(star_pairs(lists, exact=False))
    left = open_lists(lists, labels)
    crowd = stage(left.where(F.col("_size") > SHORT_LIST).select("_node").distinct().join(nodes.select("_node", "_first", "_set"), "_node"), "crowd")
    full = inverted_lists(stage(full_sets(texts_of(crowd, docs, id_col, text_col)), "full-sets"))
    link(pairs_across(left.where(F.col("_size") <= SHORT_LIST), exact=False).unionByName(star_pairs(full, exact=True)).distinct())
    link(pairs_across(open_lists(full, labels), exact=True))

    named = nodes.select("_node", "_set", "_first", "_head").join(labels, "_node", "left").select(
        "_set", "_first", "_head", F.coalesce("_root", "_node").alias("_root"))
    named = stage(named, "named")
    first = stage(named.groupBy("_root").agg(F.min("_first").alias("_least"), F.min("_head").alias("_head")), "firsts")
    final = stage(named.drop("_head").join(first, "_root").select("_set", "_least", "_head", F.lit(True).alias("_found")), "final")
    # All texts without shingles have the same (empty) set, which no class has.
    return rows.select("_id", "_digest", "_n", "_set").join(final, "_set", "left").select(
        "_id", "_digest", "_n", F.when(F.col("_found"), F.col("_least")).otherwise(F.col("_id")).alias("_component"), "_head")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns unchanged.

    It is the row with the least id, a null id last, and of rows that share it
    that with the least digest of its text; of rows equal in both one stays,
    whichever. Rows are told apart by id and text, so rows of other groups that
    share or lack an id stay. Texts without words are in no group and stay. An
    empty table gives an empty result.
    """
    name = unused(docs, "_key")

    def record(row_id: Column, digest: Column) -> Column:
        return F.struct(null_safe(row_id).alias("id"), digest.alias("text")).alias(name)

    rows = stage(_grouped(docs, id_col, text_col, SKETCH).where("_head is not null").select(
        record(F.col("_id"), F.col("_digest")), (F.col("_id").eqNullSafe(F.col("_head.id")) & (F.col("_digest") == F.col("_head.digest"))).alias("_kept")),
        "grouped")
    gone = stage(rows.where("not _kept").select(name).distinct(), "near-copies")
    again = stage(rows.where("_kept").groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(name), "again")
    keyed = docs.select("*", record(F.col(id_col), F.md5(whole(F.col(text_col)).cast("binary"))))
    return keep_once(without(keyed, gone, name), again, name).drop(name)


def _run(spark, folder):
    return find_groups(table(spark, folder, "documents"))


_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id"""

QUERIES = {"op9_near_dedup": Query(_run, _SQL)}
