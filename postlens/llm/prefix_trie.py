"""Prefix trie of conversations, built from adaptive radix trees.

Every turn becomes a fixed-width id (big-endian byte length of its text, then a
digest of role and text), so a conversation is a byte string and its prefixes of
whole turns are the trie's nodes. Three things keep every task bounded:

* Conversations are cut into slices of ``SLICE`` turns. A slice belongs to the
  tree of what comes before it, so that a very long conversation is a chain of
  small trees. The key of a tree is a sum over the slices before it, which
  needs no pass in order.
* Equal slices of one tree are counted before they meet; a prefix that a third
  of all conversations share is one row.
* Slices are range-partitioned by key. A task streams its sorted range and keeps
  one adaptive radix tree of at most ``BLOCK`` slices. Nodes wholly inside a
  block leave it finished; those on its two borders leave it as partial rows,
  which Spark adds up.

Sums over subtrees that span several trees go up by pointer doubling.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import Query, stage, table, whole
from postlens.operators.ranking import rank_within

#: Bytes of a turn id: four for the length of the text, sixteen of the digest.
WIDTH = 20
SLICE = 64
BLOCK = 20_000
BLOCK_BYTES = 8 << 20
#: Slices of one conversation that are summed in one window.
RUN = 4096
#: Ids of a node's ended conversations travel in strings of about this many characters.
PIECE = 1 << 16
GROUP, SHARE = 5, 9
#: Ends the name of a later tree's root, which else is that of the node above it.
ROOT = "*"


# --- the adaptive radix tree ---------------------------------------------------------------

class _Sorted:
    """Up to four, then up to sixteen children, beside their sorted key bytes."""

    __slots__ = ("prefix", "value", "size", "keys", "kids")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value, self.size, self.keys, self.kids = prefix, value, 4, bytearray(), []

    def find(self, byte: int):
        at = bisect_left(self.keys, byte)
        return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, kid):
        """Set a child; returns the node to use from now on, a larger one if this one was full."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.size:
            if self.size == 16:
                return _Indexed(self).put(byte, kid)
            self.size = 16
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple]:
        return zip(self.keys, self.kids)


class _Indexed:
    """Up to 48 children behind an index of 256 places."""

    __slots__ = ("prefix", "value", "index", "kids")

    def __init__(self, small: _Sorted):
        self.prefix, self.value, self.index, self.kids = small.prefix, small.value, bytearray(256), list(small.kids)
        for at, byte in enumerate(small.keys):
            self.index[byte] = at + 1

    def find(self, byte: int):
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid):
        if self.index[byte]:
            self.kids[self.index[byte] - 1] = kid
            return self
        if len(self.kids) == 48:
            return _Full(self).put(byte, kid)
        self.kids.append(kid)
        self.index[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple]:
        return ((byte, self.kids[at - 1]) for byte, at in enumerate(self.index) if at)


class _Full:
    """A place for every byte."""

    __slots__ = ("prefix", "value", "kids")

    def __init__(self, small: _Indexed):
        self.prefix, self.value, self.kids = small.prefix, small.value, [None] * 256
        for byte, kid in small.items():
            self.kids[byte] = kid

    def find(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid):
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple]:
        return ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


class RadixTree:
    """Byte strings to values; common stretches are stored once, each node in the smallest layout that holds its children."""

    def __init__(self):
        self.root = _Sorted(b"")

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not there yet."""
        above, node, at = [], self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                same = 0
                while at + same < len(key) and key[at + same] == prefix[same]:
                    same += 1
                fork = _Sorted(prefix[:same])
                node.prefix = prefix[same + 1:]
                fork.put(prefix[same], node)
                self._replace(above, fork)
                node, at = fork, at + same
            else:
                at += len(prefix)
            if at == len(key):
                node.value = value
                return
            kid = node.find(key[at])
            if kid is None:
                grown = node.put(key[at], _Sorted(key[at + 1:], value))
                if grown is not node:
                    self._replace(above, grown)
                return
            above.append((node, key[at]))
            node, at = kid, at + 1

    def _replace(self, above: list, node) -> None:
        if above:
            parent, byte = above[-1]
            parent.put(byte, node)
        else:
            self.root = node

    def walk(self) -> list[tuple]:
        """``(node, path, place of its parent in this list)``, parents first."""
        found, todo = [], [(self.root, b"", -1)]
        while todo:
            node, path, parent = todo.pop()
            path += node.prefix
            found.append((node, path, parent))
            place = len(found) - 1
            todo.extend((kid, path + bytes((byte,)), place) for byte, kid in node.items())
        return found


# --- nodes of one block --------------------------------------------------------------------

NODE = ("kind string, id string, parent string, depth long, n long, conv_id long, parent_conv_id long, kids long, leaves long, "
        "saved long, size long, ended long, end_id long, above array<string>, tree string, goes_on boolean, virtual boolean")


class _Slice:
    __slots__ = ("following", "n", "least", "ended", "end_id", "goes_on")

    def __init__(self, following, n, least, ended, end_id, goes_on):
        self.following, self.n, self.least = following, n, least
        self.ended, self.end_id, self.goes_on = ended, end_id, goes_on


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def block_nodes(tree: str, first_depth: int, slices: list[tuple[bytes, _Slice]], open_left: bool, open_right: bool) -> list[tuple]:
    """Trie nodes of sorted slices of one tree, as rows of ``NODE``.

    Only byte depths that end a turn are nodes. ``inner`` rows are finished as
    far as this tree goes; ``border`` rows are on the path of the first or last
    slice where the tree goes on in another block, and hold this block's share
    without what lies below other border nodes. ``link`` rows tie a tree that
    follows a slice to every node above it.
    """
    radix, full = RadixTree(), {}
    for key, value in slices:
        radix.insert(key, value)
        if value.goes_on:
            full[key] = value
    first, last = slices[0][0], slices[-1][0]
    # The root of a later tree only collects what lies below the node, one tree up, that the tree is named after.
    names: dict[bytes, str] = {b"": tree + ROOT if first_depth else tree}

    def name(prefix: bytes, value=None) -> str:
        found = names.get(prefix)
        if found is None:
            found = value.following if value is not None and value.following else hashlib.md5(tree.encode() + prefix).hexdigest()
            names[prefix] = found
        return found

    def is_border(prefix: bytes) -> bool:
        return (open_left and first.startswith(prefix)) or (open_right and last.startswith(prefix))

    rows, least_of = [], {}
    walked = radix.walk()
    # Per radix node: conversations, least id, finished trie nodes next below, leaves and saved bytes of these.
    sums = [[0, None, 0, 0, 0] for _ in walked]
    for place in range(len(walked) - 1, -1, -1):
        node, path, parent = walked[place]
        n, least, kids, leaves, saved = sums[place]
        value = node.value
        if value is not None:
            n, least = n + value.n, _least(least, value.least)
        top = len(walked[parent][1]) if parent >= 0 else -1
        for depth in range(len(path) - len(path) % WIDTH, top, -WIDTH):
            prefix, own = path[:depth], value if depth == len(path) else None
            size = int.from_bytes(prefix[-WIDTH:-WIDTH + 4], "big") if depth else 0
            border, goes_on = is_border(prefix), own is not None and own.goes_on
            if not border:
                leaves += not kids and not goes_on
                saved += (n - 1) * size
                least_of[prefix] = least
            above = None
            if border:
                above = [name(prefix[:d]) for d in range(0, depth, WIDTH)] + [name(prefix, own)]
            rows.append((
                "border" if border else "inner", name(prefix, own), prefix, first_depth + depth // WIDTH, n, least, None, kids, leaves,
                saved, size, own.ended if own else 0, own.end_id if own else None, above, tree, goes_on, first_depth > 0 and not depth))
            kids, leaves, saved = (0, 0, 0) if border else (1, leaves, saved)
        if parent >= 0:
            into = sums[parent]
            into[0] += n
            into[1] = _least(into[1], least)
            into[2] += kids
            into[3] += leaves
            into[4] += saved
    done = []
    for row in rows:
        prefix = row[2]
        up = prefix[:-WIDTH] if prefix else None
        # The root of a later tree stands for a node of the tree before it, whose least id is not known here.
        known = least_of.get(up) if up is not None and not (first_depth and not up) else None
        done.append((*row[:2], None if up is None else name(up), *row[3:6], known, *row[7:]))
    for key, value in full.items():
        lowest = WIDTH if first_depth else 0
        for depth in range(lowest, len(key) + 1, WIDTH):
            at_end = depth == len(key)
            done.append(("link", name(key[:depth]), value.following, None, None, value.least if at_end else None, None, int(at_end), None,
                         None, None, None, None, None, tree, first_depth > 0, None))
    return done


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)


def _build(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODE.split(", ")])
    rows: list[tuple] = []
    tree, level, held, weight, opened = None, 0, [], 0, True
    for batch in batches:
        for t, k, depth, key, *rest in zip(*[c.to_pylist() for c in batch.columns]):
            if t != tree or len(held) >= block or weight >= BLOCK_BYTES:
                if held:
                    rows += block_nodes(tree, level, held, opened, t == tree)
                # The first tree of a sorted range may have begun in the one before.
                opened = tree in (None, t)
                tree, level, held, weight = t, depth, [], 0
            held.append((key, _Slice(*rest)))
            weight += len(key)
            if len(rows) >= 20_000:
                yield _arrow(rows, schema)
                rows = []
    if held:
        # The last tree of a sorted range may go on in the next one.
        rows += block_nodes(tree, level, held, opened, True)
    yield _arrow(rows, schema)


# --- digests of ended conversations -----------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    node, first, texts, size, rows = None, None, [], 0, []
    for batch in batches:
        for name, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if name != node or size >= PIECE:
                if texts:
                    rows.append((node, first, ",".join(texts)))
                node, first, texts, size = name, conv, [], 0
            text = str(conv)
            texts.append(text)
            size += len(text) + 1
            if len(rows) >= 200:
                yield _arrow(rows, schema)
                rows = []
    if texts:
        rows.append((node, first, ",".join(texts)))
    yield _arrow(rows, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        rows = []
        for name, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if name != node:
                if node is not None:
                    rows.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _arrow(rows, schema)
    if node is not None:
        yield _arrow([(node, digest.hexdigest())], schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(id, ends_sha256)``: SHA-256 of the comma-joined ``conv_id`` of each node, ascending.

    Ids are sorted over many partitions and joined to strings there; one task
    only streams a node's strings through its digest.
    """
    by = ["id", "conv_id"]
    pieces = stage(ends.repartitionByRange(*by).sortWithinPartitions(*by)
                   .mapInArrow(_pieces, "id string, first long, ids string"), "ended")
    return pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id string, ends_sha256 string")


# --- slices ------------------------------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    """Hex of the fixed-width id of a turn; a null role or text is empty."""
    role, text = whole(role), whole(text)
    return F.concat(F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"), F.substring(
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * (WIDTH - 4)))


def ranked_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``(conv_id, place, id)`` from place 0, ordered by turn (null first), then by id."""
    turns = stage(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id")), "turns")
    ranked = rank_within(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], "place")
    return ranked.select("conv_id", (F.col("place") - 1).alias("place"), "id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that share beginnings: ``(conv_id, place, id)``, and one row without place for each conversation.

    Conversation c begins with the first h turns of conversation c - c % 5 and
    goes on with its own turns after its first h; h is crc32(c) % 9.
    """
    lengths = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARE).alias("h")), "conversations")
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    plan = lengths.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken"))
    head = turns.withColumnRenamed("conv_id", "base").where(F.col("place") < SHARE).join(plan, "base").where("place < h")
    tail = turns.join(plan, "conv_id").where("place >= h")
    return (head.select("conv_id", "place", "id").unionByName(
        tail.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "id"))
        .unionByName(lengths.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("id"))))


def _tree_name(level: Column, lanes: list[Column]) -> Column:
    return F.md5(F.concat_ws("|", level.cast("string"), *[x.cast("string") for x in lanes]))


def slices_of(sequences: DataFrame, size: int = SLICE) -> DataFrame:
    """One row per conversation and slice: ``(conv_id, k, key, tree, following, goes_on)``.

    ``tree`` names everything before the slice: two sums, over the earlier
    slices, of 60 bits of their digests; ``following`` the tree after a full slice.
    """
    cut = stage(sequences.groupBy("conv_id", F.floor(F.coalesce("place", F.lit(0)) / size).cast("long").alias("k")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id")))),
                                 lambda x: x["id"]), "").alias("hex")), "slices")
    full = F.length("hex") == 2 * WIDTH * size
    digest = F.md5(F.concat_ws(":", "k", "hex"))
    own = [F.when(full, F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0)) for start in (1, 17)]
    parts = stage(cut.where(full).select("conv_id", "k", F.floor(F.col("k") / RUN).cast("long").alias("run"),
                                         own[0].alias("a"), own[1].alias("b")), "full-slices")
    inside = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.groupBy("conv_id", "run").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(
        "conv_id", "run", *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"{x}_ahead") for x in "ab"])
    before = parts.select("conv_id", "run", (F.col("k") + 1).alias("k"), *[F.sum(x).over(inside).alias(x) for x in "ab"]).join(
        runs, ["conv_id", "run"]).select("conv_id", "k", *[(F.col(x) + F.col(f"{x}_ahead")).cast("decimal(38,0)").alias(x) for x in "ab"],
                                         F.lit(None).cast("boolean").alias("more"))
    nothing = F.lit(None).cast("decimal(38,0)")
    later = cut.where("k > 0").select("conv_id", (F.col("k") - 1).alias("k"), nothing.alias("a"), nothing.alias("b"), F.lit(True).alias("more"))
    ties = stage(before.unionByName(later).groupBy("conv_id", "k").agg(
        F.max("a").alias("a"), F.max("b").alias("b"), F.max("more").alias("more")), "ties")
    lanes = [F.coalesce(F.col(x), F.lit(0)).cast("decimal(38,0)") for x in "ab"]
    after = [(x + y).cast("decimal(38,0)") for x, y in zip(lanes, own)]
    return cut.join(ties, ["conv_id", "k"], "left").select(
        "conv_id", "k", F.unhex("hex").alias("key"), _tree_name(F.col("k"), lanes).alias("tree"),
        F.when(full, _tree_name(F.col("k") + 1, after)).alias("following"), F.coalesce("more", F.lit(False)).alias("goes_on"))


# --- the whole trie ----------------------------------------------------------------------------

def _tree_totals(trees: DataFrame, links: DataFrame) -> DataFrame:
    """``(tree, kids, leaves, saved)`` with the sums of all later trees below; each round doubles the reach."""
    ups = links.where((F.col("kids") == 1) & F.col("goes_on")).select(F.col("parent").alias("tree"), F.col("tree").alias("up"))
    now = stage(trees.join(ups, "tree", "left"), "trees")
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").groupBy(F.col("up").alias("tree")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        steps = now.select(F.col("tree").alias("up"), F.col("up").alias("next_up"))
        now = stage(now.join(given, "tree", "left").join(steps, "up", "left").select(
            "tree", "kids", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("next_up").alias("up")), "trees")
    return now.drop("up")


def build_trie(sequences: DataFrame, size: int = SLICE, block: int = BLOCK) -> DataFrame:
    """One row per trie node of ``(conv_id, place, id)``: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Places are 0, 1, 2 … within a conversation; a row without place only says
    that its conversation exists. ``id`` is from ``turn_id``. A node's members
    are all conversations that begin with it. No conversations give no nodes.
    ``size`` is the number of turns in a slice, ``block`` that of slices in a
    task's tree; neither changes the result.
    """
    cut = slices_of(sequences, size)
    ended = ~F.col("goes_on")
    named = stage(cut, "named-slices")
    counted = named.groupBy("tree", "k", "key", "following").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.count_if(ended).alias("ended"),
        F.min(F.when(ended, F.col("conv_id"))).alias("end_id"), F.max("goes_on").alias("goes_on"))
    counted = stage(counted.select("tree", "k", (F.col("k") * size).alias("depth"), "key", "following", "n", "least", "ended", "end_id", "goes_on"),
                    "counted-slices")
    by = ["tree", "key"]
    rows = stage(counted.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(partial(_build, block=block), NODE), "trie-rows")

    # Border nodes: add up the shares, then give each one's own part and finished parts to all border nodes above it.
    shares = rows.where("kind = 'border'").groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("size").alias("size"),
        F.sum("ended").alias("ended"), F.min("end_id").alias("end_id"), F.max("above").alias("above"), F.max("goes_on").alias("goes_on"),
        F.max("virtual").alias("virtual"))
    shares = stage(shares, "border-shares")
    kids = shares.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    border = shares.join(kids, "id", "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more")
    leaf = ((F.col("kids") == 0) & ~F.col("goes_on")).cast("long")
    own = stage(border.withColumns({"own_leaves": F.col("leaves") + leaf, "own_saved": F.col("saved") + (F.col("n") - 1) * F.col("size")}),
                "border-own")
    totals = own.select(F.explode("above").alias("id"), "own_leaves", "own_saved").groupBy("id").agg(
        F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    finished = stage(own.drop("leaves", "saved", "above", "own_leaves", "own_saved").join(totals, "id"), "border-nodes")

    basic = ["id", "parent", "depth", "n", "conv_id", "parent_conv_id", "kids", "leaves", "saved", "ended", "end_id", "virtual"]
    found = rows.where("kind = 'inner'").select(*basic).unionByName(
        finished.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*basic))
    links = rows.where("kind = 'link'").select("id", "parent", "kids", "conv_id", "tree", "goes_on")
    trees = found.where("virtual").select(F.rtrim("id", F.lit(ROOT)).alias("tree"), "kids", "leaves", "saved")
    nodes = found.where("not virtual").withColumn("parent", F.rtrim("parent", F.lit(ROOT)))

    # What later trees add to the nodes above them.
    below = _tree_totals(trees, links).select(F.col("tree").alias("parent"), F.col("kids").alias("t_kids"), "leaves", "saved")
    added = links.join(below, "parent").groupBy("id").agg(
        F.sum(F.col("kids") * F.col("t_kids")).alias("a_kids"), F.sum("leaves").alias("a_leaves"), F.sum("saved").alias("a_saved"))
    mothers = finished.where("not virtual").select(F.col("id").alias("parent"), F.col("conv_id").alias("m")).unionByName(
        links.where("kids = 1").select(F.col("id").alias("parent"), F.col("conv_id").alias("m"))).groupBy("parent").agg(F.min("m").alias("m"))
    ends = named.where(ended).select("conv_id", F.when(F.length("key") == 0, F.col("tree")).otherwise(F.coalesce(
        "following", F.md5(F.concat(F.col("tree").cast("binary"), F.col("key"))))).alias("id"))
    several = nodes.where("ended > 1").select("id")
    digests = ends_digests(ends.join(several, "id", "left_semi"))
    total = nodes.join(added, "id", "left").join(mothers, "parent", "left").join(digests, "id", "left")
    alone = F.when(F.col("ended") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256)).otherwise(
        F.sha2(F.lit("").cast("binary"), 256))
    return total.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "m").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("kids") + F.coalesce("a_kids", F.lit(0))).alias("n_children"), (F.col("leaves") + F.coalesce("a_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("a_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", alone).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; see ``build_trie``.

    Turns are ordered by ``turn``, a null first; turns that tie are ordered by
    the length and then the digest of their content, and repeated rows are turns
    of their own. A null role or text is empty. Rows without a conversation id
    take no part. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    turns = ranked_turns(conversations, conv, turn, role, text)
    everyone = turns.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("id")).distinct()
    return build_trie(turns.unionByName(everyone))


def _run(spark, folder):
    return build_trie(rebuilt(ranked_turns(table(spark, folder, "conversations"))))


_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS i, id, b FROM (
    SELECT conv_id, turn, strlen(x) AS b, printf('%08x', strlen(x)) || left(sha256(strlen(r)::VARCHAR || ':' || r || x), {2 * WIDTH - 8}) AS id
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
c AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % {GROUP} AS base, xor(list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)),
    4294967295::BIGINT), 4294967295) % {SHARE} AS h FROM t GROUP BY conv_id),
p AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS taken FROM c LEFT JOIN c AS b ON c.base = b.conv_id),
r AS (
  SELECT p.conv_id, i AS place, id, b FROM t JOIN p ON t.conv_id = p.base WHERE i < h
  UNION ALL SELECT conv_id, i - h + taken, id, b FROM t JOIN p USING (conv_id) WHERE i >= h),
s AS (
  SELECT conv_id, place + 1 AS depth, string_agg(id, '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place) AS path, b FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM s),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM l GROUP BY depth, path),
k AS (
  SELECT depth - 1 AS depth, left(path, length(path) - {2 * WIDTH}) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
u AS (
  SELECT up AS depth, left(path, up * {2 * WIDTH}) AS path, count(*) FILTER (n_children = 0) AS n_leaves,
         sum((n_convs - 1) * b)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM f) GROUP BY ALL)
SELECT f.conv_id, f.depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN u USING (depth, path)
LEFT JOIN n AS m ON m.depth = f.depth - 1 AND m.path = left(f.path, greatest(length(f.path) - {2 * WIDTH}, 0))"""

QUERIES = {"op12_prefix_trie": Query(_run, _SQL)}
