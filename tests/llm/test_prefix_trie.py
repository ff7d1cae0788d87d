import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postlens.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, k string, n int, tree string"


def by_force(sequences: dict) -> set:
    """Nodes of ``{conv: [(role, text), …]}`` by listing every prefix of every conversation."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = set()
    for path, convs in members.items():
        subtree = [p for p in members if p[:len(path)] == path]
        kids = [p for p in subtree if len(p) == len(path) + 1]
        leaves = sum(not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in subtree) for p in subtree)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(sequences[c]) == len(path))))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain(rows) -> dict:
    """Conversations of ``(conv, turn, role, text)`` in the order the operator states."""
    def place(row):
        role, text = row[2] or "", row[3] or ""
        return (row[1] is not None, row[1] or 0, len(text.encode()),
                hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest())

    found = {}
    for row in sorted((r for r in rows if r[0] is not None), key=place):
        found.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


def collected(df):
    rows = [tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def talks(seed: int, convs: int, longest: int, texts: int) -> list:
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            # Most turns say the same, so that many conversations share long beginnings.
            rows.append((conv - 3, turn, "user", "same ü" if rng.random() < 0.7 else f"t{rng.randrange(texts)}"))
    return rows


@pytest.mark.parametrize("seed,size,block", [(1, 64, 20_000), (2, 2, 3), (3, 1, 2), (4, 3, 1), (5, 2, 20_000)])
def test_trie_equals_force_for_every_cut(spark, seed, size, block):
    rows = talks(seed, 60, 12, 3)
    turns = trie.ranked_turns(frame(spark, rows))
    empty = turns.select(F.col("conv_id") + 1000, F.lit(None).cast("long"), F.lit(None).cast("string")).distinct().limit(2)
    alone = {r[0]: [] for r in empty.collect()}
    got = collected(trie.build_trie(turns.unionByName(empty.toDF("conv_id", "place", "id")).repartition(5), size, block))
    assert got == by_force({**plain(rows), **alone})


def test_one_conversation_far_longer_than_a_slice(spark):
    rows = [(7, i, "user", f"{i % 3}") for i in range(400)] + [(9, i, "user", f"{i % 3}") for i in range(390)] + [(8, 0, "user", "0")]
    got = collected(trie.build_trie(trie.ranked_turns(frame(spark, rows)), 8, 5))
    assert got == by_force(plain(rows))


def test_hot_prefix_many_ends(spark):
    rows = [(c, t, "user", f"{t}") for c in range(3000) for t in range(2)] + [(5000 + c, 0, "bot", f"{c}") for c in range(50)]
    got = collected(trie.shared_prefixes(frame(spark, rows).repartition(6)))
    assert got == by_force_small(rows)


def by_force_small(rows):
    """As ``by_force``, for conversations where only the first two depths are shared."""
    talk = plain(rows)
    hot = [c for c in talk if c < 3000]
    digest = {True: hashlib.sha256(",".join(map(str, hot)).encode()).hexdigest(), False: hashlib.sha256(b"").hexdigest()}
    out = {(0, 0, None, len(talk), 51, 51, 2 * (len(hot) - 1), digest[False]), (0, 1, 0, len(hot), 1, 1, 2 * (len(hot) - 1), digest[False]),
           (0, 2, 0, len(hot), 0, 1, len(hot) - 1, digest[True])}
    return out | {(c, 1, 0, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) for c in talk if c >= 3000}


def test_odd_conversations(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "bot", "b"), (2, None, "", ""), (2, 5, "user", "a"),
        (None, 0, "user", "lost"), (3, 1, "user", "long " * 50_000), (3, -2, "user", "first"), (4, 1, "user", None), (4, 1, None, "x")]
    assert collected(trie.shared_prefixes(frame(spark, rows))) == by_force(plain(rows))
    assert collected(trie.shared_prefixes(frame(spark, [(None, 1, "user", "a")]))) == set()
    assert collected(trie.shared_prefixes(frame(spark, rows).limit(0))) == set()


def test_rebuilt_conversations(spark):
    rows = talks(6, 40, 14, 4)
    rows = [r for r in rows if r[0] not in (5, 20)]
    talk, want = plain(rows), {}
    for c in talk:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(f"{c % 5 if c >= 0 else -(-c % 5)}")
        want[c] = talk.get(base, [])[:h] + talk[c][h:]
    got = collected(trie.build_trie(trie.rebuilt(trie.ranked_turns(frame(spark, rows))), 2, 4))
    assert got == by_force(want)


def test_radix_tree_keeps_all_keys_in_order():
    rng = random.Random(1)
    keys = {bytes([i % 3]) + bytes(rng.choices(range((256, 3, 40)[i % 3]), k=rng.randrange(0, 6))) for i in range(6000)}
    radix = trie.RadixTree()
    order = list(keys)
    rng.shuffle(order)
    for key in order:
        radix.insert(key, key)
    found = radix.walk()
    assert {node.value for node, _, _ in found if node.value is not None} == keys
    assert all(node.value in (None, path) for node, path, _ in found)
    kinds = {type(node).__name__ for node, _, _ in found}
    assert kinds == {"_Sorted", "_Indexed", "_Full"}
    for node, path, _ in found:
        assert node.value is not None or node is radix.root or len(list(node.items())) > 1
        assert all(node.find(byte) is kid for byte, kid in node.items())
