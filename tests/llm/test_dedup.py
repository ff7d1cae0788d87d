from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from conftest import prose
from pyspark.sql import functions as F

from postlens.llm import exact_dedup, near_dedup, substring_dedup


def test_exact_copies(make_docs, odd_rows):
    rows = exact_dedup.mark_copies(make_docs(odd_rows), keep="largest").collect()
    groups = defaultdict(list)
    for i, text, _ in odd_rows:
        groups[text or ""].append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(rows) == len(odd_rows)
    kept = defaultdict(int)
    for r in rows:
        ids = groups[digest[r.text_sha256]]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_copies_survive_hash_collisions(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    same = exact_dedup.mark_copies(docs, hash_of=lambda c: F.lit("one hash for all"))
    assert sorted(map(str, same.collect())) == sorted(map(str, exact_dedup.mark_copies(docs).collect()))


def test_dropping_copies_keeps_columns_and_one_row(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (2, prose(2, 60), "b")])
    kept = exact_dedup.drop_copies(docs, keep="largest")
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in odd_rows})


def groups_by_force(rows):
    sets = [near_dedup.shingle_set(near_dedup.split_words(t or "")) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((str(doc), len(sets[i]), str(least.get(find(i)) if sets[i] else doc)) for i, (doc, _, _) in enumerate(rows)))


def edited(seed: int, text: str, edits: int) -> str:
    import random
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(99999)}"
    return " ".join(words)


def test_near_groups_equal_brute_force(make_docs, odd_rows):
    rows = list(odd_rows)
    passage = prose(77, 60)
    for i in range(12):  # chains: each version is edited from the last one, so the ends are not linked directly
        rows.append((100 + i, rows[-1][1] if i == 11 else edited(i, rows[-1][1] if i else prose(50, 200), 5), "a"))
    for i in range(40):  # a star of copies, and documents that share a passage only
        rows.append((200 + i, edited(i, prose(60, 150), 3), "b"))
        rows.append((300 + i, passage + " " + prose(900 + i, 25 + i), "c"))
    for i in range(20):
        rows.append((400 + i, edited(i, prose(61, 12), i % 3).upper(), "d"))
    found = near_dedup.find_groups(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == groups_by_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_components_of_a_long_chain(spark):
    import random
    names = list(range(200))
    random.Random(4).shuffle(names)
    links = spark.createDataFrame([*zip(names, names[1:]), (1000, 1001), (1001, 1002)], "_a long, _b long")
    found = {r._node: r._root for r in near_dedup.components(links).collect()}
    assert {found[n] for n in names} == {0} and found[1002] == 1000
    more = near_dedup.components(spark.createDataFrame([(1002, names[3])], "_a long, _b long"), near_dedup.components(links))
    assert {r._root for r in more.collect()} == {0}


def test_repeated_passages(make_docs, odd_rows):
    passages = [prose(500 + i, n) for i, n in enumerate([30, 49, 50, 51, 60, 90, 130])]
    rows, holders = list(odd_rows[7:]), defaultdict(list)
    for i in range(60):
        p = i % 7
        holders[p].append(1000 + i)
        rows.append((1000 + i, f"{prose(2000 + i, 5 + 3 * i)} {passages[p]} {prose(3000 + i, 40)}", "a"))
    docs = make_docs(rows)
    found = substring_dedup.find_repeats(docs).collect()
    expected = {d for p, ds in holders.items() if len(passages[p].split()) > 50 for d in ds} | {6, 7}
    assert {r.doc_id for r in found} == expected
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        assert r.kept == (r.doc_id == r.first_id)
        assert len(texts[r.doc_id][r.start:r.end].split()) > 50
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    after = {r.doc_id: r.text for r in left.collect()}
    for p, ds in holders.items():
        assert sum(passages[p] in after[d] for d in ds) == (1 if len(passages[p].split()) > 50 else len(ds))
    assert after[10] == "one" and after[6] == texts[6]


def test_passages_that_earlier_documents_hold_in_parts(make_docs):
    words = prose(600, 60).split()
    passage = " ".join(words)
    rows = [(1, f"{prose(601, 9)} {' '.join(words[:42])} {prose(602, 9)} {' '.join(words[18:])} {prose(603, 9)}", "a"),
            (2, " ".join(words[:20]) + " edited " + " ".join(words[21:]), "a")]
    rows += [(10 + i, f"{prose(610 + i, 20)} {passage} {prose(650 + i, 20)}", "a") for i in range(20)]
    docs = make_docs(rows)
    found = substring_dedup.find_repeats(docs).collect()
    assert {(r.doc_id, r.kept) for r in found} == {(10, True), *[(i, False) for i in range(11, 30)]}
    texts = {r[0]: r[1] for r in rows}
    assert all(passage in texts[r.doc_id][r.start:r.end] and r.first_id == 10 for r in found)
    after = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert {i for i in after if passage in after[i]} == {10} and after[1] == texts[1] and after[2] == texts[2]


def test_windows_whose_followers_are_covered_need_no_digest(make_docs, monkeypatch):
    shared, counts, stage = prose(90, 2000, 10**6), {}, substring_dedup.stage

    def counted(df, name):
        stored = stage(df, name)
        counts[name] = stored.count()
        return stored

    monkeypatch.setattr(substring_dedup, "stage", counted)
    rows = [(i, f"{prose(91 + i, 100, 10**6)} {shared} {prose(95 + i, 100, 10**6)}", "a") for i in range(3)]
    found = substring_dedup.find_repeats(make_docs(rows)).where("not kept").collect()
    assert sorted(r.doc_id for r in found) == [1, 2] and all(shared in rows[r.doc_id][1][r.start:r.end] for r in found)
    # Only those that hold an anchor near an end of the passage, in each of three documents.
    assert counts["windows"] < 900


def test_passages_of_odd_rows(make_docs, odd_rows):
    found = substring_dedup.find_repeats(make_docs(odd_rows)).collect()
    assert {(r.doc_id, r.first_id, r.kept) for r in found} == {(1, 1, True), (2, 1, False), (None, 1, False), (6, 6, True), (7, 6, False)}


@pytest.mark.parametrize("letters", [2, 3, 4])
def test_passages_of_short_words_are_all_found(make_docs, letters):
    import random
    rng = random.Random(letters)
    def short(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=letters)) for _ in range(n))
    rows = []
    for i in range(300):
        passage = short(51)
        rows += [(2 * i + j, f"{short(30)} {passage} {short(30)}", "a") for j in (0, 1)]
    found = substring_dedup.find_repeats(make_docs(rows)).where("not kept").collect()
    assert {r.doc_id for r in found} == set(range(1, 600, 2))
    assert all(r.first_id == r.doc_id - 1 for r in found)


def test_equal_windows_share_an_anchor(monkeypatch):
    import random

    import numpy as np
    rng = random.Random(8)
    for size, block in [(51, 1 << 16), (51, 7), (12, 5), (3, 4), (1, 2)]:
        monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
        passage = " ".join(rng.choices(["a", "b", "ünï"], k=size))
        texts = [(" ".join(rng.choices(["a", "b", "c"], k=n)) + " " if n else "") + passage + " tail" * n for n in (0, 5, 90)]
        hashes = []
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            begins, ends = substring_dedup.word_bounds(data)
            at = len(begins) - size - text.count(" tail")
            place, hashed = substring_dedup.anchors(data, begins, ends, size)
            inside = (place >= at) & (place < at + substring_dedup.neighbours(size))
            hashes.append(set(hashed[inside].tolist()))
        assert hashes[0] and all(hashes[0] <= h for h in hashes[1:])


def test_chunks_come_back_after_an_insertion():
    import numpy as np
    text = prose(8, 3000).encode()
    moved = text[:5000] + b"some inserted words" + text[5000:]
    cut = [set(zip([0, *e], e)) for e in (substring_dedup.chunk_ends(np.frombuffer(t, np.uint8)) for t in (text, moved))]
    pieces = [{t[a:b] for a, b in c} for t, c in zip((text, moved), cut, strict=True)]
    assert len(pieces[0] - pieces[1]) <= 4
    assert all(b - a <= substring_dedup.MAX_CHUNK for c in cut for a, b in c)


@pytest.mark.parametrize("run", [exact_dedup.mark_copies, exact_dedup.drop_copies, near_dedup.find_groups, substring_dedup.find_repeats])
def test_empty_table(make_docs, run):
    assert run(make_docs([])).count() == 0


def test_long_passages_are_found_to_their_ends(make_docs):
    passage = prose(620, 300)
    docs = make_docs([(i, f"{prose(630 + i, 40)} {passage} {prose(640 + i, 40)}", "a") for i in range(3)])
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = substring_dedup.find_repeats(docs).where("not kept").collect()
    assert [r.doc_id for r in sorted(found)] == [1, 2]
    assert all(passage in texts[r.doc_id][r.start:r.end] for r in found)
    assert not any(passage.split()[j] + " " + passage.split()[j + 1] in r.text for r in substring_dedup.remove_repeats(docs).where("doc_id > 0").collect()
                   for j in (0, 150, 298))


def test_first_rows_stay_and_unique_texts_that_share_an_id(make_docs):
    a, b, c = (prose(70 + i, 80) for i in range(3))
    rows = [(1, a, "s"), (2, a + " tail", "s"), (2, b, "s"), (None, a + " other", "s"), (None, c, "s")]
    docs = make_docs(rows)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("2", b), ("None", c)])
    # One row of a group stays even if its rows share or lack an id, or are equal.
    rows = [(5, a, "s"), (5, a + " x", "s"), (5, a, "s"), (None, b, "s"), (None, b + " y", "s"), (6, None, "s"), (6, "", "s"), (None, " ", "s")]
    kept = [(r.doc_id, r.text) for r in near_dedup.keep_first(make_docs(rows)).collect()]
    assert len(kept) == 5 and sum(i == 5 for i, _ in kept) == 1 and sum(t in (b, b + " y") for _, t in kept) == 1
    assert near_dedup.keep_first(make_docs(rows).limit(0)).collect() == []


def test_links_just_above_the_threshold_are_found(make_docs):
    """Measured recall of the sketch estimate where it is at its worst: similarities of 0.75 to 0.77."""
    import random
    rng, rows = random.Random(8), []
    for i in range(300):
        words = [f"v{rng.randrange(10 ** 9)}" for _ in range(200)]
        # Each changed word far from the others changes five of 196 shingles: 5 changes leave 171 / 221 = 0.774.
        other = list(words)
        for at in range(20, 200, 36):
            other[at] = f"e{rng.randrange(10 ** 9)}"
        rows += [(2 * i, " ".join(words), "a"), (2 * i + 1, " ".join(other), "a")]
    near = near_dedup.shingle_set(near_dedup.split_words(rows[0][1])) & near_dedup.shingle_set(near_dedup.split_words(rows[1][1]))
    assert 0.75 <= len(near) / (2 * 196 - len(near)) < 0.78
    found = {r.doc_id: r.component_id for r in near_dedup.find_groups(make_docs(rows)).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(300)) == 300


@pytest.mark.parametrize("words", [1, 1 << 16])
def test_key_filters_change_nothing_at_any_size(spark, monkeypatch, words):
    from postlens.llm import common
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    df = spark.range(5000).select((F.col("id") % 1700).alias("k"), "id")
    keys = common.stage(spark.createDataFrame([(k,) for k in (3, 5, 1600, 9999)], "k long"), "keys")
    assert common.without(df, keys, "k").exceptAll(df.join(keys, "k", "left_anti")).isEmpty()
    assert common.without(df, keys, "k").count() == df.join(keys, "k", "left_anti").count()
    assert common.only(df, keys, "k").count() == df.join(keys, "k").count() == 8
    assert common.keep_once(df, keys, "k").count() == 5000 - 8 + 3
    none = common.stage(keys.limit(0), "none")
    assert common.without(df, none, "k").count() == 5000 and common.keep_once(df, none, "k").count() == 5000


def test_filters_move_only_rows_that_may_match(spark):
    from postlens.llm import common
    keys = common.stage(spark.range(3).select(F.col("id").alias("k")), "keys")
    for found in (common.without(spark.range(50).select(F.col("id").alias("k")), keys, "k"), common.only(spark.range(50).select(F.col("id").alias("k")), keys, "k")):
        plan = found._jdf.queryExecution().optimizedPlan()
        assert "getbit" in plan.toString().lower() and "Cross" not in plan.toString()
    union = common.without(spark.range(50).select(F.col("id").alias("k")), keys, "k")._jdf.queryExecution().optimizedPlan()
    # Rows that the filter rules out pass without a join.
    assert "Join" not in union.children().apply(0).toString() and "Join" in union.children().apply(1).toString()
