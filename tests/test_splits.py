import json
import random

import pytest

from postlens import schemas
from postlens.sources import posts, splits

NASTY = ['"', "\\", "}", "{", "]", "[", ":", ",", "\n", "}}", '\\"', "ş", "entries", " ", "a", '"entries":[', "\\\\"]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return "".join(rng.choices(NASTY, k=rng.randrange(6)))
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(NASTY, k=rng.randrange(4))): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def dump(rng):
    listed = [value(rng) for _ in range(rng.randrange(12))]
    if rng.random() < 0.3:
        return listed, listed
    boxed = {k: value(rng) for k in rng.sample(["metadata", "a}b", "x:y", "n", "ent\"ries"], 3)}
    keys = list(boxed)
    keys.insert(rng.randrange(4), "entries")
    return {k: listed if k == "entries" else boxed[k] for k in keys}, listed


def cut_by_hand(ranges):
    """What Spark does with the ranges of one file: summaries, their composition, then the pieces put together."""
    inside, depth, outer, second, key = 0, 0, "", "", ""
    found, crossing, rest = [], [], []
    for texts in ranges:
        for kind, text in splits.cut_json(iter(texts), bool(inside), depth, outer, second, key):
            if kind == "element":
                found.append(text)
            elif kind == "rest":
                rest.append(text)
            else:
                crossing.append(text)
                if kind == "head":
                    found.append("".join(crossing))
                    crossing = []
        odd, cases = json.loads(json.dumps(splits.json_summary(iter(texts))))
        delta, opened, keys = cases[inside]
        outer, second = opened.get(str(1 - depth), outer), opened.get(str(2 - depth), second)
        key = keys.get(str(1 - depth), key)
        inside, depth = inside ^ odd, depth + delta
    return found, "".join(rest)


def test_any_cut_of_a_dump_gives_its_elements():
    rng = random.Random(11)
    for _ in range(600):
        whole, listed = dump(rng)
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, 4])) + rng.choice(["", "\n"])
        parts = text.split("}")
        if parts[-1] == "":
            parts.pop()
        cuts = sorted(rng.choices(range(len(parts) + 1), k=rng.randrange(6)))
        ranges = [parts[a:b] for a, b in zip([0, *cuts], [*cuts, len(parts)]) if a < b]
        found, rest = cut_by_hand(ranges)
        assert sorted(json.dumps(json.loads(x)) for x in found) == sorted(json.dumps(x) for x in listed if isinstance(x, (dict, list)))
        try:
            left = json.loads(rest)
        except json.JSONDecodeError:
            left = json.loads(rest[:-1])
        assert left == ([] if isinstance(whole, list) else {**whole, "entries": []})


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_large_dump_is_read_by_many_tasks(small_ranges, tmp_path, indent):
    rng = random.Random(4)
    entries = [{"id": str(i), "body": "".join(rng.choices(NASTY, k=rng.randrange(60))), "author": "ş" * (i % 5)} for i in range(400)]
    entries[50]["body"] = "uzun }\" " * 2000  # longer than several ranges
    text = json.dumps({"metadata": {"entries": [1, {"id": "no"}]}, "entries": entries, "son": "}"}, ensure_ascii=False, indent=indent)
    (tmp_path / "büyük dump[1].json").write_text(text, encoding="utf8")
    frame = splits._ranges(small_ranges, str(tmp_path), "}")
    assert frame.rdd.getNumPartitions() >= 4
    found = posts.read_posts(small_ranges, str(tmp_path), shape="auto" if indent else "document")
    got = {r.id: (r.body, r.author) for r in found.entries.collect()}
    assert got == {e["id"]: (e["body"], e["author"]) for e in entries} and found.entries.count() == 400
    assert sorted(r.key for r in found.metadata.collect()) == ["metadata", "son"] and found.rejects.isEmpty()


def test_files_that_are_no_single_value_count_by_line(small_ranges, tmp_path):
    (tmp_path / "a.json").write_text('{bad\n{"id": "1", "entries": [{"id": "2"}]}\n{"id": "3"}\n' + '{"id": "4"}\n' * 300, encoding="utf8")
    (tmp_path / "b.json").write_text(json.dumps([{"id": f"b{i}"} for i in range(100)], indent=1), encoding="utf8")
    (tmp_path / "c.json").write_text("", encoding="utf8")
    found = posts.read_posts(small_ranges, str(tmp_path))
    ids = sorted(r.id for r in found.entries.collect())
    assert ids == sorted(["2", "3", *["4"] * 300, *[f"b{i}" for i in range(100)]])
    assert [r.value for r in found.rejects.collect()] == ["{bad"]


def test_a_sheet_with_line_breaks_is_read_by_many_tasks(small_ranges, tmp_path):
    rng = random.Random(6)
    cells = ["".join(rng.choices(['"', ",", "\n", "ş", "x", " ", "\n\n"], k=rng.randrange(40))) for _ in range(500)]
    cells[7] = 'satır\n"söz",\n' * 900
    rows = [(i, f"x{c}x", str(i % 3), None if i % 7 else "spor") for i, c in enumerate(cells)]
    df = small_ranges.createDataFrame(rows, schemas.LABELLED).coalesce(2)
    path = str(tmp_path / "sheet.csv")
    posts.write_predictions(df, path)
    assert splits._ranges(small_ranges, path, "\n").rdd.getNumPartitions() >= 4
    assert sorted(map(tuple, posts.read_labelled(small_ranges, path).collect())) == rows
    plain = small_ranges.read.csv(path, schema=schemas.LABELLED, header=True, escape='"', multiLine=True)
    assert sorted(map(tuple, plain.collect())) == rows
