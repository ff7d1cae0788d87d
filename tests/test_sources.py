import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postlens import schemas
from postlens.operators import filters
from postlens.plans import ingest
from postlens.sources import pages, posts, snapshots, splits

ENTRIES = [{"id": "1", "author": "ada", "body": "bir", "topic": "pena"}, {"id": "2", "author": "bora", "body": "iki\nüç", "topic": "pena"}]


def _write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf8")
    return str(path)


@pytest.mark.parametrize("name, text, ids, keys", [
    ("boxed", json.dumps({"metadata": {"topics": ["şu"]}, "v": 1, "entries": ENTRIES}, ensure_ascii=False, indent=2), ["1", "2"], ["metadata", "v"]),
    ("oneline", json.dumps({"metadata": {}, "entries": ENTRIES}), ["1", "2"], ["metadata"]),
    ("array", json.dumps(ENTRIES, indent=1), ["1", "2"], []),
    ("single", json.dumps(ENTRIES[0], indent=1), ["1"], []),
    ("lines", "\n".join(["", json.dumps(ENTRIES[0]), "{bad", "[1]", "  ", json.dumps(ENTRIES[1])]), ["1", "2"], []),
])
def test_post_shapes(spark, tmp_path, name, text, ids, keys):
    found = posts.read_posts(spark, _write(tmp_path, name, text))
    rows = found.entries.orderBy("id").collect()
    assert [r["id"] for r in rows] == ids and rows[-1]["body"] == ENTRIES[len(ids) - 1]["body"]
    assert sorted(r["key"] for r in found.metadata.collect()) == keys
    if name == "boxed":
        assert found.metadata.where("key = 'metadata'").first()["value"] == '{"topics":["şu"]}'


def test_flatten_keeps_arrays(spark):
    df = spark.createDataFrame([((1, ("x", [1])), 2)], "a struct<b:int,c:struct<d:string,e:array<int>>>, f int")
    assert posts.flatten(df).columns == ["a.b", "a.c.d", "a.c.e", "f"]


def test_payload_variants(spark):
    rows = [
        ('{"title":"","baslik":"Pena","entries":[{"body":"","entry":"a<br>b &amp;c","nick":"x","fav_count":"7","id":3}],"total_page":4}', "boxed"),
        ('["düz <b>metin</b>"]', "bare"), ('{"error":"yok","entries":["a"]}', "error"), ("{}", "nothing"), ('{"a":1,"b":[],"c":["z"]}', "first"),
        ('{"entries":[],"data":["never"]}', "empty")]
    got = {r["slug"]: r for r in posts.normalize_payload(spark.createDataFrame([(p, s, 2) for p, s in rows], "j string, slug string, page int"), "j").collect()}
    assert set(got) == {"boxed", "bare", "first"}
    r = got["boxed"]
    assert (r["title"], r["content"], r["author"], r["fav_count"], r["id"], r["page"], r["total_pages"], r["date"]) == ("Pena", "a\nb &c", "x", 7, "3", 2, 4, "")
    r = got["bare"]
    assert (r["content"], r["author"], r["id"], r["fav_count"], r["title"]) == ("düz <b>metin</b>", "Bilinmiyor", None, 0, "bare")


def test_payload_entries_are_told_by_their_json_type(spark):
    rows = [('["{merhaba} dunya", "[1]", 7, null, [1], {"body": "x"}]', "bare"), ('{"note":"[1]","xs":["a","b"]}', "text"),
            ('{"entries":{"a":1},"data":["n"]}', "no list"), ("not json", "bad"), (None, "null"), ('{"zz":["z"],"aa":["a"]}', "order")]
    found = posts.normalize_payload(spark.createDataFrame([(p, s, 1) for p, s in rows], "j string, slug string, page int"), "j").collect()
    got = {}
    for r in found:
        got.setdefault(r["slug"], []).append((r["content"], r["author"], r["total_entries"]))
        assert r["raw_data"] == dict((s, p) for p, s in rows)[r["slug"]]
    assert got == {"bare": [("{merhaba} dunya", "Bilinmiyor", 3), ("[1]", "Bilinmiyor", 3), ("x", "Anonim", 3)],
                   "text": [("a", "Bilinmiyor", 2), ("b", "Bilinmiyor", 2)], "order": [("z", "Bilinmiyor", 1)]}


def test_collection_stops_at_the_first_gap(spark):
    df = spark.createDataFrame([("a", p) for p in (1, 2, 4, 5)] + [("b", 2)] + [("c", p) for p in range(1, 9)] + [("c", 1)], "topic string, page int")
    got = sorted((r["topic"], r["page"]) for r in posts.collect_pages(df, 5).collect())
    assert got == [("a", 1), ("a", 2), ("c", 1), ("c", 1), ("c", 2), ("c", 3), ("c", 4), ("c", 5)]


def test_labelling_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('O dedi ki "çok iyi", ve gitti',), ("kısa",), ("<br>",)], "body string")
    path = str(tmp_path / "label")
    posts.write_for_labelling(df, path)
    back = spark.read.csv(path, header=True, escape='"').collect()
    assert [r["body"] for r in back] == ['O dedi ki "çok iyi", ve gitti'] and back[0].asDict().keys() == {"body", "sentiment"}


def test_labelled_sheet_and_predictions(spark, tmp_path):
    path = str(tmp_path / "sheet.csv")
    df = spark.createDataFrame([(1, "iki\nsatır", "0", "spor")], schemas.LABELLED)
    posts.write_predictions(df, path)
    assert posts.read_labelled(spark, path).first()["body"] == "iki\nsatır"
    posts.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


TOPIC_PAGE = """<html><body><h1 id="title" data-title="pena" data-id="31782" data-slug="pena"><a href="/pena--31782">pena</a></h1>
<div id="disambiguations"><ul><li><a href="/pena-kanal--2">pena (kanal)</a></li></ul></div>
<div class="clearfix pager" data-currentpage="2" data-pagecount="89"></div><div id="hidden-channels"> müzik,spor </div>
<ul id="entry-item-list">
<li data-id="1" data-author="ada" data-author-id="8097" data-favorite-count="12021"><div class="content">
  gitar &amp; <b>pena</b><br>son </div><footer><a class="entry-date permalink" href="/entry/1">15.02.1999 10:00 ~ 10:05</a>
  <a class="entry-author" href="/biri/ada">ada</a></footer>
<li data-id="2"><div class="content">  </div><a class="entry-author">x</a></li>
<li><div class="content">kimliksiz</div><a class="entry-author">x</a></li>
</ul></body></html>"""


def test_topic_page(spark):
    df = spark.createDataFrame([(1, TOPIC_PAGE), (2, None), (3, "<p>boş")], "n int, html string")
    rows = pages.extract_entries(df, ["n"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["id"], r["body"], r["author"], r["author_id"], r["fav_count"]) == ("1", "gitar &amp; <b>pena</b><br>son", "ada", "8097", "12021")
    assert (r["created_at"], r["updated_at"]) == ("15.02.1999 10:00", "15.02.1999 10:05")
    t = pages.extract_topics(df.where("n = 1")).first()
    assert (t["id"], t["title"], t["slug"], t["total_page"], t["current_page"], t["tags"]) == ("31782", "pena", "pena--31782", 89, 2, ["müzik", "spor"])
    assert (t["disambiguation_titles"], t["disambiguation_links"]) == (["pena (kanal)"], ["/pena-kanal--2"])
    empty = pages.extract_topics(df.where("n = 3")).first()
    assert (empty["total_page"], empty["current_page"], empty["tags"]) == (1, 1, None)
    e = pages.extract_entry(df.where("n = 1")).first()
    assert (e["entry"], e["title"], e["author"], e["fav_count"]) == (1, "pena", "ada", 12021)


def test_listing_ignores_foreign_links(spark):
    html = '<ul class="topic-list"><li><a href="/a--5?a=popular"> konu <small>12</small> </a><li><a href="/b--6">b</a></ul><ul><li><a href="/x--1">x</a></ul>'
    got = [tuple(r) for r in pages.extract_threads(spark.createDataFrame([(html,)], "html string")).collect()]
    assert got == [(5, "konu", "/a--5?a=popular", 12), (6, "b", "/b--6", 1)]


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "entries")
    spark.range(10).write.parquet(path)
    plan = filters.entry_by_id(spark.read.parquet(path), 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan


def test_daily_snapshot_is_computed_once(spark, tmp_path):
    path = str(tmp_path / "daily")
    t = datetime(2024, 1, 2, 5)
    first = spark.createDataFrame([(1, t, 5), (2, t, 9), (3, datetime(2024, 1, 2, 3), 1)], "id int, ts timestamp_ntz, fav_count int")
    got = [r["id"] for r in snapshots.daily_snapshot(first, path, date(2024, 1, 2), 2).orderBy("rank").collect()]
    assert got == [2, 1]
    later = spark.createDataFrame([(7, t, 99)], first.schema)
    assert [r["id"] for r in snapshots.daily_snapshot(later, path, date(2024, 1, 2), 2).orderBy("rank").collect()] == [2, 1]
    assert [r["id"] for r in snapshots.daily_snapshot(first, path, date(2024, 1, 1), 2).collect()] == [3]
    assert snapshots.daily_snapshot(first, path, date(2030, 1, 1), 2).count() == 0
    assert snapshots.stored_days(spark, path).count() == 2


def test_helpers_travel_with_the_job():
    """Executors have no copy of the package: its functions are pickled by value."""
    from pyspark import cloudpickle
    from postlens.sources.pages import _Lister
    assert "postlens" in cloudpickle.list_registry_pickle_by_value()
    assert b"handle_starttag" in cloudpickle.dumps(_Lister)


def test_a_folder_of_mixed_shapes_loses_nothing(spark, tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    post = [{"id": str(i), "page": "3", "mood": {"x": [i]}} for i in range(12)]
    _write(folder, "a.json", json.dumps({"metadata": {"n": 2}, "entries": post[:2]}))
    _write(folder, "b.json", json.dumps({"metadata": {"n": 1}, "entries": post[2:3]}))
    _write(folder, "c.json", json.dumps({"metadata": {"n": 2}, "entries": post[3:5]}, indent=2))
    _write(folder, "d.json", "\n".join(["["] + [json.dumps(p) + "," for p in post[5:7]] + [json.dumps(post[7]), "]"]))
    _write(folder, "e.json", json.dumps(post[8:9]))
    _write(folder, "f.jsonl", "\n".join([json.dumps(post[9]), "[1,2]", "{bad", "", '"text"', json.dumps(post[10])]))
    _write(folder, "g.jsonl", "\n".join(["{bad first", json.dumps({**post[11], "page": "three"})]))
    found = posts.read_posts(spark, str(folder))
    rows = sorted(found.entries.collect(), key=lambda r: int(r["id"]))
    assert [r["id"] for r in rows] == [p["id"] for p in post]
    assert [r["page"] for r in rows] == [3] * 11 + [None] and json.loads(rows[4]["other"]["mood"]) == {"x": [4]}
    assert sorted(r["value"] for r in found.metadata.collect()) == ['{"n":1}', '{"n":2}', '{"n":2}']
    assert sorted(r["value"] for r in found.rejects.collect()) == ['"text"', "[1,2]", "{bad", "{bad first"]


def test_missing_values_of_numeric_columns(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, ""), (3, None)], "n int, t string")
    assert [r["n"] for r in filters.drop_missing(df, ["n", "t"]).collect()] == [1]


def test_plain_markup_is_read_as_the_parser_reads_it(monkeypatch):
    rng = random.Random(4)
    parts = ["<ul>", "</ul>", "<li>", '<li data-id="3">', "</li>", '<a href="/x--1?a=b">', "</a>", "<small>", "</small>", "söz > 1", " \n", "&amp;",
             "&#39;", "<br>", '<div class="topic-list x" id="k">', "</div>", "<p>", "</b>"]
    odd = ["<br/>", "a < b", "& x", "<script>", "<!-- a -->", "<a href='/y'>", '<A HREF="/z">', "</", "&amp", '<i title="a&amp;b">']
    for n in range(400):
        page = "".join(rng.choices(parts + odd * (n % 2), k=rng.randrange(1, 25)))
        fast = pages._Lister(page, {"a", "li", "small", ".topic-list", "#k", "br"}).found
        with monkeypatch.context() as m:
            m.setattr(pages._Lister, "_plain", lambda self: False)
            assert fast == pages._Lister(page, {"a", "li", "small", ".topic-list", "#k", "br"}).found, page


def test_pages_of_a_single_file_are_parsed_on_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, i % 7, "view", '{"k": 3}') for i in range(300)], "event_id long, user_id long, event_type string, props string").coalesce(
        1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i, f"n{i}", "m", 1) for i in range(300)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").coalesce(
        1).write.parquet(str(tmp_path / "customer.parquet"))
    for query in (ingest.listed_threads, ingest.search_pages, ingest.user_profiles):
        parts = query(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 4 and sum(r["count"] for r in parts) in (300, 600)


def test_small_dumps_are_read_once(spark, tmp_path, monkeypatch):
    for i in range(300):
        _write(tmp_path, f"d{i}.json", json.dumps({"metadata": {"n": i}, "entries": [{**ENTRIES[0], "id": str(i)}]}, indent=1))
    monkeypatch.setattr(splits, "_compose", None)
    found = posts.read_posts(spark, str(tmp_path), shape="document")
    assert sorted(int(r["id"]) for r in found.entries.select("id").collect()) == list(range(300))
    assert found.metadata.count() == 300 and found.rejects.count() == 0


def test_small_dumps_share_tasks(spark, tmp_path):
    for i in range(400):
        _write(tmp_path, f"d{i}.json", json.dumps({"metadata": {"n": i}, "entries": [{**ENTRIES[0], "id": str(i)}]}, indent=1))
    frame = splits._ranges(spark, str(tmp_path), "}")
    small = splits._packed(frame.where(~splits._cut(spark)))
    assert small.rdd.getNumPartitions() <= 8 < frame.rdd.getNumPartitions()
    found = posts.read_posts(spark, str(tmp_path), shape="document")
    assert sorted(int(r.id) for r in found.entries.collect()) == list(range(400))
    assert sorted(json.loads(r.value)["n"] for r in found.metadata.collect()) == list(range(400)) and found.rejects.isEmpty()


def test_dumps_of_turns_are_files_of_their_own(spark, tmp_path, monkeypatch):
    talks = [(c, t, "user" if t else None, f"söz }} {c} {t}") for c in range(3) for t in range(4)] + [(None, 1, "user", "x"), (0, 0, None, "söz } 0 0")]
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(ingest, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = {(r.field, r.value): r.n for r in ingest.read_dumps(spark, str(tmp_path)).collect()}
    files = [f.name for f in (tmp_path / "dumps").iterdir() if f.name.startswith(("part-", ".part-"))]
    assert files and not [f for f in files if f.endswith(".crc")]
    assert rows["metadata", '{"total_entries":1,"topics":["1"]}'] == 4 and len([f for f, _ in rows if f == "entry"]) >= 11
