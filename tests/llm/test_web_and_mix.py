from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from conftest import TOKENIZER, prose

from postlens.llm import mixing, packing, url_filters, warc

PAGE_SCHEMA = "page_id long, url string, html string, _id string, _digest string, host string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGE_SCHEMA)


WEB = [
    (1, "http://a.example.org/en/1", "x" * 1000), (5, "http://a.example.org/en/2", "x" * 1000), (3, None, "x" * 1000), (5, "http://a.example.org/en/2", "x" * 1000),
    (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "http://ü.de/?q=a b#c", None), (10, "no scheme", "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 50),
    (None, "http://n/", "x" * 1000), (11, "http://long/", "<p>%d</p>" * 200_000), (12, "http://e/\r\nWARC-Type: fake", "")]


def test_archives_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(pages_of(spark, WEB), path, records_per_file=3)
    found = warc.read_archives(spark, path).collect()
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "archive").glob("part-*")))
    assert plain.count(b"WARC-Record-ID") == len(WEB) and plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
    want = Counter()
    for i, _, html in WEB:
        body = (html or "").encode()
        same = [j for j, _, h in WEB if h == html and j is not None]
        keep = max(same, default=None) if len(body) >= 1000 else i
        want[None if i is None else str(i), len(body), hashlib.sha1(body).hexdigest(), "response" if keep == i else "revisit", None if keep == i else str(keep)] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    texts = {str(i): (h or "").encode() for i, _, h in WEB}
    assert all(r.payload is None if r.record_type == "revisit" else r.payload == texts.get(str(r.record_id), b"x" * 1000) for r in found)


@pytest.mark.parametrize("damage", [lambda b: b[:-9], lambda b: warc.gzip_member(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"), lambda b: warc.gzip_member(b"no record"),
                                    lambda b: warc.gzip_member(gzip.decompress(b).replace(b"hello", b"jello"))])
def test_damaged_records_are_reported(damage):
    good = warc.gzip_member(warc.make_record("1", "http://a/", b"hello", None))
    ok = [warc.open_record(warc.read_record(m)) for m in warc.inflate(memoryview(good))]
    assert ok[0][0] == "1" and ok[0][-1] == b"hello"
    with pytest.raises(ValueError):
        for member in warc.inflate(memoryview(damage(good))):
            warc.open_record(warc.read_record(member))
            list(member)


def test_url_parts_and_longest_rule(spark):
    rows = [(1, "https://A.Example.ORG/en/1x?y#z", None), (2, "http://example.org/es/q", None), (3, "http://notexample.com/de/", None),
            (4, "http://x.com", None), (5, "x.com/fr/", None), (6, None, None), (7, "ftp://u:p@h.com:80?x", None), (8, "http://org/", None), (9, "http://\n.com/fr/\n?", None)]
    found = {r.page_id: (r.host, r.path, r.rule) for r in url_filters.judge(pages_of(spark, rows)).collect()}
    assert found == {1: ("a.example.org", "/en/1x", "example.org/en/1"), 2: ("example.org", "/es/q", "example.org/es/"), 3: ("notexample.com", "/de/", "com/de/"),
                     4: ("x.com", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("u:p@h.com:80", "", None), 8: ("org", "/", "org/"), 9: ("\n.com", "/fr/\n", "com/fr/")}


def test_distrust_runs_against_links(spark):
    link = '<a href="http://bad.com/de/">x</a>'
    rows = [(1, "http://bad.com/de/", ""), (2, "http://farm.net/", link * 3), (3, "http://good.net/", ""), (4, "http://fine.org/", '<a HREF=//good.net/a>y</a>'), (5, "http://alone.net/", None)]
    found = {r.page_id: r.verdict for r in url_filters.judge(pages_of(spark, rows)).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def mixed_by_force(rows, max_epochs=3):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(max_epochs * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and max_epochs * sizes[s] <= rest * weight[s] / free}
        if not over:
            return sizes, {s: max_epochs * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        capped |= over


def test_mix_meets_its_targets(make_docs, odd_rows):
    rows = [*odd_rows, *((100 + i, prose(i, 1 + i % 90), "abcde"[i % 5] if i % 3 else "z") for i in range(300)), (999, prose(1, 5), "tiny")]
    docs = make_docs(rows)
    found = mixing.mix_documents(docs, block_words=64).collect()
    sizes, targets = mixed_by_force(rows)
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in found:
        source = next(s for s in sizes if sizes[s] == r.source_size and abs(targets[s] - r.target) < 1e-6)
        taken[source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(0 <= targets[s] - taken[s] < 1 for s in taken)
    again = mixing.mix_documents(docs.repartition(7), block_words=64)
    assert Counter(again.collect()) == Counter(found)


def test_schedule_is_even_and_complete(make_docs):
    rows = [(i, prose(i, 50), "abc"[i % 3]) for i in range(300)]
    mix = mixing.plan_mix(make_docs(rows), block_words=50)
    slots = sorted(mix.schedule.collect(), key=lambda r: r.slot)
    need = {r._s: r._need for r in mix.sources.collect()}
    assert {s: sorted(r.turn for r in slots if r._s == s) for s in need} == {s: list(range(n)) for s, n in need.items()}
    for s, n in need.items():  # at every point of the schedule a source is near its share
        seen = 0
        for at, r in enumerate(slots, 1):
            seen += r._s == s
            assert abs(seen - at * n / len(slots)) < 4
    pieces = mixing.taken_pieces(mix, 50).collect()
    assert all(0 <= p.first and p.words > 0 and p.first + p.words <= 50 for p in pieces)


def test_repeating_documents(make_docs):
    rows = [(i, prose(i, 20), "ab"[i % 2]) for i in range(40)] + [(90, None, "a"), (91, "", None)]
    docs = make_docs(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert rows[r.doc_id][1].startswith(r.text)
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert sum(len(r.text.split()) < 20 for r in out.collect()) <= 2


def repeated_by_force(rows):
    """(id, text) as often as the mix takes them, with the cut text of each source."""
    sizes, targets = mixed_by_force(rows)
    out = []
    for source, size in sizes.items():
        order = sorted(((hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest(), i is not None, i or 0, len(t.split()), t)
                        for i, t, s in rows if s == source and t and t.split()), key=lambda x: x[:4])
        take = int(targets[source] + 1e-9) if size else 0
        left = take % size if size else 0
        for _, known, i, n, text in order:
            doc = i if known else None
            out += [(doc, text)] * (take // size)
            if left >= n:
                out.append((doc, text))
            elif left > 0:
                out.append((doc, re.match(rf"(?:\s*\S+){{{left}}}", text)[0]))
            left -= n
    return out


def test_repeats_equal_brute_force_with_one_cut_a_source(make_docs):
    rows = [(i, f" {prose(i, 3 + i % 50)}\n", "abcd"[i % 4] if i % 5 else None) for i in range(200)] + [(None, "lone words here", "e"), (900, " ", "a"), (901, None, "f")]
    out = mixing.repeat_documents(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(repeated_by_force(rows))
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    sizes, targets = mixed_by_force(rows)
    assert all(words[s] == int(t + 1e-9) for s, t in targets.items())
    # The order mixes the sources: no long stretch misses one of the large ones.
    last = {s: [k for k, r in enumerate(out) if r.source == s] for s in "abcd"}
    assert all(max(b - a for a, b in zip(x, x[1:])) < len(out) / 4 for x in last.values())


def test_repeats_stand_in_the_order_of_the_schedule(make_docs):
    docs = make_docs([(i, prose(i, 100 + i % 40), "abc"[i * i % 7 % 3]) for i in range(120)])
    mix = mixing.plan_mix(docs)
    laid = {r._id: (r._s, r._start) for r in mix.docs.collect()}
    blocks = {r._s: r._blocks for r in mix.sources.collect()}
    slots = {(r._s, r.turn): r.slot for r in mix.schedule.collect()}
    seen, places = Counter(), []
    for r in mixing.repeat_documents(docs).collect():
        s, start = laid[r.doc_id]
        places.append((slots[s, seen[r.doc_id] * blocks[s] + start // mixing.BLOCK_WORDS], start))
        seen[r.doc_id] += 1
    assert places == sorted(places) and len({slot for slot, _ in places}) > 10


def test_repeats_of_rows_that_share_id_and_size(make_docs):
    rows = [(1, f"{w} " * 10, "a") for w in ("x", "y", "z")] + [(2, "q " * 30, "b"), (2, "q " * 30, "b"), (3, "r " * 50, "c")]
    out = mixing.repeat_documents(make_docs(rows)).collect()
    words, (sizes, targets) = Counter(), mixed_by_force(rows)
    for r in out:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 3 for s, t in targets.items())


@pytest.mark.parametrize("run", [mixing.mix_documents, mixing.repeat_documents])
def test_empty_documents(make_docs, run):
    assert run(make_docs([])).count() == 0


def test_empty_pages(spark, tmp_path):
    assert url_filters.judge(pages_of(spark, [])).count() == 0
    warc.write_archives(pages_of(spark, []), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_distrust_reaches_hosts_many_links_away(spark):
    n = 14
    rows = [(i, f"http://h{i}.test/", f'<a href="http://h{i + 1}.test/">x</a>') for i in range(n)] + [(n, f"http://h{n}.test/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = url_filters.judge(pages, [url_filters.Rule("block", f"h{n}.test", "/")])
    assert {r.page_id for r in found.where("verdict = 'block'").collect()} == set(range(n + 1))
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    scores = {r.host: r.trust for r in url_filters.propagate(edges, seeds).collect()}
    assert abs(scores["a"] - 0.15 / (1 - 0.85 ** 2)) < 1e-8 and abs(scores["b"] - 0.85 * scores["a"]) < 1e-8


def _by_sql(sql, **tables):
    import duckdb
    db = duckdb.connect()
    for name, frame in tables.items():
        db.register(name, frame.toPandas())
    return db.execute(sql).fetchall()


def test_url_sql_states_the_rule_on_linked_hosts(spark):
    """A chain of 15 hosts to a blocked one, a ring with a trusted host, and hosts that nothing reaches."""
    def page(i, host, path, *to):
        return (i, f"http://{host}{path}", " ".join(f'<a href="http://{t}/">x</a>' for t in to))

    rows = [page(i, f"h{i}.test", "/", f"h{i + 1}.test") for i in range(15)] + [page(15, "h15.test", "/", "bad.com")]
    rows += [page(20, "bad.com", "/de/1"), page(21, "good.org", "/", "r1.test"), page(22, "r1.test", "/", "r2.test", "bad.com"), page(23, "r2.test", "/", "good.org")]
    rows += [page(30, "alone.test", "/"), (31, None, None), (32, "nonsense", "<a href='http://h1.test'>")]
    pages = pages_of(spark, rows)
    found = sorted(tuple(r) for r in url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect())
    want = sorted(tuple(None if x != x else x for x in r) for r in _by_sql(url_filters.QUERIES["op5_url_filters"].sql, pages=pages))
    assert found == want
    verdicts = {r[0]: r[4] for r in found}
    assert all(verdicts[i] == "block" for i in range(16)) and verdicts[30] == verdicts[31] == "allow"


def test_quality_sql_states_the_rule_on_shared_lines(spark):
    from postlens.llm import quality
    shared = [f"common line number {k} of this host" for k in range(5)]
    rows = [(i, "\n".join([*shared, *(prose(900 + 7 * i + j, 1) for j in range(3))]), "a") for i in range(120)]
    rows += [(200 + i, "\n".join([shared[0], prose(3000 + i, 60)]), "a") for i in range(20)] + [(300 + i, rows[0][1], "b") for i in range(50)]
    rows += [(400, None, None), (401, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = sorted(tuple(r) for r in quality.judge(docs).select(*columns).collect())
    assert found == sorted(_by_sql(f"SELECT {', '.join(columns)} FROM ({quality.QUERIES['op10_quality_rules'].sql})", documents=docs))
    kept = {r[0]: r[-1] for r in found}
    # Documents made of common lines go; those with much of their own stay, and so do copies of one text, which count once.
    assert not any(kept[i] for i in range(120)) and all(kept[200 + i] for i in range(20)) and all(kept[300 + i] for i in range(50))


def test_foreign_records_are_read(spark, tmp_path):
    """Records as other writers make them: no payload digest, hex digests, no HTTP block, uuids."""
    def member(block, **headers):
        lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
        return gzip.compress(f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    digest = hashlib.sha1(b"<p>hi</p>").hexdigest()
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join([
        member(b"software: x\r\n", WARC_Type="warcinfo", WARC_Record_ID="<urn:uuid:1>", Content_Type="application/warc-fields"),
        member(b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", WARC_Type="request", WARC_Record_ID="<urn:uuid:2>", Content_Type="application/http; msgtype=request"),
        member(page, WARC_Type="response", WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="http://a/"),
        member(page, WARC_Type="response", WARC_Record_ID="<urn:uuid:4>", WARC_Payload_Digest=f"sha1:{digest}", WARC_Block_Digest="md5:00"),
        member(b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n", WARC_Type="revisit", WARC_Record_ID="<urn:uuid:5>", WARC_Refers_To="<urn:uuid:3>"),
        member(b"{}", WARC_Type="metadata", WARC_Record_ID="<urn:uuid:6>")]))
    rows = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert [rows[f"urn:uuid:{i}"].record_type for i in range(1, 7)] == ["warcinfo", "request", "response", "response", "revisit", "metadata"]
    assert rows["urn:uuid:3"].payload == b"<p>hi</p>" and rows["urn:uuid:3"].payload_digest == rows["urn:uuid:4"].payload_digest == digest
    assert rows["urn:uuid:5"].refers_to == "urn:uuid:3" and rows["urn:uuid:5"].payload_bytes is None and rows["urn:uuid:6"].payload == b"{}"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.gz").write_bytes(member(page, WARC_Type="response", WARC_Record_ID="<urn:uuid:7>", WARC_Payload_Digest="sha1:" + "0" * 40))
    with pytest.raises(Exception, match="does not hold"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()
