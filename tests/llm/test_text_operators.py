from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import regex
from conftest import TOKENIZER, prose
from tokenizers import Tokenizer

from postlens.llm import packing, pii, quality, token_counts

PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "''", "1", "23", "é", "ß", "中文", "!", "<|endoftext|>", "<|endof",
          "　", "\xa0", "²", "٣", "\U0001f600", "‍", "'S", "don't", " '", "x" * 50, "\x1c", "\x85", "ab" * 40, "\0", "\x7f"]


def mixtures(count: int) -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(count)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_token_counts_equal_the_library(make_docs, odd_rows, library):
    rows = [*odd_rows, *((100 + i, t, None) for i, t in enumerate(mixtures(1500)))]
    found = token_counts.count_tokens(make_docs(rows), TOKENIZER).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


def test_small_blocks_and_tables_change_nothing(monkeypatch, library):
    texts = [*mixtures(200), prose(3, 2000)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for name, value in (("BLOCK_CHARS", 500), ("MAX_STATES", 200), ("MAX_MEMO", 20), ("MAX_PAIRS", 50)):
        monkeypatch.setattr(token_counts, name, value)
    token_counts.load.cache_clear()
    assert token_counts.count_texts(texts, TOKENIZER).tolist() == want
    assert [p for t in texts[-1:] for p in token_counts.cut_long(t, 500)] and "".join(token_counts.cut_long(texts[-1], 500)) == texts[-1]
    token_counts.load.cache_clear()


def test_the_counter_keeps_the_states_of_many_rare_words(monkeypatch):
    rng = random.Random(4)
    rare = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(45_000)]
    counter = token_counts.Counter(TOKENIZER)
    first = [counter.count(w.encode()) for w in rare]
    assert len(counter.states) > 100_000
    made = len(counter.moves)
    assert [counter.count(w.encode()) for w in rare] == first
    assert len(counter.moves) == made  # nothing was dropped and made again
    monkeypatch.setattr(token_counts, "MAX_MOVES", 50)
    assert [counter.count(w.encode()) for w in rare[:300]] == first[:300] and len(counter.moves) < 200


def test_character_classes_equal_the_library():
    from tokenizers.pre_tokenizers import ByteLevel
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    points = [c for c in [*range(33, 0x3000), *range(0x10000, 0x13000)] if c != 39 and c not in (0x85, 0xA0, 0x1680) and not 0x2000 <= c < 0x2060]
    text = "".join(f"a{chr(c)}1" for c in points)
    starts = {a for _, (a, _) in split.pre_tokenize_str(text)}
    kinds = token_counts._tables()[0]
    for i, c in enumerate(points):
        letter, number = 3 * i + 1 not in starts, 3 * i + 2 not in starts
        assert (kinds[c] == token_counts.LETTER, kinds[c] == token_counts.NUMBER) == (letter, number), hex(c)


def test_differencing_and_windows():
    rng = random.Random(2)
    sizes = [rng.randint(1, 2047) for _ in range(120)]
    for found in (packing.differencing(sizes, 60), packing.windows_of(sizes, 2048)):
        assert sorted(i for s in found for i in s) == list(range(120))
    assert all(sum(sizes[i] for i in s) <= 2048 for s in packing.windows_of(sizes, 2048))
    assert packing.windows_of([3, 3, 3], 4) == [[0], [1], [2]] or len(packing.windows_of([3, 3, 3], 4)) == 3
    sums = [sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(sums) == [14, 16]
    cut = packing.cut_windows(sizes, 2048)
    assert len(cut) == -(-sum(sizes) // 2048)
    covered = Counter((i, k) for w in cut for i, a, n in w for k in range(a, a + n))
    assert set(covered.values()) == {1} and len(covered) == sum(sizes)
    assert packing.windows_of([], 5) == [] and packing.cut_windows([], 5) == []


def test_packing_round_trip(make_docs, odd_rows, library):
    import numpy as np
    rows = [*odd_rows, *((100 + i, t, None) for i, t in enumerate(mixtures(200)))]
    found = packing.pack(make_docs(rows), TOKENIZER).collect()
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _ in rows)
    once = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None]
    for i, text, _ in once:
        ids = []
        for r in sorted((r for r in found if r.doc_id == i), key=lambda r: r.start):
            assert r.start == len(ids)
            ids += np.frombuffer(r.ids, "<u4").tolist()
            assert r.length == len(r.ids) // 4
        assert want[tuple(ids)] and {r.doc_tokens for r in found if r.doc_id == i} == {len(ids)}
    assert sum(r.length for r in found) == sum(len(k) * v for k, v in want.items())
    at = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text: str) -> str:
    def holds(kind, value):
        number = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return max(map(int, value.split("."))) <= 255
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
            return 12 <= len(number) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0
        return kind == "email" or 9 <= len(number) <= 15

    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_private_spans_equal_plain_patterns(make_docs, odd_rows):
    rng = random.Random(5)
    parts = ["a", "b.", "@", "x@y.z", "a.b@c-d.e.f", "1", "12", "255", ".", "1.2.3.4", "300.1.1.1", "+", "+49 (30) 123-4567", "4111 1111 1111 1111",
             "4111111111111112", "-", " ", "é", "\U0001f600", "\n", "_q@w.e", "%", "0" * 20, "+1"]
    rows = [*odd_rows, *((100 + i, "".join(rng.choices(parts, k=rng.randint(0, 25))), None) for i in range(400)),
            (9001, "7" * 20000, "a"), (9002, "a" * 50000, "a"), (9003, "1 " * 20000, "a")]
    found = pii.find_private(make_docs(rows)).collect()
    want = Counter()
    for i, text, _ in rows:
        spans = base_spans(text or "")
        want[i, hashlib.sha256(spans.encode()).hexdigest(), *(len(re.findall(k, spans)) for k in BASE)] += 1
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == want


def test_revealing_terms(make_docs):
    rows = [(i, f"{prose(i, 30)} ask Zorblatt about it at boss@corp.example or the office {prose(50 + i, 30)}", "a") for i in range(6)]
    rows += [(20 + i, f"{prose(80 + i, 20)} about it or the office {prose(90 + i, 20)}", "a") for i in range(30)]
    rows += [(60, "Zorblatt alone", "a"), (61, None, "a")]
    docs = make_docs(rows)
    found = {r.doc_id: r.spans.split(",") for r in pii.find_private(docs).collect()}
    assert found[60] == ["term:0:8"] and found[61] == [""]
    text = rows[0][1]
    at, mail = text.index("Zorblatt"), text.index("boss@")
    assert f"term:{at}:{at + 8}" in found[0] and f"email:{mail}:{mail + 17}" in found[0]
    assert all(found[20 + i] == [""] for i in range(30))
    clean = pii.sanitise(docs)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and after[60] == "[NAME] alone" and after[61] is None
    assert "[EMAIL]" in after[0] and "boss@" not in after[0] and after[25] == rows[11][1]


def terms_by_force(texts: list[str]) -> set[str]:
    """Terms that share three different texts or more with a value, and at least half of their own."""
    different = sorted({t or "" for t in texts})
    terms = [{m.lower() for m in regex.findall(pii.WORD_TERM, t)} for t in different]
    values = [{t[int(a):int(b)].lower() for _, a, b in (x.split(":") for x in base_spans(t).split(",") if x)} for t in different]
    stands = Counter(w for own in terms for w in own)
    both = Counter((w, v) for own, held in zip(terms, values, strict=True) for w in own for v in held)
    return {w for (w, _), n in both.items() if n >= pii.MIN_SUPPORT and stands[w] <= 2 * n}


def test_revealing_terms_equal_brute_force_on_whole_texts(make_docs, odd_rows):
    rng = random.Random(9)
    common = [f"w{chr(97 + i)}" for i in range(12)]
    rare = [*(f"Name{chr(97 + i)}" for i in range(12)), "Qx", "Z", "李", "é"]
    values = ["a@b.cd", "A@b.cd", "x@y.zw", "10.1.2.3", "+49 30 1234567"]
    rows = [*odd_rows]
    for i in range(200):
        parts = rng.choices(common, k=12) + rng.sample(rare, rng.randint(0, 2))
        if rng.random() < 0.3:
            at = rng.randrange(len(values))
            parts += [values[at], *(rare[3 * at + j] for j in range(3) if rng.random() < 0.8)]
        rng.shuffle(parts)
        rows += [(i, " ".join(parts), "a")] * rng.choice([1, 1, 1, 3])
    # Far from the value, in short names and at the other end of a long text.
    rows += [(500 + i, f"Zorblattine Quxx Io {prose(i, 40)} v@alue.example {prose(60 + i, 40)}", "a") for i in range(10)]
    rows += [(600 + i, f"Io {prose(i, 3000)} long@text.example {prose(i, 3000)} Farawaynamed {i}", "a") for i in range(4)]
    want = terms_by_force([t for _, t, _ in rows])
    assert {"zorblattine", "quxx", "farawaynamed"} <= want and "wa" not in want
    found = pii.find_private(make_docs(rows)).collect()
    assert len(found) == len(rows)
    texts = {i: t or "" for i, t, _ in rows if i is not None}
    for r in found:
        if r.doc_id in texts and sum(x[0] == r.doc_id for x in rows) == 1:
            text, base = texts[r.doc_id], base_spans(texts[r.doc_id])
            taken = [tuple(map(int, x.split(":")[1:])) for x in base.split(",") if x]
            spots = [(m.start(), f"term:{m.start()}:{m.end()}") for m in regex.finditer(pii.WORD_TERM, text)
                     if m[0].lower() in want and not any(a < m.end() and m.start() < b for a, b in taken)]
            whole = sorted([*spots, *((int(x.split(":")[1]), x) for x in base.split(",") if x)], key=lambda x: x[0])
            assert sorted(r.spans.split(",")) == sorted(x for _, x in whole) or (not whole and r.spans == "")


def quality_by_force(text: str) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            len(words) < 20 or 100 * len(inside) > 30 * len(words))


def test_quality_counts_equal_brute_force(make_docs, odd_rows):
    block = prose(6, 12)
    rows = [*odd_rows, (50, f"{block} x {block} {block}\n" + prose(7, 60), "a"), (51, "l1 #\nl1 #\n\n \nl1 #\r\n" + "a|b " * 50, "a"), (52, "w " * 100, "b")]
    found = quality.judge(make_docs(rows)).collect()
    want = Counter((i, *quality_by_force(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want


def test_common_lines_deplete_documents_but_not_copies(make_docs):
    footer = "All rights reserved   by the Owner of these pages and of all the texts that are shown on them today"
    rows = [(i, f"{prose(i, 3)}\n{footer if i % 2 else footer.upper()}", "a") for i in range(40)]
    rows += [(100 + i, f"{prose(i, 90)}\n{footer}", "a") for i in range(40)]
    rows += [(200 + i, prose(400, 40) + "\n" + prose(401, 40), "a") for i in range(50)]  # copies of one good document
    rows += [(300 + i, f"{prose(i, 3)}\n{footer}", "b") for i in range(10)]  # not common on this host
    docs = make_docs(rows)
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert not kept & set(range(40)) and kept >= {*range(100, 140), *range(200, 250), *range(300, 310)}
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    stripped = quality.strip_lines(docs, quality.common_lines(quality.measure(docs)))
    after = {r.doc_id: r.text for r in stripped.collect()}
    assert stripped.columns == docs.columns and after[100] == prose(0, 90) and after[301] == rows[-9][1]


def test_lines_are_common_by_the_documents_that_hold_them(make_docs):
    shared = [f"shared line number {j} with the words " + prose(700 + j, 12) for j in range(5)]
    page = "\n".join([prose(710, 90), prose(711, 90), "a footer that one copied page and many others have"])
    rows = [(i, "\n".join([prose(800 + i, 3), *shared]), "a") for i in range(120)]
    rows += [(300 + i, page, "a") for i in range(200)]  # one document in many copies
    rows += [(600 + i, prose(1000 + i, 3) + "\n" + page.split("\n")[2], "a") for i in range(40)]
    docs = make_docs(rows)
    lines = quality.common_lines(quality.measure(docs)).count()
    assert lines == len(shared) + 1
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept == set(range(300, 500))


@pytest.mark.parametrize("run", [lambda d: token_counts.count_tokens(d, TOKENIZER), lambda d: packing.pack(d, TOKENIZER), pii.find_private,
                                 pii.sanitise, quality.judge, quality.keep_good])
def test_empty_table(make_docs, run):
    assert run(make_docs([])).count() == 0
