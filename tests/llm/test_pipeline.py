from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import TOKENIZER, prose
from test_dedup import edited, groups_by_force
from test_text_operators import quality_by_force
from test_web_and_mix import repeated_by_force

import corpus_pipeline
from postlens.llm import packing


def by_force(rows):
    """(id, text) of what reaches the last stage, each stage restated over plain lists."""
    good = [r for r in rows if not quality_by_force(r[1])[-1]]
    last = {t: max((i for i, u, _ in good if u == t and i is not None), default=None) for _, t, _ in good}
    unique = list(dict.fromkeys(r for r in good if r[0] == last[r[1]]))
    component = {(i, n): c for i, n, c in groups_by_force(unique)}
    kept = [r for r in unique if any(i == str(r[0]) and c == str(r[0]) for (i, _), c in component.items())]
    return repeated_by_force(kept)


def test_pipeline_equals_its_stages_by_force(spark, make_docs, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = [(i, prose(i, 40 + i), "ab"[i % 2]) for i in range(40)]
    rows += [(100 + i, rows[i][1], "a") for i in range(10)] + [(200 + i, edited(i, rows[20 + i][1], 1), "b") for i in range(8)]
    rows += [(300, None, "a"), (301, "few words", "b"), (302, "again " * 60, "b"), (303, prose(9000, 5000), None)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = packing.load(TOKENIZER)
    want = Counter()
    for doc, text in by_force(rows):
        want[doc, len(encoder.encode(text)) + 1] += 1
    # Every repetition is packed whole: its pieces cover its tokens once.
    pieces, sequences = defaultdict(Counter), defaultdict(list)
    for r in found:
        pieces[r.doc_id, r.doc_tokens][r.start, r.length] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sum(n * length for (_, length), n in p.items()) for k, p in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    for parts in sequences.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
    # The checksum is that of the ids.
    texts = dict(by_force(rows))
    for r in found:
        if want[r.doc_id, r.doc_tokens] == 1 and len(encoder.encode(texts[r.doc_id])) + 1 == r.doc_tokens:
            ids = np.append(encoder.encode(texts[r.doc_id]), packing.END_TOKEN).astype("<u4")[r.start:r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(ids.tobytes())


def test_pipeline_on_odd_rows_and_an_empty_table(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert found and {r.doc_id for r in found} <= {i for i, _, _ in odd_rows}
    make_docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_every_stage_returns_the_columns_of_documents(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
