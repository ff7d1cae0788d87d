"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Each task packs the rows of its own partition as they stream by, so the job has
no shuffle and no hot key, and holds one group of windows at a time. Whole
windows are cut off long documents. The rests form groups of exactly
``GROUP_WINDOWS`` windows' worth of tokens; differencing spreads a group over
its windows near-evenly and the few tokens above a window's capacity are cut off
into the room that others have left. Only the last group of a task is not full.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Query, table, whole
from postlens.llm.token_counts import byte_alphabet, unsettled_characters

TOKENIZER = "byte_bpe_50k.json"
WINDOW = 2048
END_TOKEN = 1
GROUP_WINDOWS = 32
BATCH_BYTES = 8 << 20
#: The words of byte-level tokenizers.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HIGH = re.compile("[\U00010000-\U0010ffff]")
ENDLESS = re.compile(r"\S{1000}|\s{1000}")


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``parts`` sets of near-equal sums.

    Every size starts as a partial partition with one filled set. The two
    partitions with the largest spread are merged, the fullest set of one with
    the emptiest of the other, until one is left.
    """
    empty = (0,) * (parts - 1)
    heap = [(-size, i, (size, *empty), ([i], *([] for _ in empty))) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        sums = [a + b for a, b in zip(sums_a, reversed(sums_b), strict=True)]
        sets = [a + b for a, b in zip(sets_a, reversed(sets_b), strict=True)]
        order = sorted(range(parts), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]]
        heapq.heappush(heap, (low - sums[order[0]], serial, tuple(sums[i] - low for i in order), tuple(sets[i] for i in order)))
        serial += 1
    return list(heap[0][3]) if heap else [[] for _ in range(parts)]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of near-equal sums, none above ``capacity``; the number of sets rises until that holds.

    No size may exceed ``capacity``.
    """
    if any(size > capacity for size in sizes):
        raise ValueError("a piece exceeds the capacity")
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, parts)
        if all(sum(sizes[i] for i in found) <= capacity for found in sets):
            return [found for found in sets if found]
        parts += 1


def cut_windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """As ``windows_of``, but with as few windows as the sum allows: what exceeds a window is cut off
    and fills the room in others. A window is a list of (index, start, length)."""
    parts = max(1, -(-sum(sizes) // capacity))
    windows, spare = [], []
    for found in differencing(sizes, parts):
        window, room = [], capacity
        for i in found:
            take = min(room, sizes[i])
            if take:
                window.append((i, 0, take))
            if take < sizes[i]:
                spare.append((i, take, sizes[i] - take))
            room -= take
        windows.append((window, room))
    spare.reverse()
    for window, room in windows:
        while room and spare:
            i, start, length = spare.pop()
            take = min(room, length)
            window.append((i, start, take))
            room -= take
            if take < length:
                spare.append((i, start + take, length - take))
    return [window for window, _ in windows if window]


class Encoder:
    """Ids of texts as the tokenizers library gives them for a tokenizer file, special strings included.

    A byte-level BPE whose ids follow the order of its merges is the same machine
    in tiktoken, which is several times faster; it is built from the same file.
    Texts with endless words, on which tiktoken takes quadratic time, or with
    characters whose class depends on the version of Unicode, and all other kinds
    of tokenizers go through the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast = self._ranked(json.load(file))
        new = unsettled_characters()
        self.new_low, self.new_high = (
            re.compile("[" + "".join(f"\\U{c:08x}" for c in found) + "]") for found in (new[new < 0x10000], new[new >= 0x10000]))

    @staticmethod
    def _ranked(spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(
            (spec.get("normalizer"), split.get("add_prefix_space"), model.get("dropout"), model.get("byte_fallback"), model.get("ignore_merges"))))
        added = spec.get("added_tokens", [])
        if not plain or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            return None
        vocabulary, special = model["vocab"], {x["content"]: x["id"] for x in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        alphabet = byte_alphabet()
        words = {text: i for text, i in vocabulary.items() if text not in special}
        if made != sorted(set(made)) or len(made) + len(alphabet) != len(words) or any(c not in alphabet for w in words for c in w):
            return None
        import tiktoken
        ranks = {bytes(alphabet[c] for c in text): i for text, i in words.items()}
        return tiktoken.Encoding("ranked", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or ENDLESS.search(text) or not text.isascii() and (
                self.new_low.search(text) or HIGH.search(text) and self.new_high.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


class Piece(NamedTuple):
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], window: int = WINDOW,
                group: int = GROUP_WINDOWS) -> Iterator[list[Piece]]:
    """Sequences, each a list of pieces, for a stream of (id, token ids). Holds one group of windows at a time."""
    held: list[Piece] = []
    room = window * group

    def close():
        for found in cut_windows([len(p.ids) for p in held], window):
            yield [Piece(held[i].doc, held[i].start + a, held[i].ids[a:a + n], held[i].doc_tokens) for i, a, n in found]
        held.clear()

    for doc, ids in docs:
        total, at = len(ids), 0
        while total - at >= window:
            yield [Piece(doc, at, ids[at:at + window], total)]
            at += window
        while at < total:
            take = min(room, total - at)
            held.append(Piece(doc, at, ids[at:at + take], total))
            room -= take
            at += take
            if not room:
                yield from close()
                room = window * group
    yield from close()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level file of the tokenizers library,
    present on every worker. A document is its ids and ``end_token``; a null or
    empty text is that token alone. Pieces of a sequence fill it from offset 0
    without gaps, at most ``window`` tokens. Null and repeated ids go through,
    an empty table gives an empty result, and other columns are ignored,
    whatever their names. Sequence ids follow from the partition and the place
    in it, so a lost task's rerun gives the same rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType
    schema = f"_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        end = np.array([end_token], "<u4")
        id_type = None

        def encoded():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                for doc, text in zip(*batch.columns, strict=True):
                    yield doc.as_py(), np.concatenate([encoder.encode(text.as_py()), end])


        def batch_of(rows):
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        number = TaskContext.get().partitionId() << 33
        rows, size = [], 0
        for sequence in pack_stream(encoded(), window):
            offset = 0
            for piece in sequence:
                rows.append((piece.doc, piece.start, len(piece.ids), piece.ids.tobytes(), piece.doc_tokens, number, offset))
                offset += len(piece.ids)
            number += 1
            size += 4 * offset
            if size >= BATCH_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def piece_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of ``documents`` with a checksum in place of their ids."""
    return pack(docs, tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _run(spark, folder):
    import public_tokenizers
    return piece_table(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op7_packing": Query(_run)}
