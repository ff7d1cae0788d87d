"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

Two deterministic machines are compiled from the tokenizer's file.

1. The splitter reads character classes and marks where a pre-token begins. It
   has eight states, so a chunk of text acts on it as a map from eight states to
   eight states. The maps of all chunks are computed side by side, composed by a
   parallel prefix scan, and each chunk is then run once from its true state.
2. The counter reads the bytes of a pre-token. Its transitions carry the change
   of the number of tokens, so the number is the sum along the path. Its states
   are the token boundaries that can still matter (see ``Counter``); they are
   made on first use and dropped together when there are too many, which bounds
   memory and changes no result.

Texts are counted where they lie: the job has no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from postlens.llm.common import Query, table, whole

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: Characters handled together in a task.
BLOCK_CHARS = 1 << 20
#: Characters in a chunk whose state map is computed on its own.
CHUNK_CHARS = 64
#: Bounds of the memo of pre-tokens, of the counter's states and transitions, and of its checked token pairs. Those of
#: ordinary prose fit: what is dropped must be made again, which takes far longer than to find it.
MAX_MEMO, MAX_STATES, MAX_MOVES, MAX_PAIRS = 600_000, 300_000, 800_000, 300_000
MEMO_CHARS = 64

# Symbols of the splitter's alphabet.
LETTER, NUMBER, OTHER, SHORT, LONG, JOINED, LONE, SPACE, END = range(9)
#: States: at a start, in letters, numbers, others, after a joining blank, in white space, one or two letters of a contraction left.
STATES = FRESH, LETTERS, NUMBERS, OTHERS, JOIN, SPACES, ONE_LEFT, TWO_LEFT = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables (next state, begins a pre-token), each indexed by [state, symbol]."""
    follow = np.empty((8, 9), np.uint8)
    begins = np.ones((8, 9), bool)
    for state in STATES:
        for symbol, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            follow[state, symbol] = run
            begins[state, symbol] = state not in (run, JOIN)
        for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            inside = state in (OTHERS, JOIN)
            follow[state, symbol] = OTHERS if inside else left
            begins[state, symbol] = not inside
        follow[state, JOINED], follow[state, LONE], follow[state, END] = JOIN, FRESH, FRESH
        follow[state, SPACE] = SPACES
        begins[state, SPACE] = state != SPACES
    for state, rest in ((ONE_LEFT, FRESH), (TWO_LEFT, ONE_LEFT)):
        follow[state, LETTER], begins[state, LETTER] = rest, False
    return follow, begins


FOLLOW, BEGINS = _splitter()
MARK = 0x110000  # stands between texts; no character has this number


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every character, and the characters whose class depends on the version of Unicode.

    Letters and numbers on which Python's two databases agree are settled; the few others are asked of the
    tokenizers library itself.
    """
    kinds = np.full(MARK + 1, OTHER, np.uint8)
    points = np.array([*range(0xD800), *range(0xE000, MARK)])
    every = "".join(map(chr, points.tolist()))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for run in regex.finditer(pattern, every):
            kinds[points[run.start():run.end()]] = kind
    older = np.full(MARK + 1, OTHER, np.uint8)
    older[points] = [{"L": LETTER, "N": NUMBER}.get(category(c)[0], OTHER) for c in every]
    older[kinds == SPACE] = SPACE
    unsettled = np.flatnonzero(older != kinds)
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    starts = {at for _, (at, _) in split.pre_tokenize_str("".join(f"a{chr(c)}1" for c in unsettled.tolist()))}
    kinds[unsettled] = [LETTER if 3 * i + 1 not in starts else NUMBER if 3 * i + 2 not in starts else OTHER for i in range(len(unsettled))]
    kinds[MARK] = END
    return kinds, unsettled[unsettled < MARK]


def unsettled_characters() -> np.ndarray:
    return _tables()[1]


def symbols(codes: np.ndarray) -> np.ndarray:
    """The splitter's symbols: character classes that already know the two characters that follow."""
    kinds = _tables()[0][codes]
    after = np.append(kinds[1:], END)
    out = kinds.copy()
    last = (kinds == SPACE) & (after != SPACE) & (after != END)
    out[last] = LONE
    out[last & (codes == 32)] = JOINED
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        padded = np.append(codes, [MARK, MARK])
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        out[quotes[np.logical_or.reduce(pairs)]] = LONG
    return out


def pretoken_starts(codes: np.ndarray) -> np.ndarray:
    """Places in ``codes`` where a pre-token begins; a ``MARK`` between texts is one of its own."""
    n = len(codes)
    lanes = -(-n // CHUNK_CHARS)
    grid = np.full(lanes * CHUNK_CHARS, END, np.uint8)
    grid[:n] = symbols(codes)
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK_CHARS).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for row in grid:
        maps = FOLLOW[maps, row[:, None]]
    step = 1
    while step < lanes:  # maps[i] becomes the map of all chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.full(lanes, FRESH, np.uint8)
    state[1:] = maps[:-1, FRESH]
    marks = np.empty(grid.shape, bool)
    for i, row in enumerate(grid):
        marks[i] = BEGINS[state, row]
        state = FOLLOW[state, row]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary file, by rule: visible Latin-1 characters
    stand for themselves, the other bytes follow from code point 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Transducer from the bytes of a pre-token to its number of BPE tokens.

    The tokens of a prefix end in a token t that begins at some place p, where t
    is the one token for which (last token of the prefix up to p, t) survives
    merging. A state therefore lists, for each place from which a longer token
    may still reach, the node of the vocabulary's trie reached since, the last
    token before that place, and how many tokens fewer there were.
    """

    NEVER = 1 << 60

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("byte_fallback") \
                or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: its two parts and the rank of their merge
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[left], ids[right]
            self.rank[a, b] = rank
            self.made.setdefault(ids[left + right], (a, b, rank))
        self.edges: dict[int, int] = {}
        self.token = [-1]
        for text, number in ids.items():
            if any(c not in alphabet for c in text) or (len(text) > 1 and number not in self.made):
                continue  # added words and words that no merge makes never come out of BPE
            node = 0
            for c in text:
                key = node << 8 | alphabet[c]
                node = self.edges.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = number
        self.inner = {key >> 8 for key in self.edges}
        self.sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.numbers = {start: 0}
        self.states = [start]
        self.moves: dict[int, int] = {}

    def _side(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte up to ``token``: (piece, rank of the merge that absorbs it)."""
        found = self.sides.get((token, side))
        if found is None:
            found = [(token, self.NEVER)]
            while found[-1][0] in self.made:
                parts = self.made[found[-1][0]]
                found.append((parts[side], parts[2]))
            found = self.sides[token, side] = found[::-1]
        return found

    def _survives(self, a: int, b: int) -> bool:
        """Whether no merge crosses the seam between the tokens ``a`` and ``b`` while both are built."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right, i, j, known = self._side(a, 1), self._side(b, 0), 0, 0, None
            while known is None:
                (x, x_until), (y, y_until) = left[i], right[j]
                rank = self.rank.get((x, y), self.NEVER)
                if rank < self.NEVER and rank < x_until and rank <= y_until:
                    known = False
                elif x_until == y_until == self.NEVER:
                    known = True
                elif x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """The transition as next state * 256 + change of the count + 128, made and kept."""
        reached, change, last = [], None, -1
        for node, before, fewer in self.states[state]:
            child = self.edges.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if change is None and token >= 0 and (before < 0 or self._survives(before, token)):
                change, last = fewer + 1, token
            if child in self.inner:
                reached.append((child, before, fewer))
        if change is None:
            raise ValueError(f"the tokenizer has no token for byte {byte}")
        made = (*((child, before, fewer - change) for child, before, fewer in reached), (0, last, 0))
        number = self.numbers.setdefault(made, len(self.states))
        if number == len(self.states):
            self.states.append(made)
        self.moves[state << 8 | byte] = move = number << 8 | change + 128
        return move

    def count(self, data: bytes) -> int:
        if len(self.states) > MAX_STATES or len(self.moves) > MAX_MOVES:
            self._reset()
        moves, state, total = self.moves, 0, 0
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                # A single endless pre-token must not grow the table either: its state lives on under number 1.
                if len(self.states) > 2 * MAX_STATES or len(moves) > 2 * MAX_MOVES:
                    kept = self.states[state]
                    self._reset()
                    moves = self.moves
                    state = self.numbers.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                move = self._move(state, byte)
            state = move >> 8
            total += (move & 255) - 128
        return total


class Memo(dict):
    """Counts of short pre-tokens that were met before; emptied when full."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        found = self.counter.count(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MAX_MEMO:
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def load(path: str) -> Memo:
    """The compiled machines of a tokenizer file, once for each Python worker."""
    return Memo(Counter(path))


def cut_long(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only before a blank between two visible characters,
    where a pre-token begins in any case."""
    at = 0
    while len(text) - at > size:
        found = regex.compile(r"(?<=[!-~]) (?=[!-~])").search(text, at + size)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def count_block(texts: list[str], memo: Memo) -> np.ndarray:
    """Numbers of tokens of texts without special strings, all at once."""
    joined = "\0".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    codes[ends[:-1]] = MARK
    starts = pretoken_starts(codes)
    pieces = [joined[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(joined)], strict=True)] if len(starts) else []
    marks = codes[starts] == MARK
    counts = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
    counts[marks] = 0
    return np.bincount(np.searchsorted(ends, starts), weights=counts, minlength=len(texts)).astype(np.int64)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of every text; special strings inside a text are one token each."""
    memo = load(path)
    special = regex.compile("|".join(map(regex.escape, sorted(memo.counter.special, key=len, reverse=True)))) if memo.counter.special else None
    totals = np.zeros(len(texts), np.int64)
    held, owners, size = [], [], 0

    def flush():
        nonlocal size
        if held:
            np.add.at(totals, owners, count_block(held, memo))
        held.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        parts = special.split(text) if special else [text]
        totals[i] += len(parts) - 1
        for part in parts:
            for piece in cut_long(part):
                if size + len(piece) > BLOCK_CHARS:
                    flush()
                if piece:
                    held.append(piece)
                    owners.append(i)
                    size += len(piece)
    flush()
    return totals


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more than ``max_tokens``).

    ``tokenizer`` is the path of a byte-level BPE file, present on every worker.
    Nothing is added at the ends of a text. A null text is the empty text with
    no tokens; null and repeated ids go through. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column(1).to_pylist(), tokenizer)
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))


def _run(spark, folder):
    import public_tokenizers
    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op3_token_counts": Query(_run)}
