"""Encoding of a whole corpus with a byte-level BPE vocabulary.

Texts of an Arrow batch are laid end to end as one array of code points, and each code point is
replaced by its class, which also tells what a look at the next ones shows: that white space ends, or that
letters may go with an apostrophe.  Where a piece begins is a question of automaton states.  Each class is a
transition function over the states; the functions are composed by an associative scan with doubled
steps, which ends as soon as all compositions are constant: after the few characters that an apostrophe
reaches.  No regular expression runs.  The pieces between the borders are merged
by the vocabulary's ranks, each distinct piece once as long as it stays in the cache.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary of the public tokenizer lies unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER = range(6)

#: White space by the Unicode property, but for the plain blank.
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Pieces longer than this are merged with a heap, in n log n steps; shorter ones by repeated search.
LONG_PIECE = 48
#: Distinct pieces kept in a worker's cache; it is emptied when full.
CACHE_PIECES = 400_000
#: Code points laid end to end at a time; a longer single text is taken alone.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import unicodedata

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    table[list(WHITE)] = SPACE
    table[ord(" ")] = BLANK
    table[ord("'")] = APOSTROPHE
    return table


#: Classes as the automaton reads them: a letter, one that may end after an apostrophe, one that may begin two such, ...
PLAIN, ENDING, PAIRED, DIGIT, SIGN, QUOTE, INNER_WHITE, LAST_BLANK, LAST_WHITE = range(9)
#: States: at a text's start, in a run of letters, numbers or signs, in white space, after a blank that goes with the next
#: piece, after an apostrophe that begins a piece, after what went with it, and amid the two letters that do.
START, IN_LETTERS, IN_DIGITS, IN_SIGNS, IN_WHITE, HELD_BLANK, AT_QUOTE, CLOSED, AMID = range(9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(state that follows, whether a piece begins) by class and state."""
    follows, begins = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    for state in range(9):
        for kind, run in ((PLAIN, IN_LETTERS), (ENDING, IN_LETTERS), (PAIRED, IN_LETTERS), (DIGIT, IN_DIGITS), (SIGN, IN_SIGNS), (QUOTE, IN_SIGNS)):
            follows[kind, state] = run
            begins[kind, state] = state not in (run, HELD_BLANK)
        if state not in (IN_SIGNS, HELD_BLANK, AT_QUOTE):
            follows[QUOTE, state] = AT_QUOTE
        follows[INNER_WHITE, state] = follows[LAST_WHITE, state] = IN_WHITE
        follows[LAST_BLANK, state] = HELD_BLANK
    begins[INNER_WHITE, IN_WHITE] = False
    begins[[SIGN, QUOTE], AT_QUOTE] = False
    follows[ENDING, AT_QUOTE], follows[PAIRED, AT_QUOTE] = CLOSED, AMID
    begins[[ENDING, PAIRED], AT_QUOTE] = False
    for kind in (PLAIN, ENDING, PAIRED):
        follows[kind, AMID], begins[kind, AMID] = CLOSED, False
    return follows, begins


FOLLOWS, BEGINS = _automaton()


def read_classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each code point as the automaton reads it; ``first`` marks those that begin a text."""
    kind = classes()[points]
    white = (kind == BLANK) | (kind == SPACE)
    read = np.array([PLAIN, DIGIT, LAST_BLANK, LAST_WHITE, QUOTE, SIGN], np.uint8)[kind]
    goes_on = np.append(~first[1:], False)  # the text has a next character
    after = np.append(points[1:], 0)
    read[white & (~goes_on | np.append(white[1:], True))] = INNER_WHITE
    read[(points == ord("s")) | (points == ord("t")) | (points == ord("m")) | (points == ord("d"))] = ENDING
    read[goes_on & ((((points == ord("r")) | (points == ord("v"))) & (after == ord("e"))) | ((points == ord("l")) & (after == ord("l"))))] = PAIRED
    return read


def borders(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a piece; ``first`` marks those that begin a text."""
    read = read_classes(points, first)
    reach = FOLLOWS[read]  # for each code point the state that follows, by the state before
    reach[first] = FOLLOWS[read[first], START][:, None]
    step = 1
    open_ones = np.flatnonzero((reach != reach[:, :1]).any(axis=1))
    while len(open_ones):  # never a text's first code point, whose function is constant
        reach[open_ones] = np.take_along_axis(reach[open_ones], reach[open_ones - step], axis=1)
        step *= 2
        open_ones = open_ones[(reach[open_ones] != reach[open_ones, :1]).any(axis=1)]
    state = np.empty(len(points), np.uint8)
    state[0] = START
    state[1:] = reach[:-1, 0]
    return BEGINS[read, state] | first


class Encoder:
    """Encodes texts by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in vocabulary.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: the pair of lowest rank is joined, the leftmost first, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_long(piece) if len(piece) > LONG_PIECE else self._merge_short(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        ranks, none = self.ranks, len(self.ranks)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            j = after[i] if left is not None else n
            if left is None or j >= n or len(left) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            joined = left + parts[j]
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + size))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty texts one after another, and how many each text has."""
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) for t in texts[:-1]], out=heads[1:])
        first = np.zeros(len(points), bool)
        first[heads] = True
        at = np.flatnonzero(borders(points, first))
        cuts = at.tolist()
        cuts.append(len(text))
        cache, merge = self.cache, self.merge
        found = []
        for a, b in zip(cuts, cuts[1:]):
            piece = text[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece.encode())
                if len(piece) <= LONG_PIECE:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        return ids, np.add.reduceat(sizes, np.searchsorted(at, heads))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts (from, to): their ids one after another, and how many each has; null and '' have none."""
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= BLOCK or i + 1 == len(texts):
                full = [k for k in range(start, i + 1) if texts[k]]
                counts = np.zeros(i + 1 - start, np.int64)
                ids = np.empty(0, np.int32)
                if full:
                    ids, own = self.encode_block([texts[k] for k in full])
                    counts[np.array(full) - start] = own
                yield start, i + 1, ids, counts
                start, held = i + 1, 0


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; it and its cache outlive a task."""
    key = hash(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def _broadcast(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # 50,000 tokens, under 1 MB
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``ids``, the token ids of each text, as array<int>.

    Null and empty texts have the empty array.  Strings of special tokens are ordinary text.  With
    ``offsets`` the column ``starts`` holds the byte of the text's UTF-8 form at which each id begins.
    A column of ``docs`` named ``ids`` or ``starts`` is replaced.  Whole texts are encoded, of any length.
    """
    shared = _broadcast(docs.sparkSession, vocabulary)
    kept = [c for c in docs.columns if c not in (text, "ids", "starts")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        lengths = None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            for a, b, ids, counts in encoder.encode(texts):
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
                if offsets:
                    if lengths is None:
                        lengths = np.zeros(max(encoder.ranks.values()) + 1, np.int64)
                        lengths[list(encoder.ranks.values())] = [len(t) for t in encoder.ranks]
                    reach = np.concatenate([[0], np.cumsum(lengths[ids])])
                    starts = reach[:-1] - np.repeat(reach[ends[:-1]], counts)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(starts.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", *["starts"] * offsets])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "ids array<int>", *["starts array<int>"] * offsets])
    return docs.select(*[docs[c] for c in kept], docs[text].alias("__text")).mapInArrow(mapped, schema)


def token_counts(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``n_tokens``; null and empty texts have none."""
    shared = _broadcast(docs.sparkSession, vocabulary)
    kept = [c for c in docs.columns if c not in (text, "n_tokens")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
            counts = [c for _, _, _, c in encoder.encode(texts)]
            if counts:
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(np.concatenate(counts))], names=[*kept, "n_tokens"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "n_tokens bigint"])
    return docs.select(*[docs[c] for c in kept], docs[text].alias("__text")).mapInArrow(mapped, schema)


def decode(ids: list[int], vocabulary: bytes) -> str:
    """The text of ids; the inverse of encoding."""
    tokens = {r: t for t, r in Encoder(vocabulary).ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
