"""Encoding of a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation uses no regex. A chunk of texts becomes one array of code points, each mapped to a class that
already holds its look-ahead (a blank before a word, an apostrophe before ``re`` and so on). Each class is a
transition function on the states of a small automaton; the functions are composed by an associative scan
(doubling steps over a table of the finite monoid) until every prefix is a constant function, and state and
class of each character tell whether a piece starts there. Pieces of a chunk are told apart by a hash and every
piece is then compared, code point by code point, with the one that stands for its hash; what differs is told
apart by its text. Distinct pieces are merged once, through a bounded cache kept by each Python worker, and the
ids are gathered back for all pieces at once. The start of each id's piece is kept for decoding.

Defined cases: null and empty texts give an empty list; strings that look like control tokens are plain text;
texts of any length are encoded whole; lone surrogates cannot occur in Spark strings. The vocabulary file (one
base64 token and its rank a line) is read where the driver runs or from a shared store, and shipped to the
executors.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1_000_000
#: Merged pieces that a worker remembers, and the longest of them; beyond that it starts anew, with the same ids.
CACHE_PIECES, CACHE_LETTERS = 200_000, 64

# Classes of characters: letter, number, other, apostrophe before one / two contraction letters, white space
# inside a run, blank that joins the next piece, last white space of a run that joins nothing, end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, BREAK, END = range(9)
# States: inside letters, numbers, other, white space; after a joining blank; one / two contraction letters due;
# nothing open.
_IN_L, _IN_N, _IN_O, _IN_S, _JOIN, _DUE1, _DUE2, _FREE = range(8)
# White space of the Unicode property White_Space, the contraction letters.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ONE = "stmd"
_TWO = ("re", "ve", "ll")


@cache
def _code_classes() -> np.ndarray:
    """Class of every code point without look-ahead."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            kinds[code] = LETTER
        elif major == "N":
            kinds[code] = NUMBER
    kinds[_WHITE] = SPACE
    return kinds


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state and whether a piece starts at a character of class ``kind``."""
    run = {LETTER: _IN_L, NUMBER: _IN_N, OTHER: _IN_O, SHORT: _IN_O, LONG: _IN_O, SPACE: _IN_S}
    if kind == LETTER and state in (_DUE1, _DUE2):
        return (_FREE if state == _DUE1 else _DUE1), False
    if kind in (BLANK, BREAK, END):
        return (_JOIN if kind == BLANK else _FREE), True
    if state == run[kind] or (state == _JOIN and kind != SPACE):
        return run[kind], False
    return {SHORT: _DUE1, LONG: _DUE2}.get(kind, run[kind]), True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id of each class, composition table, value at the free state of each function, starts[state, class])."""
    functions = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    known = {f: None for f in functions}
    frontier = list(known)
    while frontier:
        fresh = []
        for f in list(known):
            for g in frontier:
                for h in (tuple(g[f[s]] for s in range(8)), tuple(f[g[s]] for s in range(8))):
                    if h not in known:
                        known[h] = None
                        fresh.append(h)
        frontier = fresh
    ids = {f: i for i, f in enumerate(known)}
    table = np.array([[ids[tuple(g[f[s]] for s in range(8))] for g in known] for f in known], np.uint16)
    at_free = np.array([f[_FREE] for f in known], np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return np.array([ids[f] for f in functions], np.uint16), table, at_free, starts


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where a piece starts; ``ends`` are positions of separators between texts, each a piece of its own."""
    kinds = _code_classes()[codes]
    kinds[ends] = END
    after = np.append(kinds[1:], END)
    last = (kinds == SPACE) & (after != SPACE) & (after != END)
    letters = np.append(codes[1:], [0, 0])
    one = np.isin(letters[:-1], [ord(c) for c in _ONE])
    two = np.zeros(len(codes), bool)
    mark = np.flatnonzero((codes == ord("'")) & (kinds == OTHER))
    for pair in _TWO:
        two[mark] |= (letters[mark] == ord(pair[0])) & (letters[mark + 1] == ord(pair[1]))
    two[mark] &= after[mark] == LETTER
    kinds[last] = np.where(codes[last] == 0x20, BLANK, BREAK)
    kinds[mark] = np.where(two[mark], LONG, np.where(one[mark] & (after[mark] == LETTER), SHORT, OTHER))
    of_class, table, at_free, starts = _monoid()
    prefix = of_class[kinds]
    constant = np.array([len(set(table[:, f])) == 1 for f in range(len(table))])
    shift = 1
    while shift < len(prefix) and not constant[prefix[shift:]].all():
        joined = prefix.copy()
        joined[shift:] = table[prefix[:-shift], prefix[shift:]]
        prefix, shift = joined, shift * 2
    before = np.append(np.uint8(_FREE), at_free[prefix[:-1]])
    return np.flatnonzero(starts[before, kinds])


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbouring pair of lowest rank merges first, the leftmost on a tie."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes chunks of texts; one is kept by each Python worker and holds the cache of merged pieces."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str) -> None:
        self.ranks, self.cache = _ranks(path), {}
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = np.uint64(pow(int(self._BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(n, self._BASE, np.uint64))
                self.inverse = np.cumprod(np.full(n, inverse, np.uint64))

    def _ids(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = merge_piece(piece.encode(), self.ranks)
            if len(piece) <= CACHE_LETTERS:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    @staticmethod
    def _unlike(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Pieces whose code points are not those of the piece ``like`` names for them."""
        sizes = stops - starts
        same = sizes == sizes[like]
        checked = np.flatnonzero(same & (like != np.arange(len(like))))
        if len(checked):
            size = sizes[checked]
            begin = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(begin, size)
            equal = codes[np.repeat(starts[checked], size) + inside] == codes[np.repeat(starts[like[checked]], size) + inside]
            same[checked] = np.minimum.reduceat(equal, begin)
        return np.flatnonzero(~same)

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts on end, offsets of the texts in them, start of each id's piece as a character of its text)."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = piece_starts(codes, ends)
        stops = np.append(starts[1:], len(codes))
        self._grow(len(codes))
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(codes)]))
            marks = (sums[stops] - sums[starts]) * self.inverse[starts]
        is_end = np.zeros(len(codes), bool)
        is_end[ends] = True
        real = ~is_end[starts]
        starts, stops, marks = starts[real], stops[real], marks[real]
        _, first, which = np.unique(marks, return_index=True, return_inverse=True)
        odd = self._unlike(codes, starts, stops, first[which])
        merged = [self._ids(joined[a:b]) for a, b in zip(starts[first].tolist(), stops[first].tolist())]
        for at in odd.tolist():
            which[at] = len(merged)
            merged.append(self._ids(joined[starts[at] : stops[at]]))
        size = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter((x for ids in merged for x in ids), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        counts = size[which]
        upto = np.append(0, np.cumsum(counts))
        gather = np.arange(upto[-1]) + np.repeat(begin[which] - upto[:-1], counts)
        offsets = upto[np.searchsorted(starts, np.append(0, ends + 1))]
        text_start = np.append(0, ends + 1)[np.searchsorted(ends, starts)]
        return flat[gather], offsets, np.repeat(starts - text_start, counts)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _shipped(df: DataFrame, path: str) -> str:
    """Ships the file at ``path`` to all executors; the name under which a task finds it."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(df: DataFrame, id_column: str, text_column: str, path: str, offsets: bool = False) -> DataFrame:
    """(id, ids): the ids of each text; with ``offsets`` also ``starts``, the character where each id's piece starts."""
    name = _shipped(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(SparkFiles.get(name))
        for batch in batches:
            done = 0
            for texts in _chunks(batch.column(1).to_pylist()):
                ids, upto, starts = encoder.chunk(texts)
                lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(v, pa.int32())) for v in ([ids, starts] if offsets else [ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *lists], ["key", "ids", "starts"][: 1 + len(lists)])
                done += len(texts)

    key = df.schema[id_column].dataType.simpleString()
    coded = df.select(F.col(f"`{id_column}`").alias("key"), F.col(f"`{text_column}`").alias("text")).mapInArrow(run, f"key {key}, ids array<int>" + ", starts array<int>" * offsets)
    return coded.withColumnRenamed("key", id_column)


def decode(df: DataFrame, id_column: str, ids_column: str, path: str, starts_column: str | None = None) -> DataFrame:
    """(id, text): the text of each list of ids, the exact inverse of ``encode``; null gives the empty text.

    With ``starts_column`` the ids of each piece are decoded by themselves, and ``placed`` tells whether every
    piece begins at the character its offset names.
    """
    name = _shipped(df, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(SparkFiles.get(name))
        for batch in batches:
            lists = batch.column(1).to_pylist()
            if starts_column is None:
                texts = [b"".join(map(tokens.__getitem__, ids or [])).decode() for ids in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])
                continue
            texts, placed = [], []
            for ids, starts in zip(lists, batch.column(2).to_pylist()):
                pieces, right, size = [], True, 0
                for start, own in itertools.groupby(zip(starts or [], ids or []), key=lambda p: p[0]):
                    pieces.append(b"".join(tokens[i] for _, i in own).decode())
                    right &= start == size
                    size += len(pieces[-1])
                texts.append("".join(pieces))
                placed.append(right)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(placed)], ["key", "text", "placed"])

    key = df.schema[id_column].dataType.simpleString()
    columns = [F.col(f"`{id_column}`").alias("key"), F.col(f"`{ids_column}`").alias("ids")] + ([F.col(f"`{starts_column}`").alias("starts")] if starts_column else [])
    plain = df.select(*columns).mapInArrow(run, f"key {key}, text string" + ", placed boolean" * bool(starts_column))
    return plain.withColumnRenamed("key", id_column)
