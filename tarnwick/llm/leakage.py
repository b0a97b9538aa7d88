"""Held-out test items inside a training corpus, found by template canonicalisation.

Every word of a text becomes a typed token: numbers and units become placeholders, words that no item uses
outside its names become the placeholder of a name, other words stay. Windows of five tokens are looked up by
hash among the windows of the items, in the task that reads the text. For each pair of document and item that
shares windows at two or more places of the item, the sentences are then aligned and the slots checked.

A sentence is held where at least ``share`` of its words stand in order (its wording is kept), or where at least
``share`` of its words outside the slots do and its slots are filled with words of their own type, each filling
standing for one slot word and each slot word for one filling, over all sentences of a run (a re-parameterised
item). Fillings that break this one-to-one replacement do not count.

Folding of characters (lower case, accents, look-alike letters, invisible characters) and the windows run on
arrays of code points, whole texts at once; only candidates are aligned word by word. Notes and templates are
read twice, in their place and behind the text, whatever their length; the better reading counts.

Defined cases: null and empty texts and items match nothing; a document sent twice gives one row; a question at
the end of an item, or a last sentence that ends several items word for word, does not count; an item of a single
sentence leaks if that sentence does; windows shared by items give candidates for each of them; texts of any
length are read whole; which words are names does not depend on how the items are cut into blocks.
"""

from __future__ import annotations

import bisect
import html
import math
import re
import unicodedata
from collections.abc import Callable, Container, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import durable

WINDOW = 5
#: Items whose windows and sentences one pass over the corpus takes along; more items take more passes.
ITEM_BLOCK = 20_000
#: Distinct words of all items; beyond it the items are refused.
MOST_WORDS = 2_000_000
#: Share of slots in a sentence up to which it can be told from its other words alone.
SLOT_SHARE = 0.5
CHUNK_CHARS = 1_000_000
#: Items that a sentence ends before it counts as a closing.
REPEATS = 3
#: Look-alike letters of other scripts and the Latin letters they stand for.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнАВЕКМНОРСТУХІЈЅοανρικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhabekmhopctyxijsoavpiktuabezhikmnoptyx"))
#: Characters that are not seen.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Units of measure, unless others are given.
UNITS = "mm cm km metres meters kilometres kilometers grams kilograms kg litres liters percent years weeks days hours minutes".split()
_NUMBER, _UNIT, _NAME = 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold(char: str) -> str:
    """Lower-case Latin look-alike without accents; empty for invisible characters and marks, blank for others."""
    if char in INVISIBLE or unicodedata.combining(char):
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    base = unicodedata.normalize("NFKD", char)[0].lower()[:1]
    return LOOKALIKES.get(base, base) if base.isalnum() else " "


@cache
def _fold_table() -> np.ndarray:
    """Folded code of every code point that has one of its own; other planes stay as they are."""
    table = np.arange(0x110000, dtype=np.uint32)
    for low, high in ((0, 0x3100), (0xFE00, 0x10000), (0x1D400, 0x1D800)):
        for code in range(low, high):
            folded = _fold(chr(code))
            table[code] = ord(folded) if folded else 0
    return table


def _mix(sums: np.ndarray) -> np.ndarray:
    sums = (sums ^ (sums >> np.uint64(31))) * _BASE
    return sums ^ (sums >> np.uint64(29))


def _word_marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, whether it starts with a digit, text of each word) of several texts."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    folded = _fold_table()[codes]
    kept = np.flatnonzero(folded)
    folded = folded[kept]
    inside = folded != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(folded) + 1, _BASE, np.uint64))
        inverse = np.cumprod(np.full(len(folded) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
        sums = np.append(np.uint64(0), np.cumsum(folded.astype(np.uint64) * powers[: len(folded)]))
        marks = _mix((sums[stops] - sums[starts]) * inverse[starts] if len(starts) else np.zeros(0, np.uint64))
    digit = (folded[starts] >= 48) & (folded[starts] <= 57)
    return marks, digit, np.searchsorted(bounds, kept[starts], side="right") - 1


def _tokens(marks: np.ndarray, digit: np.ndarray, known: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Typed token of each word: its hash if ``known`` (sorted) holds it, else a placeholder."""
    at = np.minimum(np.searchsorted(known, marks), max(0, len(known) - 1))
    tokens = np.where(known[at] == marks, marks, np.uint64(_NAME)) if len(known) else np.full(len(marks), _NAME, np.uint64)
    tokens = np.where(np.isin(marks, units), np.uint64(_UNIT), tokens)
    return np.where(digit, np.uint64(_NUMBER), tokens)


def _windows(tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows inside one text with at most one name placeholder."""
    n = len(tokens) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    named = np.append(0, np.cumsum(tokens == _NAME))
    start = np.flatnonzero((named[WINDOW:] - named[:-WINDOW] <= 1) & (text[WINDOW - 1 :] == text[:n]))
    with np.errstate(over="ignore"):
        found = np.zeros(len(start), np.uint64)
        for k in range(WINDOW):
            found = _mix(found + tokens[start + k]) * _BASE
    return start, found


def _folded(text: str) -> list[str]:
    return "".join(map(_fold_cached, text)).split()


def readings(text: str) -> list[list[str]]:
    """Folded words of a text without markup, words cut at a line's end joined, in one reading or two.

    Notes and templates keep their content where they stand in the first reading; in the second it follows the text.
    """
    text = re.sub(r"<ref[^<>]*/>", " ", html.unescape(text))
    open_at: dict[str, list[int]] = {"{": [], "<": []}
    spans: list[tuple[int, int]] = []
    for mark in re.finditer(r"\{\{|\}\}|<ref[^<>]*>|</ref>", text):
        begins = open_at["{" if mark[0][0] in "{}" else "<"]
        if mark[0] not in ("}}", "</ref>"):
            begins.append(mark.start())
        elif begins:
            begin = begins.pop()
            # What lies inside goes along with it.
            while spans and spans[-1][0] >= begin:
                spans.pop()
            spans.append((begin, mark.end()))
    edges = [0, *[at for span in spans for at in span], len(text)]
    apart = " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    parts = [text[a:b] for a, b in spans]

    def words(part: str) -> list[str]:
        part = re.sub(r"</?[A-Za-z][^<>]*>", " ", part)
        part = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", part)
        return _folded(re.sub(r"[-‐]\s*\r?\n\s*(?=\w)", "", part))

    return [words(text), words("\n\n".join([apart, *parts]))] if parts else [words(text)]


def plain_words(text: str) -> list[str]:
    """Folded words of a text without markup, notes and templates in their place."""
    return readings(text)[0]


_fold_cached = cache(_fold)


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def passages(text: str, closings: Container[str] = ()) -> list[str]:
    """Sentences of an item without a question, or one of the ``closings``, at its end."""
    found = sentences_of(text)
    return found[:-1] if len(found) > 1 and (found[-1].endswith("?") or found[-1] in closings) else found


def closings_of(items: DataFrame, item_text: str) -> DataFrame:
    """(closing): last sentences that end ``REPEATS`` or more items word for word, each behind another sentence."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [s[-2:] for s in map(sentences_of, batch["text"]) if len(s) > 1]
            yield pd.DataFrame(ends, columns=["before", "closing"])

    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_text).alias("text"))
    ends = rows.mapInPandas(run, "before string, closing string")
    return ends.groupBy("closing").agg(F.count_distinct("before").alias("n")).where(F.col("n") >= REPEATS).select("closing")


def item_passages(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, sentences): each item's sentences without what only asks about them at its end."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [passages(t, {c} if c is not None else ()) for t, c in zip(batch["text"], batch["closing"])]
            yield pd.DataFrame({"item": batch["item"], "sentences": told})

    def last(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (sentences_of(t) or [""])[-1])

    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    ended = rows.withColumn("last", F.pandas_udf(last, "string")("text"))
    both = ended.join(closings_of(items, item_text), F.col("last") == F.col("closing"), "left")
    return both.select("item", "text", "closing").mapInPandas(run, "item long, sentences array<string>")


def item_names(sentences: Iterable[str]) -> set[str]:
    """Folded words that an item capitalises inside a sentence."""
    inner = [w for s in sentences for w in s.split()[1:] if w[:1].isupper()]
    return {f for w in inner for f in plain_words(w)}


def _same(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) > 3 and abs(len(a) - len(b)) <= 2 and (a.startswith(b) or b.startswith(a)))


def _hits(wanted: list[Container[str]], part: list[str]) -> list[tuple[int, int]]:
    """Aligned places of the longest common subsequence: the earliest end and from there the latest start.

    ``wanted`` holds, for each word of a sentence, the words that count as it.
    """
    size = [[0] * (len(part) + 1)]
    for accepted in wanted:
        above, row, left = size[-1], [0], 0
        for j, other in enumerate(part):
            left = above[j] + 1 if other in accepted else left if left > above[j + 1] else above[j + 1]
            row.append(left)
        size.append(row)
    i, j = len(wanted), size[-1].index(size[-1][-1])
    hits = []
    while i and j:
        if part[j - 1] in wanted[i - 1] and size[i][j] == size[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            hits.append((i, j))
        elif size[i - 1][j] >= size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return hits[::-1]


def _like(places: dict[str, list[int]]) -> dict[str, list[str]]:
    """The words of a document by themselves and by their beginnings that ``_same`` may take for them."""
    found: dict[str, list[str]] = {}
    for word in places:
        for short in {word, word[:-1], word[:-2]} if len(word) > 3 else {word}:
            if short == word or len(short) > 3:
                found.setdefault(short, []).append(word)
    return found


def _placements(sentence: list[str], places: dict[str, list[int]], counted: Callable[[str], Iterable[str]], share: float) -> list[tuple[int, int, float]]:
    """(first, last, share), ordered, of every stretch of the document that holds at least ``share`` of the sentence in order.

    Each word that may begin a stretch is tried; for each number of words found, the earliest end is kept and the
    latest start for that end.
    """
    need = max(1, math.ceil(share * len(sentence) - 1e-9))
    at: dict[int, int] = {}
    own: list[np.ndarray] = []
    for k, word in enumerate(sentence):
        spots = [p for other in counted(word) for p in places[other]]
        own.append(np.sort(np.array(spots, np.int64)))
        for p in spots:
            at[p] = at.get(p, 0) | 1 << k
    early = [spots for spots in own[: len(sentence) - need + 1] if len(spots)]
    if not early:
        return []
    if sum(map(bool, map(len, own))) < need:
        return []
    start, reach = np.unique(np.concatenate(early)), len(sentence) + 20
    held = sum((np.searchsorted(spots, start + reach) > np.searchsorted(spots, start)).astype(np.int64) for spots in own)
    full, every = (1 << len(sentence)) - 1, np.array(sorted(at), np.int64)
    latest: dict[tuple[int, int], int] = {}
    for first in start[held >= need].tolist():
        row, best = full, need - 1
        low, high = np.searchsorted(every, (first, first + reach)).tolist()
        for p in every[low:high].tolist():
            # Longest common subsequence by bits: a zero for each word found up to here.
            hit = row & at[p]
            row = ((row + hit) | (row - hit)) & full
            if (got := len(sentence) - row.bit_count()) > best:
                best = got
                latest[p, got] = first
    return sorted((first, last, got / len(sentence)) for (last, got), first in latest.items())


class Sentence:
    """Folded words of a sentence of an item, with the type of each slot (0 for other words)."""

    def __init__(self, text: str, kind: Callable[[str], int]) -> None:
        self.words = plain_words(text)
        self.kinds = [kind(w) for w in self.words]
        self.fixed = [k for k, slot in enumerate(self.kinds) if not slot]
        self.templated = len(self.fixed) < len(self.words) and len(self.words) - len(self.fixed) <= SLOT_SHARE * len(self.words)


def _one_to_one(pairs: Iterable[tuple[str, str]]) -> dict[str, str] | None:
    """The replacement that all ``pairs`` make together; null if a word is replaced by two or two by one."""
    told: dict[str, str] = {}
    for word, other in pairs:
        if told.setdefault(word, other) != other:
            return None
    return told if len(set(told.values())) == len(told) else None


class Document:
    """Words of one reading of a document, with the places of each."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.places = words, {}
        for p, word in enumerate(words):
            self.places.setdefault(word, []).append(p)
        self.like = _like(self.places)
        self.accepted: dict[str, frozenset[str]] = {}

    def counted(self, word: str) -> frozenset[str]:
        """The words of the document that count as ``word``."""
        if word not in self.accepted:
            shorts = [short for short in (word[:-1], word[:-2]) if len(short) > 3 and short in self.places]
            self.accepted[word] = frozenset([*self.like.get(word, ()), *shorts])
        return self.accepted[word]

    def fillings(self, sentence: Sentence, first: int, last: int, kind: Callable[[str], int]) -> tuple[int, list[tuple[str, str]]]:
        """(other words found, (slot word, word in its place)) of a sentence in a stretch of the document."""
        edge = len(sentence.words) - len(sentence.fixed)
        part = self.words[max(0, first - edge) : last + 1 + edge]
        at = [(sentence.fixed[a], b) for a, b in _hits([self.counted(sentence.words[k]) for k in sentence.fixed], part)]
        filled = []
        for (a, b), (c, d) in zip([(-1, -1), *at], [*at, (len(sentence.words), len(part))]):
            gap = iter(part[b + 1 : d])
            for k in range(a + 1, c):
                if sentence.kinds[k] and (word := next((w for w in gap if kind(w) == sentence.kinds[k]), None)) is not None:
                    filled.append((sentence.words[k], word))
        return len(at), filled

    def templates(self, sentence: Sentence, share: float, kind: Callable[[str], int]) -> list[tuple[int, int, float, dict[str, str]]]:
        """(first, last, share, replacement) of the stretches that hold a sentence with its slots filled one to one."""
        if not sentence.templated:
            return []
        widest: dict[int, tuple[float, int]] = {}
        for first, last, got in _placements([sentence.words[k] for k in sentence.fixed], self.places, self.counted, share):
            widest[first] = max(widest.get(first, (0.0, 0)), (got, last))
        found = []
        for first, (_, last) in sorted(widest.items()):
            kept, filled = self.fillings(sentence, first, last, kind)
            told = _one_to_one(filled)
            got = (kept + len(filled)) / len(sentence.words)
            if told is not None and got >= share and kept >= share * len(sentence.fixed):
                found.append((first, last, got, told))
        return found

    def replacement(self, sentence: Sentence, first: int, last: int, kind: Callable[[str], int]) -> dict[str, str] | None:
        """The one-to-one replacement of the slots of a sentence in a stretch, null if there is none."""
        return _one_to_one(self.fillings(sentence, first, last, kind)[1])

    def longest(self, sentences: list[Sentence], found: list[list[tuple[int, int, float, dict[str, str]]]]) -> tuple[tuple[int, float], list[tuple[int, int]]]:
        """((sentences, lowest share), (sentence, spot) of each) of the longest run whose replacements fit together."""
        runs: list[list[tuple[int, float, int, dict[str, str]]]] = []
        best, end = (0, 0.0), (0, -1)
        for k, spots in enumerate(found):
            before, ranked = found[k - 1] if k else [], []
            for n, (first, last, got, own) in enumerate(spots):
                run = (1, got, -1, own)
                # A sentence reaches over its words and 20 more, the next one starts at most 12 behind its end.
                for m in range(bisect.bisect_left(before, (first - len(sentences[k - 1].words) - 32,)), bisect.bisect_left(before, (first,))):
                    length, low, _, told = runs[-1][m]
                    if first <= before[m][1] + 12 and before[m][1] < last and (length + 1, min(got, low)) > run[:2]:
                        both = _one_to_one([*told.items(), *own.items()]) if told and own else told or own
                        if both is not None:
                            run = (length + 1, min(got, low), m, both)
                ranked.append(run)
                if run[:2] > best:
                    best, end = run[:2], (k, n)
            runs.append(ranked)
        chosen, (k, n) = [], end
        while n >= 0:
            chosen.append((k, n))
            k, n = k - 1, runs[k][n][2]
        return best, chosen[::-1]

    def judge(self, sentences: list[Sentence], share: float, kind: Callable[[str], int]) -> tuple[int, float, int, int]:
        """(sentences found on end, their lowest share, slots filled anew, replacements that are not one to one).

        The longest run over all places of the sentences counts, of equally long ones the one with the highest share.
        """
        kept = [[(*spot, {}) for spot in _placements(s.words, self.places, self.counted, share)] if s.words else [] for s in sentences]
        best, chosen = self.longest(sentences, kept)
        found = kept
        if best[0] < len(sentences) and any(filled := [self.templates(s, share, kind) for s in sentences]):
            # Beside a filled template the slots of kept wording must fit too.
            both = []
            for s, own, more in zip(sentences, kept, filled):
                fits = [(first, last, got, one) for first, last, got, _ in own if (one := self.replacement(s, first, last, kind)) is not None]
                both.append(sorted([*fits, *more], key=lambda spot: spot[:3]))
            if (wider := self.longest(sentences, both))[0][0] > best[0]:
                (best, chosen), found = wider, both
        told: dict[str, set[str]] = {}
        back: dict[str, set[str]] = {}
        for k, n in chosen:
            first, last = found[k][n][:2]
            for word, other in self.fillings(sentences[k], first, last, kind)[1]:
                told.setdefault(word, set()).add(other)
                back.setdefault(other, set()).add(word)
        changed = sum(word not in others for word, others in told.items())
        return *best, changed, sum(len(o) > 1 for o in told.values()) + sum(len(w) > 1 for w in back.values())


def judge(item: list[str], words: list[str], share: float, names: Container[str] = ()) -> tuple[int, float, int, int]:
    """``Document.judge`` of the sentences of one item in the words of a document; ``names`` are the words of names."""
    kind = _kinds(set(names).__contains__, UNITS)
    return Document(words).judge([Sentence(s, kind) for s in item], share, kind)


def _kinds(is_name: Callable[[str], bool], units: Iterable[str]) -> Callable[[str], int]:
    """The type of a folded word: number, unit, name, or 0 for a word of its own."""
    of_unit = set(units)
    return lambda w: _NUMBER if "0" <= w[0] <= "9" else _UNIT if w in of_unit else _NAME if is_name(w) else 0


def vocabulary(told: DataFrame) -> list[str]:
    """Folded words that any item uses outside of names: one bounded list for all items."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict[tuple[str, bool], None] = {}
            for sentences in batch["sentences"]:
                rows |= dict.fromkeys((w, False) for s in sentences for w in _folded(s)) | dict.fromkeys((w, True) for w in item_names(sentences))
            yield pd.DataFrame(list(rows), columns=["word", "named"])

    words = told.select("sentences").mapInPandas(run, "word string, named boolean").groupBy("word").agg(F.max("named").alias("named")).where("not named")
    known = words.select("word").limit(MOST_WORDS + 1).toPandas()["word"].tolist()
    if len(known) > MOST_WORDS:
        raise ValueError(f"the items use more than {MOST_WORDS} words")
    return known


class Side:
    """Windows and sentences of one bounded block of items, as a task needs them."""

    def __init__(self, rows: pd.DataFrame, known: list[str], units: tuple[str, ...]) -> None:
        self.items = rows["item"].to_numpy(np.int64)
        self.texts = [list(s) for s in rows["sentences"]]
        self.known, self.units = known, units
        self.known_marks = np.unique(_word_marks(known)[0]) if known else np.zeros(0, np.uint64)
        self.unit_marks = _word_marks(list(units))[0] if units else np.zeros(0, np.uint64)
        marks, digit, text_of = _word_marks(["\n".join(s) for s in self.texts]) if self.texts else (np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, int))
        start, codes = _windows(_tokens(marks, digit, self.known_marks, self.unit_marks), text_of)
        order = np.argsort(codes, kind="stable")
        self.codes, self.place, self.owner = codes[order], start[order], text_of[start][order]

    def pairs(self, texts: list[str]) -> dict[int, list[int]]:
        """Positions of the items of which each text (by its position) shares windows at two or more places."""
        marks, digit, text_of = _word_marks(texts)
        start, codes = _windows(_tokens(marks, digit, self.known_marks, self.unit_marks), text_of)
        low, high = np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, side="right")
        count = high - low
        hit = np.flatnonzero(count)
        if not len(hit):
            return {}
        count = count[hit]
        upto = np.cumsum(count)
        at = np.arange(upto[-1]) - np.repeat(upto - count, count) + np.repeat(low[hit], count)
        met = np.unique(np.stack([np.repeat(text_of[start[hit]], count), self.owner[at], self.place[at]], axis=1), axis=0)
        first = np.flatnonzero(np.append(True, (met[1:, :2] != met[:-1, :2]).any(axis=1)))
        found: dict[int, list[int]] = {}
        for text, owner in met[first[np.diff(np.append(first, len(met))) >= 2], :2].tolist():
            found.setdefault(text, []).append(owner)
        return found


def leaks(docs: DataFrame, id_column: str, text_column: str, items: DataFrame, item_id: str, item_text: str, share: float = 0.75, units: Iterable[str] = UNITS) -> DataFrame:
    """(id, item, of, sentences, share, changed, inconsistent) of each pair that shares template windows.

    ``sentences`` counts the item's sentences held on end, by their wording or as a template with its slots
    filled one to one; ``changed`` counts slot words of that run that were replaced, ``inconsistent`` those
    replaced in more than one way or by a word that also stands for another.
    """
    spark = docs.sparkSession
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    told = durable(item_passages(items, item_id, item_text))
    known = vocabulary(told)
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text")).where("id is not null and text is not null")
    found = []
    for block in range(blocks):
        own = told.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Side(own.toPandas(), known, tuple(units)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            side = shared.value
            kind = _kinds(lambda w, known=set(side.known): w not in known, side.units)
            parsed: dict[int, list[Sentence]] = {}
            for batch in batches:
                rows, texts, begin = [], batch.column(1).to_pylist(), 0
                while begin < len(texts):
                    stop, size = begin, 0
                    while stop < len(texts) and (stop == begin or size < CHUNK_CHARS):
                        size += len(texts[stop])
                        stop += 1
                    for k, owners in side.pairs(texts[begin:stop]).items():
                        read = list(map(Document, readings(texts[begin + k])))
                        for owner in owners:
                            if owner not in parsed:
                                parsed[owner] = [Sentence(s, kind) for s in side.texts[owner]]
                            # The longest run of all readings; of equal ones the one with the fewest changes.
                            best = max((d.judge(parsed[owner], share, kind) for d in read), key=lambda j: (j[0], j[1], -j[2], -j[3]))
                            rows.append((batch.column(0)[begin + k].as_py(), int(side.items[owner]), len(parsed[owner]), *best))
                    begin = stop
                lists = [list(column) for column in zip(*rows)] if rows else [[] for _ in _LEAK]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(lists, _LEAK.values())], list(_LEAK))

        found.append(plain.mapInArrow(run, "id long, item long, of int, sentences int, share double, changed int, inconsistent int"))
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("id", "item").agg(F.max(F.struct("sentences", "share", "of", "changed", "inconsistent")).alias("best"))
    return best.select("id", "item", "best.of", "best.sentences", "best.share", "best.changed", "best.inconsistent")


_LEAK = {"id": pa.int64(), "item": pa.int64(), "of": pa.int32(), "sentences": pa.int32(), "share": pa.float64(), "changed": pa.int32(), "inconsistent": pa.int32()}
