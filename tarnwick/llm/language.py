"""Languages of documents and of their mixed segments by prediction by partial matching.

For each language a context tree over bytes is fitted on a bounded sample of labelled documents: at every order
up to ``ORDER`` the counts of the bytes after each context, with escape probabilities (method C) to the next
lower order. The statistics are then frozen, and the exact code length of a text is a sum of table look-ups: the
lengths of all known context-byte pairs are laid out in sorted tables, for all languages at once. Each sentence
takes its code lengths, and the running text of a document, over all its paragraphs, is cut into segments by the
shortest total code with a price for each change of language; letters count in lower case, so that words in capitals
have the statistics of their language. What a template holds follows as a text of its own.

Defined cases: null, empty and blank texts have no segments, nor have texts without running text; sentences that
no language codes below ``NOISE`` bits a byte are noise; a segment needs two sentences on end, whatever their
length; a single word with a full stop (an initial, an abbreviation) belongs to the sentence behind it; equal code
lengths go to the first language in the alphabet; documents sent twice give one row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = 3
NOISE = 4.2
CHANGE = 25.0
#: Paragraphs whose code lengths a worker remembers; beyond it starts anew, with the same result.
CACHE_BLOCKS = 100_000
#: Two-letter codes and the three-letter codes of the same languages.
CODES = {"en": ["eng"], "de": ["deu", "ger"], "fr": ["fra", "fre"], "es": ["spa"], "it": ["ita"], "pt": ["por"], "nl": ["nld", "dut"], "sv": ["swe"], "pl": ["pol"], "ru": ["rus"]}


def label_code(label: Column) -> Column:
    """Two-letter code that a label in any notation names; null if it says nothing."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    pairs = [F.lit(x) for two, threes in CODES.items() for known in (two, *threes) for x in (known, two)]
    return F.try_element_at(F.create_map(*pairs), head)


def _sentences(text: str) -> list[str]:
    """Sentences of a paragraph: two words or more; a single word belongs to the next sentence, signs without a word are none."""
    found, begun = [], ""
    for piece in re.split(r"(?<=[.!?…])[\"'»”)\]]*\s+", text.strip()):
        words = len(re.findall(r"[^\W\d_]+", piece))
        piece = f"{begun} {piece}" if begun else piece
        alone = words == 1 and not begun
        begun = piece if alone else ""
        if words and not alone and piece[-1] in ".!?…":
            found.append(piece)
    return found


def _outside(text: str, begin: str, end: str) -> tuple[str, list[str]]:
    """(text without what stands between the marks, contents of the outermost of these stretches)."""
    open_at: list[int] = []
    spans: list[tuple[int, int]] = []
    for mark in re.finditer(f"{begin}|{end}", text):
        if re.fullmatch(begin, mark[0]):
            open_at.append(mark.start())
        elif open_at:
            start = open_at.pop()
            while spans and spans[-1][0] >= start:
                spans.pop()
            spans.append((start, mark.end()))
    edges = [0, *[at for span in spans for at in span], len(text)]
    return " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), [text[a:b] for a, b in spans]


def paragraphs(text: str) -> list[list[str]]:
    """Paragraphs of the text of a document and of each of its templates, without markup, tables, headings, references."""
    text = html.unescape(text).replace("\r", "")
    asides: list[str] = []
    if "<" in text:
        text, _ = _outside(re.sub(r"<ref[^<>]*/>", " ", text), r"<ref[^<>]*>", r"</ref>")
        text, _ = _outside(text, r"<!--", r"-->")
        text = re.sub(r"</?[A-Za-z][^<>]*>", " ", text)
    if "{{" in text:
        text, inside = _outside(text, r"\{\{", r"\}\}")
        # The values of a template stand on lines of their own.
        asides = ["\n\n".join(v.partition("=")[2] or v for v in re.split(r"[{}|]+", part)) for part in inside]
    return [p for p in map(_paragraphs, [text, *asides]) if p]


def _paragraphs(text: str) -> list[str]:
    if "[[" in text:
        text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", lambda m: " " if ":" in m[1] else m[1], text)
    found, open_lines = [], []
    for line in [*re.sub(r"'{2,}", "", text).split("\n"), ""]:
        line = line.strip()
        if line and line[0] not in "|!={}#*":
            open_lines.append(line)
            continue
        if open_lines:
            found.append(" ".join(open_lines))
            open_lines = []
        if line[:1] == "*":
            found.append(line.lstrip("* "))
    return found


def running_text(text: str) -> list[str]:
    """All sentences of a text, paragraph by paragraph."""
    return [s for part in paragraphs(text) for p in part for s in _sentences(p)]


class Ppm:
    """Frozen context trees of several languages as sorted tables of code lengths."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.languages = sorted(texts)
        n = len(self.languages)
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = None
        for order in range(ORDER + 1):
            grams = [self.grams(np.frombuffer(texts[lang], np.uint8), order) for lang in self.languages]
            counted = [np.unique(g, return_counts=True) for g in grams]
            keys = np.unique(np.concatenate([k for k, _ in counted]))
            contexts = np.unique(keys >> np.uint64(8))
            escapes = np.zeros((len(contexts), n), np.float32)
            bits = np.zeros((len(keys), n), np.float32)
            below = np.full((len(keys), n), 8.0, np.float32) if order == 0 else lower(keys & np.uint64((1 << (8 * order)) - 1))
            place = np.searchsorted(contexts, keys >> np.uint64(8))
            for j, (own, count) in enumerate(counted):
                of = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(of, count, len(contexts))
                kinds = np.bincount(of, minlength=len(contexts))
                seen = total > 0
                escapes[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                bits[:, j] = below[:, j] + escapes[place, j]
                at = np.searchsorted(keys, own)
                bits[at, j] = -np.log2(count / (total[of] + kinds[of]))
            self.keys.append(keys), self.bits.append(bits), self.contexts.append(contexts), self.escapes.append(escapes)
            lower = lambda k, order=order: self._look(k, order)

    @staticmethod
    def grams(data: np.ndarray, order: int) -> np.ndarray:
        """Context and byte at each place as one number; places before the text count as blanks."""
        padded = np.concatenate([np.full(order, 32, np.uint8), data]).astype(np.uint64)
        gram = np.zeros(len(data), np.uint64)
        for k in range(order + 1):
            gram = (gram << np.uint64(8)) | padded[k : k + len(data)]
        return gram

    def _look(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code length of each context-byte pair of ``order`` in each language."""
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        at = np.minimum(np.searchsorted(self.keys[order], keys), len(self.keys[order]) - 1)
        found = self.bits[order][at]
        missed = np.flatnonzero(self.keys[order][at] != keys)
        if len(missed):
            open_keys = keys[missed]
            found[missed] = self._look(open_keys & np.uint64((1 << (8 * order)) - 1), order - 1)
            context = open_keys >> np.uint64(8)
            place = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            known = self.contexts[order][place] == context
            found[missed[known]] += self.escapes[order][place[known]]
        return found

    def lengths(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code length of each sentence in each language, its bytes)."""
        coded = [(" " + s.lower()).encode() for s in sentences]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        if not len(coded):
            return np.zeros((0, len(self.languages)), np.float32), sizes
        keys = self.grams(np.frombuffer(b"".join(coded), np.uint8), ORDER)
        distinct, which = np.unique(keys, return_inverse=True)
        per_key = self._look(distinct, ORDER)
        sums = [np.add.reduceat(per_key[:, j][which], np.cumsum(sizes) - sizes, dtype=np.float64) for j in range(len(self.languages))]
        return np.stack(sums, axis=1), sizes


def segments(lengths: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(language, first sentence, sentences, confidence) of the shortest code of sentences on end, noise left out."""
    sound = lengths.min(axis=1) < NOISE * sizes
    found = []
    begin = 0
    while begin < len(sound):
        if not sound[begin]:
            begin += 1
            continue
        stop = begin
        while stop < len(sound) and sound[stop]:
            stop += 1
        part = lengths[begin:stop]
        if part.argmin(axis=1).min() == part.argmin(axis=1).max():
            path = np.full(len(part), part[0].argmin())
        else:
            cost, back = part[0].copy(), []
            for row in part[1:]:
                change = cost.min() + CHANGE
                back.append(np.where(cost <= change, np.arange(len(cost)), cost.argmin()))
                cost = np.minimum(cost, change) + row
            path = [int(cost.argmin())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            path = np.array(path[::-1])
        edges = np.flatnonzero(np.diff(path)) + 1
        for a, b in zip([0, *edges], [*edges, len(path)]):
            total = part[a:b].sum(axis=0)
            share = 1.0 / np.exp2(np.maximum(total.min() - total, -60.0)).sum()
            found.append((int(path[a]), int(begin + a), int(b - a), float(share)))
        begin = stop
    return found


def fit(docs: DataFrame, id_column: str, text_column: str, label_column: str, sample_rows: int = 3_000, language_bytes: int = 150_000) -> Ppm:
    """Context trees from about ``sample_rows`` labelled documents chosen by hash, ``language_bytes`` for each language.

    Wrong labels in the sample are outvoted before the fit: its sentences go to the language whose trigrams fit.
    """
    labelled = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), label_code(F.col(f"`{label_column}`")).alias("lang")).where("lang is not null and length(text) > 80")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    picked = labelled.withColumn("place", F.row_number().over(first)).where(F.col("place") <= -(-sample_rows // len(CODES))).select("text", "lang").toPandas()
    told = [(s, lang) for text, lang in zip(picked["text"], picked["lang"]) for s in running_text(text)]
    for _ in range(2):
        told = _relabelled(told)
    by: dict[str, dict[str, None]] = {lang: {} for lang in CODES}
    for s, lang in told:
        by[lang][s] = None
    rng = np.random.default_rng(0)
    shuffled = {lang: [list(group)[i] for i in rng.permutation(len(group))] for lang, group in by.items()}
    return Ppm({lang: ("  " + "  ".join(group)).lower().encode()[:language_bytes] for lang, group in shuffled.items()})


def _relabelled(told: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Each sentence with the language in which its trigrams are the most frequent.

    Shares of trigrams among all trigrams of a label, unlike probabilities after a context, stay low for sentences
    that only stray under a label, so a tenth of wrong labels does not pull them along.
    """
    if not told:
        return told
    sentences, labels = [s for s, _ in told], sorted(CODES)
    coded = [(" " + s.lower()).encode() for s in sentences]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    distinct, which = np.unique(Ppm.grams(np.frombuffer(b"".join(coded), np.uint8), 2), return_inverse=True)
    owner = np.repeat([labels.index(lang) for _, lang in told], sizes)
    counts = np.bincount(which * len(labels) + owner, minlength=len(distinct) * len(labels)).reshape(-1, len(labels))
    cost = -np.log2((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(distinct)))
    sums = np.stack([np.add.reduceat(cost[which, j], np.cumsum(sizes) - sizes) for j in range(len(labels))], axis=1)
    return [(s, labels[k]) for s, k in zip(sentences, sums.argmin(axis=1))]


def _read(docs: DataFrame, id_column: str, text_column: str, model: Ppm, rows_of: Callable[[list[tuple[str, int, float]]], list[tuple]], schema: str, label: Column) -> DataFrame:
    """Rows of ``schema``, behind id and label, that ``rows_of`` makes of the (language, sentences, confidence) of each document's segments."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        cached: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts = [paragraphs(text) for text in batch["text"]]
            fresh = list(dict.fromkeys(p for parts in texts for part in parts for p in part if p not in cached))
            for begin in range(0, len(fresh), 2_000):
                own = fresh[begin : begin + 2_000]
                sentences = [_sentences(p) for p in own]
                lengths, sizes = trees.lengths([s for group in sentences for s in group])
                at = 0
                for paragraph, group in zip(own, sentences):
                    cached[paragraph] = lengths[at : at + len(group)], sizes[at : at + len(group)]
                    at += len(group)
            rows = []
            for i, label, parts in zip(batch["id"], batch["label"], texts):
                told = []
                for part in parts:
                    lengths, sizes = (np.concatenate(x) for x in zip(*[cached[p] for p in part]))
                    told += [(trees.languages[lang], count, share) for lang, _, count, share in segments(lengths, sizes) if count >= 2]
                rows += [(i, label, *row) for row in rows_of(told)]
            yield pd.DataFrame(rows, columns=names)
            if len(cached) > CACHE_BLOCKS:
                cached.clear()

    names = ["id", "label", *[c.split()[0] for c in schema.split(", ")]]
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{text_column}`").alias("text")).where("id is not null and length(text) > 0")
    return plain.mapInPandas(run, f"id long, label string, {schema}")


def document_segments(docs: DataFrame, id_column: str, text_column: str, model: Ppm) -> DataFrame:
    """(id, segment, lang, sentences, confidence): the segments of each document with two or more sentences, in order."""
    rows_of = lambda told: [(k, *segment) for k, segment in enumerate(told)]
    return _read(docs, id_column, text_column, model, rows_of, "segment int, lang string, sentences int, confidence double", F.lit(None).cast("string")).drop("label")


def document_languages(docs: DataFrame, id_column: str, text_column: str, label_column: str, model: Ppm) -> DataFrame:
    """(id, lang, sentences, confidence, languages, label): each language of a document beside its label's code."""

    def rows_of(told: list[tuple[str, int, float]]) -> list[tuple]:
        by = {lang: [s for s in told if s[0] == lang] for lang in dict.fromkeys(s[0] for s in told)}
        return [(lang, sum(s[1] for s in own), max(s[2] for s in own), len(by)) for lang, own in by.items()]

    label = label_code(F.col(f"`{label_column}`"))
    found = _read(docs, id_column, text_column, model, rows_of, "lang string, sentences int, confidence double, languages int", label)
    whole = found.groupBy("id", "lang").agg(F.max(F.struct("languages", "sentences", "confidence", "label")).alias("best"))
    return whole.select("id", "lang", "best.sentences", "best.confidence", "best.languages", "best.label")
