"""Mapping of free-entered values to the entries of a reference list.

Distinct values are parsed into keys of letters; the keys meet the reference entries in shards. A task holds one
shard as a BK-tree under the Levenshtein metric, built once, and all its keys stream through it in batches: at every
node the distances to all keys still alive come from one array program, and the triangle inequality prunes each
key's children. A shard returns every entry within the threshold, also the equal one; the shards' winners then merge
into the closest entry.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import durable

#: Entries of one tree, and keys that one task walks through it at least.
SHARD_ROWS, TASK_KEYS = 20_000, 2_000
#: Fixed values, by what is usual in typed names of species: words beside a name that do not change what is meant.
QUALIFIERS = {"cf", "aff", "nr", "juv", "male", "female", "adult", "ssp", "subsp", "var", "mask", "match", "copy"}
#: Digits typed for letters inside a word.
DIGITS = str.maketrans("01", "ol")
FILE_ENDING = re.compile(r"\.(png|jpe?g|webp|tiff?|bmp)\b")


def _by_rows(word: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distances from one word of any length to many: rows of ``others`` are code points padded to the longest."""
    steps = np.arange(others.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(others), len(steps)))
    for i, code in enumerate(word, 1):
        best = np.empty(row.shape, np.int32)
        best[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != code), out=best[:, 1:])
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    return row[np.arange(len(others)), lengths]


def levenshtein(word: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distances from one word to many: rows of ``others`` are code points padded to the longest.

    A column of the distance table of a word of up to 64 letters is two numbers, the bits where it rises and where
    it falls (the bit-vector algorithm); all rows take their next letter at once.
    """
    m = len(word)
    if not m or m > 64:
        return _by_rows(word, others, lengths)
    letters, at = np.unique(word, return_inverse=True)
    masks = np.zeros(len(letters) + 1, np.uint64)
    for i, k in enumerate(at):
        masks[k] |= np.uint64(1 << i)
    place = np.minimum(np.searchsorted(letters, others), len(letters) - 1)
    place[letters[place] != others] = len(letters)
    equal = masks[place.T]
    one, high = np.uint64(1), np.uint64(m - 1)
    rises, falls = np.full(len(others), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(others), np.uint64)
    score = np.full(len(others), m, np.int32)
    found = score.copy()
    for j in range(int(lengths.max(initial=0))):
        same = equal[j]
        across = (((same & rises) + rises) ^ rises) | same
        up, down = falls | ~(across | rises), rises & across
        score += ((up >> high) & one).astype(np.int32)
        score -= ((down >> high) & one).astype(np.int32)
        last = lengths == j + 1
        found[last] = score[last]
        up, down = (up << one) | one, down << one
        rises, falls = down | ~((same | falls) | up), up & (same | falls)
    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class BKTree:
    """A Burkhard-Keller tree over distinct words."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        self.codes = [_codes(w) for w in self.words]
        self.children: list[dict[int, int]] = [{} for _ in self.words]
        if len(self.words) > 1:
            width = max(map(len, self.codes))
            table = np.full((len(self.codes), width), 0xFFFFFFFF, np.uint32)
            for i, c in enumerate(self.codes):
                table[i, : len(c)] = c
            lengths = np.array([len(c) for c in self.codes])
            todo = [(0, np.arange(1, len(self.codes)))]
            while todo:
                node, under = todo.pop()
                apart = levenshtein(self.codes[node], table[under], lengths[under])
                for d in np.unique(apart):
                    group = under[apart == d]
                    self.children[node][int(d)] = int(group[0])
                    if len(group) > 1:
                        todo.append((int(group[0]), group[1:]))

    def within(self, keys: list[str], limits: np.ndarray) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """(positions of keys, word, distances) for every word within a key's limit."""
        if not self.words or not keys:
            return
        codes = [_codes(k) for k in keys]
        table = np.full((len(keys), max(1, max(map(len, codes)))), 0xFFFFFFFF, np.uint32)
        for i, c in enumerate(codes):
            table[i, : len(c)] = c
        lengths = np.array([len(c) for c in codes])
        todo = [(0, np.arange(len(keys)))]
        while todo:
            node, alive = todo.pop()
            apart = levenshtein(self.codes[node], table[alive], lengths[alive])
            hit = apart <= limits[alive]
            if hit.any():
                yield alive[hit], self.words[node], apart[hit]
            for d, child in self.children[node].items():
                kept = alive[np.abs(apart - d) <= limits[alive]]
                if len(kept):
                    todo.append((child, kept))


def within(keys: DataFrame, entries: DataFrame, shard_rows: int = SHARD_ROWS, task_keys: int = TASK_KEYS) -> DataFrame:
    """(key, word, distance): every entry ``word`` within ``most`` edits of a key.

    ``keys`` has ``key`` and ``most`` (distinct), ``entries`` has ``word`` (distinct). Entries are cut into shards
    of bounded size and keys into parts; a task has one shard and one part. Its rows come sorted, the entries first:
    it builds the tree from them and lets the keys stream through it. There are as many parts as the cluster has
    cores for each shard (fewer for few keys), so a tree is built as often as it has a core, whatever the keys.
    """
    entry_count, key_count = entries.count(), keys.count()
    shards = max(1, -(-entry_count // shard_rows))
    cores = keys.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-cores // shards), -(-key_count // task_keys)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[str] = []
        tree = None
        for batch in batches:
            words += batch["text"][batch["most"] < 0].tolist()
            own = batch[batch["most"] >= 0]
            if not len(own):
                continue
            tree = tree or BKTree(words)
            texts = own["text"].tolist()
            hits = [pd.DataFrame({"key": [texts[i] for i in at], "word": word, "distance": d}) for at, word, d in tree.within(texts, own["most"].to_numpy())]
            if hits:
                yield pd.concat(hits)

    left = keys.select(F.col("key").alias("text"), "most", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")).withColumn("shard", numbers(shards))
    right = entries.select(F.col("word").alias("text"), F.lit(-1).alias("most"), F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard")).withColumn("part", numbers(parts))
    rows = left.select("text", "most", "shard", "part").union(right.select("text", "most", "shard", "part"))
    placed = rows.repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("most", "text")
    return placed.select("text", "most").mapInPandas(walk, "key string, word string, distance int")


def _words(value: str) -> list[str]:
    """Lower-case words without accents, qualifiers and numbers; digits inside a word are read as letters."""
    plain = unicodedata.normalize("NFKD", re.sub(r"([a-z])([A-Z][a-z])", r"\1 \2", value))
    plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    words = re.findall(r"[^\W_]+", FILE_ENDING.sub(" ", plain))
    words = [w.translate(DIGITS) if any(c.isalpha() for c in w) else "" for w in words]
    return [w for w in words if w and w not in QUALIFIERS]


def name_forms(value: str) -> list[tuple[str, str | None]]:
    """(key, genus prefix) readings of a typed two-word name; the prefix is null for a key of the whole name.

    Read are neighbouring words, also the other way round after a comma; a genus cut short by a full stop; a
    single word as a whole name written together or as an epithet alone (prefix empty).
    """
    words = _words(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", value)) or _words(value)
    if len(words) == 1:
        return [(words[0], None), (words[0], "")]
    pairs = list(zip(words, words[1:]))
    if "," in value:
        pairs += [(b, a) for a, b in pairs]
    forms: list[tuple[str, str | None]] = [(a + b, None) for a, b in pairs if a != b]
    return forms + [(b, a) for a, b in pairs if re.search(rf"(?i)\b{re.escape(a)}\.", value)]


def term_forms(value: str) -> list[tuple[str, str | None]]:
    """Readings of a typed term: all its words, and its words without bracketed remarks."""
    whole, bare = "".join(_words(value)), "".join(_words(re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", value)))
    return [(k, None) for k in dict.fromkeys((whole, bare)) if k]


def match(values: DataFrame, entries: DataFrame, names: bool) -> DataFrame:
    """(value, entry): the entry each distinct ``value`` means, the empty text if none.

    ``entries`` has ``entry``; with ``names`` an entry is a genus and an epithet joined by ``_``. A key may be
    off by a quarter of its letters, rounded down, three at most. The closest entry of all readings wins, on a tie
    the first in the alphabet; an epithet alone (or with a cut genus) counts only if it means one entry.
    Values without letters mean none. Null values are not expected: leave them out before.
    """
    forms_of = name_forms if names else term_forms

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, key, prefix) for v in batch["value"] for key, prefix in forms_of(v)]
            yield pd.DataFrame(rows, columns=["value", "key", "prefix"])

    forms = durable(values.select("value").distinct().mapInPandas(read, "value string, key string, prefix string"))
    low = F.lower("entry")
    whole = entries.select("entry", F.regexp_replace(low, r"[^\p{L}]", "").alias("word"), F.lit(None).cast("string").alias("genus"))
    known = whole
    if names:
        epithets = entries.select("entry", F.element_at(F.split(low, "_"), -1).alias("word"), F.element_at(F.split(low, "_"), 1).alias("genus"))
        known = whole.union(epithets)
    limit = F.least(F.lit(3), F.floor(F.length("key") / 4)).cast("int")
    longest = known.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest"))
    # A key longer than every entry by more than the limit lies within no entry's reach.
    keys = forms.select("key").distinct().join(F.broadcast(longest)).where("length(key) <= longest + 3").select("key", limit.alias("most"))
    near = within(durable(keys), known.select("word").distinct())
    hits = near.join(known, "word").select("key", "distance", "entry", "genus")
    fits = durable(forms.join(hits, "key").where("(prefix is null and genus is null) or startswith(genus, prefix)"))
    best = fits.groupBy("value").agg(F.min(F.struct("distance", "entry", "prefix")).alias("best"))
    unclear = (
        fits.join(best, "value").where("prefix is not null and best.prefix is not null and distance = best.distance")
        .groupBy("value").agg(F.count_distinct("entry").alias("n")).where("n > 1").select("value", F.lit(True).alias("unclear"))
    )
    clear = best.join(unclear, "value", "left").where("unclear is null").select("value", F.col("best.entry").alias("entry"))
    return values.select("value").distinct().join(clear, "value", "left").select("value", F.coalesce("entry", F.lit("")).alias("entry"))


def match_fields(df: DataFrame, id_column: str, lists: list[tuple[list[str], DataFrame, bool]]) -> DataFrame:
    """(id, field, entry) for each id and each listed field whose value is neither null nor blank.

    ``lists`` names the fields of each reference list, its entries (column ``entry``) and whether they are names.
    Rows sent twice give one row; a value typed by many, in any field of a list, is parsed and looked up once.
    """
    parts = []
    for fields, entries, names in lists:
        pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
        typed = df.selectExpr(f"`{id_column}`", f"stack({len(fields)}, {pairs}) as (field, value)").where(F.col("value").rlike(r"[^\s\p{Z}]")).distinct()
        parts.append(typed.join(match(typed, entries, names), "value").select(id_column, "field", "entry"))
    return reduce(DataFrame.unionByName, parts)
