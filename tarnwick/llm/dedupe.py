"""Duplicates hidden by formatting: lines that say the same in another dress.

Byte-identical lines collapse first, with their counts; only the distinct survivors are canonicalised, and the
survivors are grouped again on their full canonical text with the counts summed.

Canonical text of a string: its words in lower case and in order. A word is a run of letters or a run of
digits; a lower-case letter before a capital and a small one also ends a word (``AbCd12`` is ``12 ab cd``). So
case, white space, punctuation and the order of the words do not count, and every number stays as written.

Words written together without such a mark (``ABCD12``, ``12 34`` and ``1234``) give another canonical text. Lines
whose texts hold the same letters and digits in other words are therefore compared: they are copies if in each
column the words of the one are those of the other or written together from them, in any order. Letters in
another order are never enough: ``silent`` and ``listen`` stay two lines. Lines linked over others are copies too. Several tables go through the same
jobs side by side; lines of different tables are never copies.

Defined cases: null equals only null; a text without letters and digits equals the empty text; other types
compare by value; a line sent twice (same id and content) is one line; columns that are neither content nor
the id are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.session import durable

#: Parts that a hot line is counted in.
SALTS = 32
#: Lines (16 bytes each) up to which the lines to compare are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A word: digits, or letters up to a small one before a capital and a small one.
_WORD = r"(\p{N}+|[\p{L}\p{M}](?:(?!(?<=\p{Ll})\p{Lu}\p{Ll})[\p{L}\p{M}])*)"


def canonical_text(text: Column) -> Column:
    """The canonical text described above; null stays null."""
    words = F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1)), " ")), " ")
    return F.array_join(F.sort_array(words), " ")


def _digest(columns: list[Column]) -> Column:
    """128 bits of the SHA-256 over all columns, lengths and nulls told apart; stands in for the long text in joins."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 32))


def _content(df: DataFrame, id_column: str, content: list[str]) -> DataFrame:
    """``id`` and the content under plain names, so that no column of the table clashes with those made here."""
    return df.select(F.col(f"`{id_column}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(content)])


@dataclass(frozen=True)
class Source:
    """A table whose lines are compared with each other: its name, the column of the ids and the columns that count."""

    name: str
    df: DataFrame
    id_column: str
    content: list[str]

    def rows(self) -> DataFrame:
        return _content(self.df, self.id_column, self.content)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _bucketed(lines: DataFrame) -> DataFrame:
    """Puts the order-free hash of a line's letters and digits (``bucket``) and its number of words in place of its text."""
    kept = [f for f in lines.schema.fields if f.name not in ("line", "rest")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A blank before and behind each text: every text has its place in the sums, every word its end.
            texts = [f" {t} " for t in batch.column("line").to_pylist()]
            begin = np.cumsum([0] + [len(t) for t in texts])[:-1]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            filled = codes != 32
            ends = filled & np.append(~filled[1:], True)
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(np.where(filled, _mixed(codes), np.uint64(0)), begin) if len(texts) else np.zeros(0, np.uint64)
                bucket = sums ^ _mixed(batch.column("rest").to_numpy().view(np.uint64))
            words = (np.add.reduceat(ends.astype(np.int64), begin) if len(texts) else np.zeros(0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(bucket.view(np.int64)), pa.array(words)], [*[f.name for f in kept], "bucket", "words"])

    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return lines.mapInArrow(run, f"{told}, bucket long, words int")


def _canonical(rows: DataFrame) -> tuple[list[Column], list[Column]]:
    """(canonical texts, other columns) of the content of ``rows``."""
    keys = [c for c in rows.columns if c.startswith("c")]
    texts = [canonical_text(F.col(c)) for c in keys if _is_text(rows, c)]
    return texts, [F.col(c) for c in keys if not _is_text(rows, c)]


def _raw(source: Source, rows: DataFrame) -> Column:
    return _digest([F.lit(source.name).alias("of"), *[F.col(c) for c in rows.columns if c != "id"]]).alias("raw")


def survivors(sources: list[Source]) -> DataFrame:
    """Distinct byte-identical lines of each source: (source, raw, canon, lo, n, bucket, words).

    ``raw`` and ``canon`` are digests of the line and of its full canonical text, each with the source's name; ``n``
    counts the ids. Rows go to parts by content and a salt of the id, so a line sent twice counts once, a hot line
    is counted in ``SALTS`` parts, and all further work is done for each of those counts once, not for each row.
    """
    found = []
    for number, source in enumerate(sources):
        rows = source.rows()
        keys = [c for c in rows.columns if c != "id"]
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).repartition(*keys, "salt")
        once = salted.groupBy("id", *keys, "salt").agg(F.lit(1).alias("one"))
        lines = once.groupBy(*keys, "salt").agg(F.min("id").alias("lo"), F.sum("one").alias("n"))
        texts, others = _canonical(rows)
        named = [t.alias(f"t{i}") for i, t in enumerate(texts)]
        with_texts = lines.select(_raw(source, rows), *others, *named, "lo", "n")
        plain = [F.col(f"t{i}") for i in range(len(texts))]
        flags = F.xxhash64(F.lit(source.name), *[c.isNull() for c in [*others, *plain]], *others)
        canon = _digest([F.lit(source.name).alias("of"), *others, *plain])
        found.append(with_texts.select(F.lit(number).alias("source"), "raw", canon.alias("canon"), F.concat_ws(" ", F.lit(""), *plain).alias("line"), flags.alias("rest"), "lo", "n"))
    return _bucketed(reduce(DataFrame.unionByName, found))


def joined(fine: list[str], coarse: list[str]) -> bool:
    """Whether the words ``coarse`` are the words ``fine`` or written together from them, each used once, in any order."""
    # A word of both sides may stand for itself: where it was part of another word, that word takes its parts.
    left, want = Counter(fine) - Counter(coarse), list((Counter(coarse) - Counter(fine)).elements())
    if sum(len(w) * n for w, n in left.items()) != sum(map(len, want)):
        return False
    lengths = sorted({len(w) for w in left}, reverse=True)
    open_states = [("", tuple(want), left)]
    while open_states:
        rest, words, left = open_states.pop()
        if not rest:
            if not words:
                return True
            rest, words = words[0], words[1:]
        for size in lengths:
            if size <= len(rest) and left[head := rest[:size]] > 0:
                open_states.append((rest[size:], words, left - Counter([head])))
    return False


def _links(sources: list[Source], lines: DataFrame, several: DataFrame) -> DataFrame:
    """(u, v): canonical texts of one bucket of which one is written together from the other.

    The texts of these buckets are fetched by one line each. Texts meet over a word of the finer one that begins a
    word of the coarser one; of the coarser one's words the one with the fewest such partners is asked.
    """
    one = durable(lines.join(several.select("bucket"), "bucket", "left_semi").groupBy("bucket", "canon", "words").agg(F.min("raw").alias("raw")))
    compared = one.count()
    if not compared:
        return one.select(F.col("canon").alias("u"), F.col("canon").alias("v"))
    wanted = one.select("raw") if compared > BROADCAST_ROWS else F.broadcast(one.select("raw"))
    told = []
    for source in sources:
        rows = source.rows()
        told.append(rows.select(_raw(source, rows), F.array(*_canonical(rows)[0]).alias("texts")).join(wanted, "raw", "left_semi").groupBy("raw").agg(F.first("texts").alias("texts")))
    full = durable(reduce(DataFrame.unionByName, told).join(one, "raw").select("bucket", "canon", "words", "texts"))
    listed = F.filter(F.split(F.concat_ws(" ", F.lit(""), "texts"), " "), lambda w: w != "")
    has = full.select("bucket", "canon", "words", F.explode(F.array_distinct(listed)).alias("word"))
    sizes = has.select("bucket", F.length("word").alias("size")).distinct()
    starts = has.join(sizes, "bucket").where("size <= length(word)").select("bucket", "canon", "words", "word", F.expr("substring(word, 1, size)").alias("start"))
    frequent = has.groupBy("bucket", F.col("word").alias("start")).agg(F.count(F.lit(1)).alias("partners"))
    asked = starts.join(frequent, ["bucket", "start"]).groupBy("bucket", "canon", "word").agg(F.sum("partners").alias("partners"))
    chosen = asked.groupBy("bucket", "canon").agg(F.min(F.struct("partners", "word"))["word"].alias("word"))
    coarse = starts.join(chosen, ["bucket", "canon", "word"]).select("bucket", F.col("canon").alias("v"), F.col("words").alias("fewer"), "start")
    pairs = has.select("bucket", F.col("canon").alias("u"), "words", F.col("word").alias("start")).join(coarse, ["bucket", "start"]).where("words > fewer").select("u", "v").distinct()

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            right = [all((a is None) == (b is None) and joined((a or "").split(), (b or "").split()) for a, b in zip(fine, coarse)) for fine, coarse in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right, pa.bool_())), batch.column(1).filter(pa.array(right, pa.bool_()))], ["u", "v"])

    fine_texts, coarse_texts = full.select(F.col("canon").alias("u"), "texts"), full.select(F.col("canon").alias("v"), F.col("texts").alias("others"))
    return pairs.join(fine_texts, "u").join(coarse_texts, "v").select("u", "v", "texts", "others").mapInArrow(check, "u binary, v binary")


def _roots(links: DataFrame) -> DataFrame:
    """(v, root): each linked text with the smallest text that links lead to.

    Texts hand on the smallest text they know until nothing changes; a chain of written-together texts is as long
    as a text has words at most, and mostly one link long.
    """
    both = durable(links.union(links.select("v", "u")).distinct())
    labels = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    while True:
        labels = durable(labels)
        told = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("root").alias("told"))
        moved = durable(labels.join(told, "v").select("v", F.least("root", "told").alias("root"), (F.col("told") < F.col("root")).alias("moved")))
        labels = moved.select("v", "root")
        if moved.where("moved").isEmpty():
            return labels


def copy_classes(sources: list[Source], lines: DataFrame) -> DataFrame:
    """(source, canon, id_a, copies): for each canonical text its class's smallest id and number of lines, from ``survivors``."""
    kinds = lines.groupBy("source", "bucket").agg(
        F.min("canon").alias("canon"), F.max("canon").alias("other"), F.min("words").alias("few"), F.max("words").alias("many"), F.min("lo").alias("id_a"), F.sum("n").alias("copies")
    )
    kinds = durable(kinds)
    single = kinds.where("canon = other").select("source", "canon", "id_a", "copies")
    mixed = kinds.where("canon <> other")
    texts = lines.join(mixed.select("bucket"), "bucket", "left_semi").groupBy("source", "canon").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"))
    roots = _roots(_links(sources, lines, mixed.where("few < many")))
    rooted = durable(texts.join(roots.withColumnRenamed("v", "canon"), "canon", "left").select("source", "canon", F.coalesce("root", "canon").alias("root"), "lo", "n"))
    whole = rooted.groupBy("root").agg(F.min("lo").alias("id_a"), F.sum("n").alias("copies"))
    return single.unionByName(rooted.select("source", "canon", "root").join(whole, "root").select("source", "canon", "id_a", "copies"))


def _named(sources: list[Source]) -> Column:
    return F.get(F.array(*[F.lit(s.name) for s in sources]), F.col("source")).alias("tbl")


def counted(sources: list[Source]) -> DataFrame:
    """(tbl, id_a, copies): one line for each class of copies, named by its smallest id, with the number of its lines."""
    return copy_classes(sources, durable(survivors(sources))).select(_named(sources), "id_a", "copies").distinct()


def copies(sources: list[Source]) -> DataFrame:
    """(tbl, id_a, id_b): for each class of copies its smallest id, with one row for each other id.

    The ids of a class are as many as its copies, so no group is asked for them: the lines of classes with copies
    take the class's smallest id along and meet the rows by the digest of the line.
    """
    lines = durable(survivors(sources))
    classes = copy_classes(sources, lines).where("copies > 1").select("canon", "id_a")
    members = lines.join(classes, "canon").select("raw", "id_a").distinct()
    keyed = []
    for source in sources:
        rows = source.rows()
        keyed.append(rows.select(F.lit(source.name).alias("tbl"), F.col("id").alias("id_b"), _raw(source, rows)))
    return reduce(DataFrame.unionByName, keyed).join(members, "raw").where("id_b <> id_a").select("tbl", "id_a", "id_b").distinct()
