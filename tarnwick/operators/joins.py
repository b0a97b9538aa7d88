"""Joins: first match wins, priorities, upserts, alignment and nearest centres.

All but ``upsert`` work on keys that may repeat or be null: null keys match nothing, ties go to the smallest order column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import last_words, words
from tarnwick.operators.ranking import row_index


def first_match(left: DataFrame, right: DataFrame, on: str, value: str, order: str) -> DataFrame:
    """``left`` with the ``value`` of the first ``right`` row of each key, null where there is none."""
    firsts = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.min_by(value, order).alias(value))
    return left.join(firsts, on, "left")


def label_cascade(labels: DataFrame, tips: DataFrame, label: str, tip: str, order: str) -> DataFrame:
    """(label, tip, method): tried in turn are the whole label, its last two words, its epithet, its epithet without what precedes an underscore.

    Names compare as written, epithets in lower case. The first step that has a tip wins, of its tips the first in
    ``order``. The labels are read once; the steps are left joins one after another.
    """
    named = tips.select(F.translate(F.col(tip), "_", " ").alias("plain"), F.col(tip).alias("tip"), F.col(order).alias("place"))
    by_name = named.groupBy(F.col("plain").alias("key")).agg(F.min_by("tip", "place").alias("tip"))
    by_epithet = named.groupBy(F.lower(last_words(F.col("plain"), 1)).alias("key")).agg(F.min_by("tip", "place").alias("tip"))
    column = F.col(label)
    raw = F.filter(F.split(F.trim(column), " +"), lambda w: F.length(w) > 0)
    steps: list[tuple[str, Column, DataFrame]] = [
        ("exact", column, by_name),
        ("last_two_words", F.array_join(F.slice(raw, F.greatest(F.size(raw) - 1, F.lit(1)), 2), " "), by_name),
        ("epithet_only", F.lower(F.element_at(raw, -1)), by_epithet),
        ("epithet_underscore_stripped", F.lower(F.element_at(words(F.element_at(raw, -1)), -1)), by_epithet),
    ]
    found = labels.select(label).where(column.isNotNull() & (F.size(raw) > 0)).distinct()
    found = found.select(label, *[key.alias(f"key_{i}") for i, (_, key, _) in enumerate(steps)])
    for i, (_, _, known) in enumerate(steps):
        found = found.join(known.select(F.col("key").alias(f"key_{i}"), F.col("tip").alias(f"tip_{i}")), f"key_{i}", "left")
    hits = [F.col(f"tip_{i}") for i in range(len(steps))]
    method = F.coalesce(*[F.when(hit.isNotNull(), F.lit(name)) for hit, (name, _, _) in zip(hits, steps)], F.lit("none"))
    return found.select(label, F.coalesce(*hits).alias("tip"), method.alias("method"))


def matching_audit(labels: DataFrame, tips: DataFrame, label: str, tip: str, order: str) -> DataFrame:
    """(label, tip, method, in_tree): ``label_cascade`` with whether a tip was found; labels that are dropped have none."""
    return label_cascade(labels, tips, label, tip, order).withColumn("in_tree", F.col("tip").isNotNull())


def by_priority(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, source): the value of the first source that has the key; the smallest of several."""
    ranked = reduce(DataFrame.unionByName, [s.select(key, F.col(value).alias("value"), F.lit(i).alias("source")) for i, s in enumerate(sources)])
    best = ranked.where(F.col(key).isNotNull() & F.col("value").isNotNull()).groupBy(key).agg(F.min(F.struct("source", "value")).alias("best"))
    return best.select(key, F.col("best.value").alias("value"), F.col("best.source").alias("source"))


def upsert(base: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """``base`` with the columns of ``change`` put in place where the key is the same, its other columns kept.

    Rows of ``change`` with a new key are added, null in the columns that it lacks. A key sent twice is an error of
    the caller: ``change`` has one row a key.
    """
    given = [c for c in change.columns if c != key]
    new = change.select(F.col(key), F.lit(True).alias("given_"), *[F.col(c).alias(f"new_{c}") for c in given])
    both = base.join(new, key, "full")
    return both.select(*[F.when(F.col("given_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])


def upsert_with_ids(base: DataFrame, change: DataFrame, key: str, id_column: str) -> DataFrame:
    """``upsert`` where added rows get ids from the largest id of ``base`` on, in the order of their keys.

    Numbers come from ranges of the keys (``ranking.row_index``), not from one task.
    """
    merged = upsert(base, change.drop(id_column), key)
    top = base.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top_"))
    fresh = row_index(merged.where(F.col(id_column).isNull()).withColumn("all_", F.lit(1)), ["all_"], [F.col(key)]).drop("all_")
    numbered = fresh.join(F.broadcast(top)).withColumn(id_column, (F.col("top_") + F.col("place") + 1).cast(base.schema[id_column].dataType)).select(*base.columns)
    return merged.where(F.col(id_column).isNotNull()).unionByName(numbered)


def remaining(work: DataFrame, log: DataFrame, key: str, done: Column) -> DataFrame:
    """The rows of ``work`` that no row of ``log`` with ``done`` names: what a run that goes on has still to do."""
    return work.join(log.where(done).select(key), key, "left_anti")


def continued(log: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """``log`` followed by the rows of ``added`` whose key it does not hold; columns that one lacks are null."""
    return log.unionByName(added.join(log.select(key), key, "left_anti"), allowMissingColumns=True)


def in_order_of(rows: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """``rows`` whose key ``order`` holds, with its ``place`` there: the order of another table."""
    return rows.join(order.select(key, place), key).select(place, *rows.columns)


def aligned_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """The keys that all tables hold."""
    return reduce(lambda a, b: a.intersect(b), [t.select(key).where(F.col(key).isNotNull()) for t in tables])


def aligned_pairs(tables: list[DataFrame]) -> list[DataFrame]:
    """Distance tables (a, b, d) cut to the entities that all of them hold."""
    names = aligned_keys([t.select(F.col("a").alias("k")).union(t.select("b")).distinct() for t in tables], "k")
    return [t.join(names.withColumnRenamed("k", "a"), "a", "left_semi").join(names.withColumnRenamed("k", "b"), "b", "left_semi") for t in tables]


def nearest_centre(rows: DataFrame, centres: DataFrame, key: str, vector: str, centre_key: str, centre_vector: str, most_centres: int = 10_000) -> DataFrame:
    """(key, nearest, distance): each row's closest centre; at most ``most_centres`` go to every task, as one array."""
    if centres.limit(most_centres + 1).count() > most_centres:
        raise ValueError(f"more than {most_centres} centres; cut them into blocks and keep the closest of each")
    every = centres.agg(F.collect_list(F.struct(F.col(centre_key).alias("k"), F.col(centre_vector).alias("c"))).alias("centres"))
    gaps = F.transform("centres", lambda s: F.struct(F.aggregate(F.zip_with(s["c"], F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v).alias("gap"), s["k"].alias("k")))
    best = F.array_min(gaps)
    return rows.join(F.broadcast(every)).select(key, best["k"].alias("nearest"), F.sqrt(best["gap"]).alias("distance"))
