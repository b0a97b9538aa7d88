"""Ranks, curves, percentiles, samples and splits.

Running counts inside a group are taken in two steps: the rows are laid out in ranges of the order, each range counts
for itself, and each takes along what lies in the ranges before it. So a group of all rows is spread over the ranges
like any other; only the counts of the ranges (groups times partitions) meet in one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import durable


def running(rows: DataFrame, by: list[str], order: list[Column], sums: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``before_x`` for each x of ``sums``: its sum over the rows of the group that come before in ``order``.

    ``order`` must tell any two rows of a group apart. ``parts`` sets the number of ranges, else the session does. The
    layout is made durable before it is counted, so a lost task finds the same ranges again.
    """
    keys = [F.col(c) for c in by]
    ranged = rows.repartitionByRange(parts, *keys, *order) if parts else rows.repartitionByRange(*keys, *order)
    placed = durable(ranged.withColumn("part_", F.spark_partition_id()))
    totals = placed.groupBy(*by, "part_").agg(*[F.sum(x).alias(f"sum_{x}") for x in sums])
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "part_", *[F.coalesce(F.sum(f"sum_{x}").over(earlier), F.lit(0)).alias(f"offset_{x}") for x in sums])
    inside = Window.partitionBy(*by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"own_{x}") for x in sums])
    same = [own[c].eqNullSafe(offsets[c]) for c in [*by, "part_"]]
    met = own.join(offsets, reduce(Column.__and__, same))
    return met.select(*[own[c] for c in rows.columns], *[(own[f"own_{x}"] + offsets[f"offset_{x}"]).alias(f"before_{x}") for x in sums])


def row_index(rows: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` with ``place``: the number of rows of their group before them in ``order``."""
    return running(rows.withColumn("one_", F.lit(1)), by, order, ["one_"], parts).drop("one_").withColumnRenamed("before_one_", "place")


def average_rank(rows: DataFrame, value: str, by: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``rank``: ranks from one within ``by``, equal values share the mean of theirs.

    Equal values are counted first, so the running count has one row for each distinct value.
    """
    counted = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("same_"))
    placed = running(counted, [by], [F.col(value)], ["same_"], parts)
    ranked = placed.select(by, value, (F.col("before_same_") + (F.col("same_") + 1) / 2).alias("rank"))
    return rows.join(ranked, [by, value])


def score_curve(rows: DataFrame, by: str, score: str, positive: str, parts: int | None = None) -> DataFrame:
    """(by, score, pos, neg, tp, fp, p, n): counts of each score and running counts by falling score, equal scores in one step."""
    counted = rows.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.sum((~F.col(positive)).cast("long")).alias("neg"))
    totals = counted.groupBy(by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    placed = running(counted, [by], [F.desc(score)], ["pos", "neg"], parts)
    return placed.select(by, score, "pos", "neg", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_neg") + F.col("neg")).alias("fp")).join(totals, by)


def _area(curve: DataFrame, by: str, x: Column, y: Column, x_before: Column, y_before: Column) -> DataFrame:
    """(by, area): each step's trapezoid from the counts before it, so no row looks for its neighbour."""
    return curve.groupBy(by).agg(F.sum((x - x_before) * (y + y_before) / 2).alias("area"))


def roc_auc(rows: DataFrame, by: str, score: str, positive: str, parts: int | None = None) -> DataFrame:
    """(by, auc): area under the curve from (0, 0); one half where one class is missing."""
    curve = score_curve(rows, by, score, positive, parts)
    tp, fp, pos, neg, p, n = (F.col(c) for c in ("tp", "fp", "pos", "neg", "p", "n"))
    area = _area(curve.where("p > 0 and n > 0"), by, fp / n, tp / p, (fp - neg) / n, (tp - pos) / p)
    return curve.select(by).distinct().join(area, by, "left").select(by, F.coalesce("area", F.lit(0.5)).alias("auc"))


def pr_area(rows: DataFrame, by: str, score: str, positive: str, parts: int | None = None) -> DataFrame:
    """(by, ap): area under precision over recall from (0, 1); zero without positives."""
    curve = score_curve(rows, by, score, positive, parts)
    tp, fp, pos, neg, p = (F.col(c) for c in ("tp", "fp", "pos", "neg", "p"))
    before = F.when(tp + fp > pos + neg, (tp - pos) / (tp - pos + fp - neg)).otherwise(1.0)
    area = _area(curve.where("p > 0"), by, tp / p, tp / (tp + fp), (tp - pos) / p, before)
    return curve.select(by).distinct().join(area, by, "left").select(by, F.coalesce("area", F.lit(0.0)).alias("ap"))


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """(by, each name of ``shares``): exact percentiles with linear interpolation, nulls left out.

    The places asked for are found in the running counts of the distinct values; no task holds a group's values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("same_"))
    totals = counted.groupBy(by).agg(F.sum("same_").alias("n_"))
    placed = running(counted, [by], [F.col(value)], ["same_"], parts).join(totals, by)
    at = lambda place: F.max(F.when((F.col("before_same_") <= place) & (place < F.col("before_same_") + F.col("same_")), F.col(value)))
    wanted = {name: share * (F.col("n_") - 1) for name, share in shares.items()}
    ends = placed.groupBy(by, "n_").agg(*[c for name, w in wanted.items() for c in (at(F.floor(w)).alias(f"low_{name}"), at(F.ceil(w)).alias(f"high_{name}"))])
    between = {name: F.col(f"low_{name}") + (w - F.floor(w)) * (F.col(f"high_{name}") - F.col(f"low_{name}")) for name, w in wanted.items()}
    return ends.select(by, *[c.alias(name) for name, c in between.items()])


def running_offsets(rows: DataFrame, key: str, place: str, width: str) -> DataFrame:
    """``rows`` with ``offset``: the sum of the widths before each place of its key."""
    before = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(width).over(before), F.lit(0.0)))


def hash_sample(rows: DataFrame, by: str, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows of each group in the order of md5(key_seed): the same rows in any engine and on any cluster.

    Parts of a group keep their first ``count`` before the group is brought together.
    """
    marked = rows.withColumn("mark", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")).cast("binary"))).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(32)))
    for keys in ([by, "salt"], [by]):
        marked = marked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("mark", key))).where(F.col("place") <= count)
    return marked.drop("mark", "salt")


def stratified_split(rows: DataFrame, stratum: str, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """(key, stratum, split): within each stratum the rows in hashed order, cut at the shares.

    The order is taken inside 256 parts of a stratum (by the first two digits of the hash), with the parts' counts before.
    """
    marked = rows.select(key, stratum, F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")).cast("binary")).alias("mark")).withColumn("part", F.substr("mark", F.lit(1), F.lit(2)))
    counts = marked.groupBy(stratum, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(stratum).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select(stratum, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(Window.partitionBy(stratum)).alias("total"))
    inside = Window.partitionBy(stratum, "part").orderBy("mark", key)
    placed = marked.withColumn("own", F.row_number().over(inside)).join(spans, [stratum, "part"]).withColumn("at", (F.col("skip") + F.col("own") - 1) / F.col("total"))
    names, edge = list(shares), 0.0
    split = F.lit(names[-1])
    cuts = []
    for name in names[:-1]:
        edge += shares[name]
        cuts.append((name, edge))
    for name, cut in reversed(cuts):
        split = F.when(F.col("at") < cut, F.lit(name)).otherwise(split)
    return placed.select(key, stratum, split.alias("split"))
