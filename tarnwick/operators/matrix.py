"""Standardising, distances between entities, correlations and permutation tests.

A distance matrix has a row for each pair of entities, so it is meant for groups, species or places, not for
single records: ``entity_pairs`` refuses more than ``most`` entities. Records are reduced to entities before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.functions.numeric import euclidean
from tarnwick.operators.ranking import average_rank, row_index
from tarnwick.session import durable, stored

MOST_ENTITIES = 5_000
#: Entities of a permutation test: its two tables of pairs go to every task.
MOST_PERMUTED = 2_000
#: Permutations that one task of a permutation test counts at least.
TASK_PERMUTATIONS = 250


def checked(entities: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """``entities`` if there are at most ``most`` rows; a matrix over more would not be a small result."""
    if entities.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entities: reduce the records to groups first")
    return entities


def standardised(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key, z): each place with mean 0 and population deviation 1; a constant place keeps scale 1.

    Means and deviations are one row; they travel to the tasks as two arrays of ``size`` numbers.
    """
    places = [F.col(vector)[i] for i in range(size)]
    scales = rows.agg(F.array(*[F.avg(p) for p in places]).alias("m"), F.array(*[F.stddev_pop(p) for p in places]).alias("s"))
    both = rows.join(F.broadcast(scales))
    scaled = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.get(F.col(vector), i) - F.get("m", i)) / F.when(F.get("s", i) > 0, F.get("s", i)).otherwise(1.0))
    return both.select(key, scaled.alias("z"))


def entity_pairs(entities: DataFrame, key: str, vector: str, blocks: int = 8) -> DataFrame:
    """(a, b, va, vb) with a < b: entities meet in pairs of blocks, so the work spreads over blocks squared keys.

    The entities are counted and met twice, so they are made once.
    """
    own = checked(durable(entities.select(F.col(key).alias("k"), F.col(vector).alias("v")))).withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = own.select(F.col("k").alias("a"), F.col("v").alias("va"), F.col("block").alias("row"), every.alias("col"))
    right = own.select(F.col("k").alias("b"), F.col("v").alias("vb"), every.alias("row"), F.col("block").alias("col"))
    return left.join(right, ["row", "col"]).where("a < b").select("a", "b", "va", "vb")


def distances(entities: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, d): Euclidean distances of all pairs a < b."""
    return entity_pairs(entities, key, vector).select("a", "b", euclidean(F.col("va"), F.col("vb")).alias("d"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, d) for both directions of each pair."""
    return pairs.select("a", "b", "d").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def wide(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Square matrix with zero diagonal for a sink; ``labels`` are its columns."""
    both = pairs.select("a", "b", "d").union(pairs.select("b", "a", "d"))
    return both.groupBy("a").pivot("b", labels).agg(F.first("d")).na.fill(0.0)


def principal_distances(rows: DataFrame, key: str, vector: str, size: int, share: float = 0.95) -> DataFrame:
    """(a, b, d, components) in the space of the first components that explain ``share`` of the variance.

    All components are fitted once; a row's place is its first ones.
    """
    n = checked(rows).count()
    z = durable(standardised(rows, key, vector, size)).select(key, array_to_vector("z").alias("z"))
    model = PCA(k=min(size, max(1, n - 1)), inputCol="z", outputCol="p").fit(z)
    explained = model.explainedVariance.toArray()
    k = min(int(np.searchsorted(np.cumsum(explained), share)) + 1, len(explained))
    placed = model.transform(z).select(key, F.slice(vector_to_array("p"), 1, k).alias("p"))
    return distances(placed, key, "p").withColumn("components", F.lit(k))


def explained_variance(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(component, share, total): each component's share of the variance and the sum up to it; one row a component."""
    n = checked(rows).count()
    z = standardised(rows, key, vector, size).select(array_to_vector("z").alias("z"))
    explained = PCA(k=min(size, max(1, n - 1)), inputCol="z", outputCol="p").fit(z).explainedVariance.toArray()
    listed = [(i, float(v), float(t)) for i, (v, t) in enumerate(zip(explained, np.cumsum(explained)))]
    return rows.sparkSession.createDataFrame(listed, "component int, share double, total double")


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def spearman(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, rho): correlation of the average ranks."""
    first = average_rank(rows, x, by).withColumnRenamed("rank", "rx")
    both = average_rank(first, y, by).withColumnRenamed("rank", "ry")
    return both.groupBy(by).agg(F.corr("rx", "ry").alias("rho"))


def feature_correlations(entities: DataFrame, key: str, vector: str, pairs: DataFrame, size: int) -> DataFrame:
    """(pos, r, n): for each place, the correlation of |va - vb| with the distances ``pairs`` (a, b, d); 0 where it does not vary."""
    gaps = F.zip_with("va", "vb", lambda p, q: F.abs(p - q))
    joined = entity_pairs(entities, key, vector).select("a", "b", gaps.alias("g")).join(pairs.select("a", "b", "d"), ["a", "b"])
    long = joined.select("d", F.posexplode("g").alias("pos", "g"))
    stats = long.groupBy("pos").agg(F.corr("g", "d").alias("r"), F.stddev_pop("g").alias("s"), F.count("g").alias("n"))
    return stats.where(F.col("pos") < size).select("pos", F.when(F.col("s") < 1e-10, 0.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"), "n")


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation r of n pairs under the t distribution."""

    def one(r_: float, n_: int) -> float:
        if n_ < 3 or r_ is None or math.isnan(r_):
            return float("nan")
        df = n_ - 2
        return 0.0 if abs(r_) >= 1 else _beta(df / 2, 0.5, 1 - r_ * r_)

    return pd.Series([one(a, b) for a, b in zip(r, n)])


class Permuted:
    """Two square tables, as they are and as ranks, whose rows and columns are permuted together."""

    def __init__(self, keys: list[str], a: np.ndarray, b: np.ndarray, visual: np.ndarray, path: np.ndarray) -> None:
        self.keys, self.a, self.b = keys, a, b
        self.columns = [(visual, path), (self.ranks(visual), self.ranks(path))]
        self.squares = []
        for values, _ in self.columns:
            square = np.zeros((len(keys), len(keys)))
            square[a, b] = square[b, a] = values
            self.squares.append(square)

    @staticmethod
    def ranks(values: np.ndarray) -> np.ndarray:
        """Average ranks; values that agree to nine digits are equal."""
        _, which, same = np.unique(np.round(values, 9), return_inverse=True, return_counts=True)
        return (np.cumsum(same) - (same - 1) / 2)[which]

    def correlations(self, order: np.ndarray | None = None) -> list[float]:
        """Correlation and rank correlation, with the entity at each place of the first table replaced by ``order``."""
        found = []
        for square, (values, other) in zip(self.squares, self.columns):
            moved = values if order is None else square[order[self.a], order[self.b]]
            scale = len(values) * values.std() * other.std()
            found.append(float((moved @ other - len(values) * values.mean() * other.mean()) / scale) if scale else float("nan"))
        return found

    def order(self, number: int) -> np.ndarray:
        """Permutation ``number``: the keys in the order of md5(number_key) take the places of the sorted keys, the same in any engine."""
        marks = [hashlib.md5(f"{number}_{k}".encode()).hexdigest() for k in self.keys]
        order = np.empty(len(marks), np.int64)
        order[sorted(range(len(marks)), key=marks.__getitem__)] = np.arange(len(marks))
        return order


def mantel(visual: DataFrame, path: DataFrame, count: int) -> DataFrame:
    """(r, p, rho, rho_p, pairs): correlation and rank correlation of two distance tables (a, b, d), each with its one-sided permutation p.

    The pairs that both tables hold, of at most ``MOST_PERMUTED`` entities, go to every task once; ranges of the
    permutation numbers are spread over the tasks, and each number brings back one row. Rows and columns of the
    visual table are permuted together. A table whose values do not vary has r NaN and p 1.
    """
    spark = visual.sparkSession
    both = visual.select("a", "b", F.col("d").alias("v")).join(path.select("a", "b", F.col("d").alias("p")), ["a", "b"])
    most = MOST_PERMUTED * (MOST_PERMUTED - 1) // 2
    table = both.limit(most + 1).toPandas().sort_values(["a", "b"])
    keys = sorted({*table["a"], *table["b"]})
    if len(keys) > MOST_PERMUTED or len(table) > most:
        raise ValueError(f"more than {MOST_PERMUTED} entities: reduce the records to groups first")
    at = {k: i for i, k in enumerate(keys)}
    sides = [table[c].map(at).to_numpy(np.int64) for c in ("a", "b")]
    held = Permuted([str(k) for k in keys], *sides, *[table[c].to_numpy(np.float64) for c in ("v", "p")])
    shared = spark.sparkContext.broadcast(held)
    r, rho = held.correlations() if len(table) else (float("nan"), float("nan"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.correlations(shared.value.order(n)) for n in batch["id"]] if len(table_rows) else []
            yield pd.DataFrame(found, columns=["nr", "nrho"], dtype=float)

    table_rows = range(len(table))
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, count // TASK_PERMUTATIONS))
    null = spark.range(1, count + 1, numPartitions=parts).mapInPandas(run, "nr double, nrho double")
    share = lambda c, of: ((F.count_if(F.round(c, 9) >= F.round(F.lit(of), 9)) + 1) / F.lit(count + 1)) if of == of else F.lit(1.0)
    return null.agg(F.lit(r).alias("r"), share("nr", r).alias("p"), F.lit(rho).alias("rho"), share("nrho", rho).alias("rho_p"), F.lit(len(table)).cast("long").alias("pairs"))


def upgma(pairs: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """(step, left, right, height, size): average-linkage merges of a distance table (a, b, d).

    In each round all pairs that are each other's nearest merge at once, by a minimum over the pairs and joins; with
    average linkage that gives the merges of one at a time. Of equal distances the pair first in
    hashed order is the nearer, so that ties do not merge one after another. A cluster is known by its smallest label until the merges are numbered by height; ``left`` and ``right``
    are a label or ``#`` and the step that made the cluster. At most ``most`` entities, as for every distance table.
    """
    keys = durable(pairs.select("a").union(pairs.select("b")).distinct())
    checked(keys, most)
    sizes = keys.select(F.col("a").cast("string").alias("k"), F.lit(1).cast("long").alias("n"))
    near = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "d")
    near = stored(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"))
    sizes, merges = stored(sizes), []
    while not near.isEmpty():
        # Both directions have the one number of their pair.
        both = near.union(near.select("b", "a", "d"))
        order = F.struct("d", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        best = both.groupBy("a").agg(F.min(order).alias("m")).select("a", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"), F.col("m.d").alias("d"))
        mutual = stored(best.groupBy("lo", "hi", "d").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("lo", "hi", "d"))
        of = lambda side, n, sizes=sizes: sizes.select(F.col("k").alias(side), F.col("n").alias(n))
        merges.append(mutual.join(of("lo", "nl"), "lo").join(of("hi", "nr"), "hi").select("lo", "hi", "d", "nl", "nr"))
        named = mutual.select(F.col("hi").alias("k"), F.col("lo").alias("into"))
        into = stored(sizes.join(named, "k", "left").select("k", F.coalesce("into", "k").alias("into"), "n"))
        ends = lambda side, into=into: into.select(F.col("k").alias(side), F.col("into").alias(f"{side}_into"), F.col("n").alias(f"{side}_n"))
        weight = F.col("a_n") * F.col("b_n")
        moved = near.join(ends("a"), "a").join(ends("b"), "b").where("a_into <> b_into")
        near = stored(moved.groupBy(F.least("a_into", "b_into").alias("a"), F.greatest("a_into", "b_into").alias("b")).agg((F.sum(F.col("d") * weight) / F.sum(weight)).alias("d")))
        sizes = stored(into.groupBy(F.col("into").alias("k")).agg(F.sum("n").alias("n")))
    if not merges:
        return keys.where("false").select(*[F.lit(None).cast(t).alias(n) for n, t in (("step", "int"), ("left", "string"), ("right", "string"), ("height", "double"), ("size", "long"))])
    every = stored(reduce(DataFrame.unionByName, merges).withColumn("size", F.col("nl") + F.col("nr")).withColumn("all_", F.lit(1)))
    placed = stored(row_index(every, ["all_"], [F.col("d"), F.col("size"), F.col("lo")]).withColumn("step", F.col("place").cast("int")))
    made = lambda side, n, name: placed.select(F.col("lo").alias(side), F.col("size").alias(n), F.concat(F.lit("#"), F.col("step").cast("string")).alias(name))
    named = placed.drop("size").join(made("lo", "nl", "left"), ["lo", "nl"], "left").join(made("hi", "nr", "right"), ["hi", "nr"], "left")
    return named.select("step", F.coalesce("left", "lo").alias("left"), F.coalesce("right", "hi").alias("right"), F.col("d").alias("height"), (F.col("nl") + F.col("nr")).alias("size"))


def merge_nodes(merges: DataFrame) -> DataFrame:
    """(node, parent, side, label, length, name): the tree of ``upgma`` merges, each branch half the merge's height less its own.

    Merges are numbered by their step; leaves come after them, in the order of their labels.
    """
    child = merges.select("step", F.col("height"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("name")), F.struct(F.lit(1).alias("side"), F.col("right").alias("name")))).alias("c"))
    below = child.select(F.col("step").alias("parent"), "height", "c.side", "c.name")
    own = merges.select(F.concat(F.lit("#"), F.col("step").cast("string")).alias("name"), F.col("step").alias("node"), F.col("height").alias("own"))
    leaf = row_index(below.where("not startswith(name, '#')").withColumn("all_", F.lit(1)), ["all_"], [F.col("name")])
    count = merges.agg(F.count(F.lit(1)).alias("steps"))
    leaves = leaf.join(F.broadcast(count)).select((F.col("steps") + F.col("place")).cast("int").alias("node"), "parent", "side", F.col("name").alias("label"), (F.col("height") / 2).alias("length"))
    inner = own.join(below, "name", "left").select("node", "parent", F.coalesce("side", F.lit(0)).alias("side"), F.lit(None).cast("string").alias("label"), F.coalesce((F.col("height") - F.col("own")) / 2, F.lit(0.0)).alias("length"))
    return leaves.unionByName(inner)


def reordered(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(row, column, d) of a distance table with rows and columns at the ``places`` (label, place) of a leaf order, diagonal included."""
    both = ordered_pairs(pairs).union(places.select("label", "label", F.lit(0.0)))
    left, right = places.select(F.col("label").alias("a"), F.col("place").alias("row")), places.select(F.col("label").alias("b"), F.col("place").alias("column"))
    return both.join(left, "a").join(right, "b").select("row", "column", "d")


def facing_leaves(first: DataFrame, second: DataFrame) -> DataFrame:
    """(label, first, second, same): places of the leaves that two orders (label, place) share, counted among these only."""
    both = durable(first.select("label", F.col("place").alias("p")).join(second.select("label", F.col("place").alias("q")), "label").withColumn("all_", F.lit(1)))
    one = row_index(both, ["all_"], [F.col("p")]).select("label", F.col("place").cast("int").alias("first"))
    two = row_index(both, ["all_"], [F.col("q")]).select("label", F.col("place").cast("int").alias("second"))
    return one.join(two, "label").select("label", "first", "second", (F.col("first") == F.col("second")).alias("same"))
