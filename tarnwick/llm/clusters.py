"""Similarity clusters by parallel pivot correlation clustering.

In each round every row still free goes into the buckets of a locality-sensitive hash with fresh seeds, and the
row first in hashed order leads each bucket. Rows are compared with the leaders of their buckets only. A leader
that no similar leader precedes is a pivot and takes the free rows similar to it; the others wait for the next
round. When no row is free, pivots that are alike are merged the same way under more hash tables, and every
member moves to the closest pivot it meets. The comparisons grow with the rows, not with the pairs in a cluster.

A row is hashed in every order of blocks that its shares allow; orders that give the same values, as those of empty
blocks do, give one row a table, and rows of the same values are hashed once. The bits of a bucket grow with the
logarithm of the rows, and the tables with the bits, so that two rows at the radius meet with the same chance at
every size. Partners of a bucket or a pivot that has more than ``HOT_ROWS`` of them are spread over parts by that
number.

Defined cases: rows whose array in either field is null, of the wrong length or holds null or non-finite values
take no part; an id sent several times counts once; equal distances go to the smaller pivot id; rows alike to no
other row form clusters of one; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.vectors import matrix
from tarnwick.session import durable

#: Rows of one bucket or pivot that one part joins.
HOT_ROWS = 50_000
#: Width of a cell of the hash in radii.
CELL = 1.2
BLOCKS = 5
#: Places of hues among the 26 values: five colour blocks of hue, saturation, value, five shares, back and belly.
HUES = [0, 3, 6, 9, 12, 20, 23]
WIDTH = 26


@cache
def _orders(pattern: int, share_gap_blocks: int = BLOCKS) -> list[list[int]]:
    """Orders of the blocks if neighbours k, k+1 may change places where bit k of ``pattern`` is set."""
    runs = [[0]]
    for k in range(1, share_gap_blocks):
        if pattern >> (k - 1) & 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    return [[b for run in chosen for b in run] for chosen in itertools.product(*[[list(p) for p in itertools.permutations(run)] for run in runs])]


def _columns(order: list[int]) -> list[int]:
    return [3 * b + i for b in order for i in range(3)] + [15 + b for b in order] + list(range(20, WIDTH))


def _patterns(rows: np.ndarray, share_gap: float) -> np.ndarray:
    close = np.abs(np.diff(rows[:, 15:20], axis=1)) < share_gap
    return close @ (1 << np.arange(BLOCKS - 1))


def variants(rows: np.ndarray, share_gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) in every order that near-equal shares of neighbouring blocks allow."""
    patterns, at, out = _patterns(rows, share_gap), [], []
    for pattern in np.unique(patterns):
        own = np.flatnonzero(patterns == pattern)
        for order in _orders(int(pattern)):
            moved = rows[own][:, _columns(order)]
            # An order that leaves a row as it is adds nothing.
            new = np.ones(len(own), bool) if order == sorted(order) else (moved != rows[own]).any(axis=1)
            at.append(own[new])
            out.append(moved[new])
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, int), rows)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    turn = np.abs(gap[:, HUES]) % 1.0
    gap[:, HUES] = np.minimum(turn, 1.0 - turn)
    return (gap**2).sum(axis=1)


def distances(a: np.ndarray, b: np.ndarray, share_gap: float) -> np.ndarray:
    """Distance of each pair of rows, hues the short way round, near-equal blocks of either row in the order that fits."""
    best = _apart(a, b)
    for rows, others in ((a, b), (b, a)):
        patterns = _patterns(rows, share_gap)
        for pattern in np.unique(patterns[patterns > 0]):
            own = np.flatnonzero(patterns == pattern)
            for order in _orders(int(pattern)):
                best[own] = np.minimum(best[own], _apart(rows[own][:, _columns(order)], others[own]))
    return np.sqrt(best)


def aligned(a: np.ndarray, b: np.ndarray, share_gap: float) -> np.ndarray:
    """Rows of ``a`` in the order of blocks that fits ``b`` best, of those that near-equal shares of either row allow."""
    out, best = a.copy(), _apart(a, b)
    for rows, back in ((a, False), (b, True)):
        patterns = _patterns(rows, share_gap)
        for pattern in np.unique(patterns[patterns > 0]):
            own = np.flatnonzero(patterns == pattern)
            for order in _orders(int(pattern)):
                # An order of ``b`` is undone on ``a``.
                moved = a[own][:, _columns(np.argsort(order).tolist() if back else order)]
                apart = _apart(moved, b[own])
                closer = apart < best[own]
                out[own[closer]], best[own[closer]] = moved[closer], apart[closer]
    return out


def _embed(rows: np.ndarray) -> np.ndarray:
    """Hues on a circle of circumference one, so no distance grows."""
    plain = [i for i in range(WIDTH) if i not in HUES]
    turn = 2 * np.pi * rows[:, HUES]
    return np.hstack([rows[:, plain], np.cos(turn) / (2 * np.pi), np.sin(turn) / (2 * np.pi)])


def tables_for(bits: int, chance: float) -> int:
    """Hash tables of ``bits`` directions in which two rows at the radius meet at least once with ``chance``."""
    one = (1 - math.sqrt(2 / math.pi) / (CELL * math.sqrt(WIDTH + len(HUES)))) ** bits
    return math.ceil(math.log(1 - chance) / math.log(1 - one))


def _orderless(rows: np.ndarray) -> np.ndarray:
    """As ``_embed``, with each value sorted over the colour blocks: no further apart than in any order of the blocks."""
    placed = _embed(rows)
    plain, turns = WIDTH - len(HUES), len(HUES)
    for columns in (range(0, 10, 2), range(1, 10, 2), range(10, 15), range(plain, plain + BLOCKS), range(plain + turns, plain + turns + BLOCKS)):
        placed[:, columns] = np.sort(placed[:, columns], axis=1)
    return placed


def _centre(means: np.ndarray) -> np.ndarray:
    """Rows of the 26 values whose place on the circles is that of ``means``."""
    out = np.zeros((len(means), WIDTH))
    plain, turns = WIDTH - len(HUES), len(HUES)
    out[:, [i for i in range(WIDTH) if i not in HUES]] = means[:, :plain]
    out[:, HUES] = np.arctan2(means[:, plain + turns :], means[:, plain : plain + turns]) / (2 * np.pi) % 1.0
    return out


def buckets(rows: np.ndarray, seed: int, tables: int, bits: int, width: float) -> np.ndarray:
    """Bucket of each row in each table: cells of ``bits`` random directions, ``width`` wide."""
    rng = np.random.default_rng(seed)
    placed = _embed(rows)
    found = np.zeros((len(rows), tables), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(tables):
            to = rng.normal(size=(placed.shape[1], bits))
            cell = np.floor(placed @ (to / np.linalg.norm(to, axis=0)) / width + rng.random(bits)).astype(np.int64).astype(np.uint64)
            mixed = np.full(len(rows), t + 1, np.uint64)
            for b in range(bits):
                mixed = (mixed ^ cell[:, b]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            found[:, t] = mixed
    return found.view(np.int64)


def points(rows: DataFrame, id_column: str, colours: str, sides: str) -> DataFrame:
    """(id, x): the 26 compared values of each sound row, packed as they are, once for each id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left = matrix(batch.column(1), 20)
            also, right = matrix(batch.column(2), 9)
            both, i, j = np.intersect1d(at, also, return_indices=True)
            x = np.hstack([left[i], right[j, :6]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both)), _packed(x)], ["id", "x"])

    plain = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), colours, sides)
    return plain.mapInArrow(run, "id long, x binary").groupBy("id").agg(F.min("x").alias("x"))


#: Decimals up to which values are packed as whole numbers, where that loses nothing.
SCALE = 1e6


def _packed(x: np.ndarray) -> pa.Array:
    """Each row as whole millionths in four bytes if all its values are exactly such, else as doubles."""
    x = np.ascontiguousarray(x, np.float64)
    small = np.clip(np.round(x * SCALE), -(2**31), 2**31 - 1)
    exact = ((small / SCALE == x) & ~(np.signbit(x) & (x == 0))).all(axis=1)
    cells = np.zeros((len(x), 8 * WIDTH), np.uint8)
    cells[exact, : 4 * WIDTH] = small[exact].astype(np.int32).view(np.uint8)
    cells[~exact] = x[~exact].view(np.uint8)
    size = np.where(exact, 4 * WIDTH, 8 * WIDTH)
    kept = np.arange(8 * WIDTH) < size[:, None]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(cells[kept])])


def _unpacked(column: pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    short = np.fromiter((len(p) == 4 * WIDTH for p in parts), bool, len(parts))
    x = np.empty((len(parts), WIDTH))
    x[short] = np.frombuffer(b"".join(p for p, s in zip(parts, short) if s), np.int32).reshape(-1, WIDTH) / SCALE
    x[~short] = np.frombuffer(b"".join(p for p, s in zip(parts, short) if not s), np.float64).reshape(-1, WIDTH)
    return x


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _order(column: str) -> Column:
    """Hashed order of the rows."""
    return F.struct(F.xxhash64(F.col(column)).alias("h"), F.col(column).alias("id"))


def _in_buckets(rows: DataFrame, hashes: Callable[[np.ndarray], np.ndarray], share_gap: float) -> DataFrame:
    """(id, bucket), each pair once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, which = np.unique(_unpacked(batch.column(1)), axis=0, return_inverse=True)
            at, every = variants(x, share_gap)
            found = hashes(every)
            pairs = np.unique(np.stack([np.repeat(at, found.shape[1]), found.ravel()], axis=1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(x) + 1))
            size = np.diff(first)[which]
            take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[which], size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(pairs[take, 1])], ["id", "bucket"])

    return rows.select("id", "x").mapInArrow(run, "id long, bucket long")


def _spread(rows: DataFrame, few: DataFrame, key: str, load: DataFrame, most: float = math.inf) -> DataFrame:
    """``rows`` (with ``id``) joined with ``few`` on ``key``; the rows of a hot key go to parts, each with its own copy of ``few``.

    ``load`` (key, n) tells the rows of each key. Keys with more than ``HOT_ROWS`` are at most the rows over that
    number, so their list is small beside the rows; there are none if no key can have more than ``most`` rows.
    """
    if most <= HOT_ROWS:
        return rows.join(few, key)
    hot = F.broadcast(load.where(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    right = few.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [key, "salt"]).drop("salt")


def _compare(pairs: DataFrame, rows: DataFrame, others: DataFrame, load: DataFrame, radius: float, share_gap: float, most: float = math.inf) -> DataFrame:
    """(id, other, distance) of the pairs closer than ``radius``; ``load`` (other, n) tells the pairs of each ``other``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = distances(_unpacked(batch.column(2)), _unpacked(batch.column(3)), share_gap)
            close = pa.array(np.flatnonzero(apart < radius))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(close), batch.column(1).take(close), pa.array(apart).take(close)], ["id", "other", "distance"])

    theirs = others.select(F.col("id").alias("other"), F.col("x").alias("y"))
    full = _spread(pairs.join(rows.select("id", "x"), "id"), theirs, "other", load, most).select("id", "other", "x", "y")
    return full.mapInArrow(run, "id long, other long, distance double")


def _within_two(pairs: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """The pairs (own, other) of pivots that may both be closer than ``radius`` to one row, whatever orders its blocks allow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _orderless(_unpacked(batch.column(2))) - _orderless(_unpacked(batch.column(3)))
            near = pa.array(np.flatnonzero((gap**2).sum(axis=1) < (2 * radius) ** 2))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near)], ["own", "other"])

    of = lambda name, x: centres.select(F.col("id").alias(name), F.col("x").alias(x))
    return pairs.join(of("own", "x"), "own").join(of("other", "y"), "other").select("own", "other", "x", "y").mapInArrow(run, "own long, other long")


def _round(free: DataFrame, count: int, radius: float, share_gap: float, seed: int, tables: int, bits: int) -> DataFrame:
    """(id, pivot) of the rows that one round settles."""
    placed = durable(_in_buckets(free, lambda x: buckets(x, seed, tables, bits, CELL * radius), share_gap))
    leaders = durable(placed.groupBy("bucket").agg(F.min(_order("id"))["id"].alias("other"), F.count(F.lit(1)).alias("n")))
    heads = durable(leaders.select(F.col("other").alias("id")).distinct().join(free, "id"))
    shared = leaders.where("n > 1")
    met = _spread(placed, shared.select("bucket", "other"), "bucket", shared, count).where("id <> other").select("id", "other").distinct()
    close = durable(_compare(met, free, heads, shared.groupBy("other").agg(F.sum("n").alias("n")), radius, share_gap, count))
    # The leader of a bucket comes before all its rows, so a row close to a leader is preceded by it.
    pivots = heads.join(close.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("other"))
    taken = close.join(pivots, "other").groupBy("id").agg(F.min(_order("other"))["id"].alias("pivot"))
    return durable(taken.join(pivots.select(F.col("other").alias("id")), "id", "left_anti").union(pivots.select("other", "other")))


def _settle(rows: DataFrame, radius: float, share_gap: float, seed: int, tables: int, bits: int) -> DataFrame:
    """(id, pivot) of all rows. The first free row in hashed order becomes a pivot in each round, so the rounds end."""
    free, settled = rows, []
    while count := free.count():
        settled.append(_round(free, count, radius, share_gap, seed + len(settled), tables, bits))
        free = durable(free.join(settled[-1].select("id"), "id", "left_anti"))
    return reduce(DataFrame.union, settled) if settled else rows.select("id", F.col("id").alias("pivot"))


def cluster(rows: DataFrame, radius: float, share_gap: float, tables: int = 4, chance: float = 0.99, choice_chance: float = 0.9) -> DataFrame:
    """(id, pivot) of each row of ``points``; rows of one cluster share the pivot.

    Pivots that are alike meet with ``chance`` in each round that merges them, and are merged until no pair is found
    any more; a member and another pivot as close as its own meet with ``choice_chance``.
    """
    bits = max(4, round(math.log(max(2, rows.count())) / 1.2))
    first = durable(_settle(rows, radius, share_gap, 1, tables, bits))
    told, count, seed = first.select("id", F.col("pivot").alias("other")), -1, 1001
    while True:
        centres = durable(rows.join(told.select(F.col("other").alias("id")).distinct(), "id"))
        if (left := centres.count()) == count:
            break
        merged = _settle(centres, radius, share_gap, seed, tables_for(bits + 3, chance), bits + 3)
        told = durable(told.join(merged.select(F.col("id").alias("other"), F.col("pivot").alias("top")), "other").select("id", F.col("top").alias("other")))
        count, seed = left, seed + 1_000
    hashes = lambda x: buckets(x, 1, tables_for(bits + 6, choice_chance), bits + 6, CELL * radius)
    near = durable(_in_buckets(centres, hashes, share_gap).select("bucket", F.col("id").alias("other")))
    placed = _in_buckets(rows, hashes, share_gap).join(near.select("bucket").distinct(), "bucket", "left_semi")
    seen = placed.join(near, "bucket").where("id <> other").select("id", "other").distinct()
    # Only members that meet another pivot than their own have a choice, and only if the two are within two radii.
    met = durable(seen.join(told.select("id", F.col("other").alias("own")), "id").where("own <> other and own <> id"))
    rival = durable(met.join(_within_two(met.select("own", "other").distinct(), centres, radius), ["own", "other"], "left_semi").select("id", "other"))
    choice = durable(rival.union(told.join(rival.select("id").distinct(), "id", "left_semi")))
    close = _compare(choice, rows, centres, choice.groupBy("other").agg(F.count(F.lit(1)).alias("n")), radius, share_gap)
    best = close.groupBy("id").agg(F.min(F.struct("distance", "other"))["other"].alias("best"))
    return told.join(best, "id", "left").select("id", F.coalesce("best", "other").alias("pivot"))


def members(clustered: DataFrame, least: int) -> DataFrame:
    """(id, cluster_id, pivot) of the clusters with at least ``least`` rows; a cluster is named by its smallest id."""
    named = clustered.groupBy("pivot").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return clustered.join(named.select("pivot", "cluster_id"), "pivot").select("id", "cluster_id", "pivot")


def describe(rows: DataFrame, grouped: DataFrame, typical: int, share_gap: float = 0.002) -> DataFrame:
    """(cluster_id, size, medoid, typical): each cluster's medoid and its ``typical`` most typical members.

    The medoid is the member with the least sum of squared distances to all members; that is the one closest to
    the centre, so no pairs are compared. Every member comes into the order of blocks that fits its pivot best; the centre is the mean of the members in
    that order, with hues on a circle, and members are ranked by ``distances`` to it, as the clusters are made.
    Spark keeps the first members of each map task before the shuffle, so a large cluster sends few rows.
    """

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = aligned(_unpacked(batch.column(2)), _unpacked(batch.column(3)), share_gap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(x), _lists(_embed(x))], ["id", "cluster_id", "x", "e"])

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = np.array(batch.column(4).to_pylist(), np.float64).reshape(-1, WIDTH + len(HUES))
            gap = np.round(distances(_unpacked(batch.column(3)), _centre(means), share_gap), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(gap)], ["id", "cluster_id", "size", "gap"])

    size = WIDTH + len(HUES)
    pivots = rows.join(grouped.select(F.col("pivot").alias("id")).distinct(), "id").select(F.col("id").alias("pivot"), F.col("x").alias("y"))
    beside = _spread(rows.join(grouped, "id"), pivots, "pivot", grouped.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))).select("id", "cluster_id", "x", "y")
    placed = durable(beside.mapInArrow(align, "id long, cluster_id long, x binary, e array<double>"))
    means = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.avg(F.col("e")[i]) for i in range(size)]).alias("mean"))
    means = durable(means)
    ranks = _spread(placed.drop("e"), means, "cluster_id", means.select("cluster_id", F.col("size").alias("n"))).select("id", "cluster_id", "size", "x", "mean")
    gaps = ranks.mapInArrow(rank, "id long, cluster_id long, size long, gap double")
    ranked = gaps.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("gap", "id"))).where(F.col("rank") <= typical)
    lists = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return ranked.groupBy("cluster_id", "size").agg(F.transform(lists, lambda s: s["id"]).alias("typical")).select("cluster_id", "size", F.col("typical")[0].alias("medoid"), "typical")
