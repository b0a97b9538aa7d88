"""Most similar vectors for every query vector: multi-index hashing over learned rotated codes.

Fitting, on a bounded sample: coarse cells (k-means), and in each cell a rotation onto the principal axes of the
residuals with thresholds along each axis, more of them where the cell is wide. A row's code in its cell is a bit for
each threshold passed, so the Hamming distance follows the distance along the rotated axes.

Index: every row, under (cell, substring number, substring) for eight substrings. Probing: a query is coded in its
nearest cells and looks up every substring within ``flips`` bits. By the pigeonhole principle that retrieves every
code within Hamming radius 8 (flips + 1) - 1; all codes within the radius are reranked by the stored floats.
Queries left with fewer than k rows probe wider, in the end every cell whole, so no row is out of reach.

``layout`` sets the numbers by the count of rows: about a thousand rows a cell as far as the sample can tell cells
apart, from there on a bit more in each substring for each doubling, probed within two bits; so the rows under a
substring stay about the same.

Defined cases: rows and queries whose array is null, of the wrong length or holds null or non-finite values take no
part; an id sent several times counts once; equal distances go to the smaller id; queries with fewer than k other
rows get those there are; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import durable

SUBSTRINGS = 8
#: Bits of a substring at most: a code is two numbers of four substrings each.
LANE = 16
#: Rows a cell, and rows of the sample for each cell that is learned.
CELL_ROWS, CELL_SAMPLE = 1_000, 160
#: Rows that the fit takes at least and at most.
SAMPLE_ROWS = (20_000, 200_000)


@dataclass(frozen=True)
class Layout:
    """Numbers of an index: sampled rows, cells, cells probed, bits of a substring, bits probed."""

    sample: int
    cells: int
    probed: int
    bits: int
    flips: int

    @property
    def radius(self) -> int:
        return SUBSTRINGS * (self.flips + 1) - 1


def layout(rows: int) -> Layout:
    cells = max(1, min(rows // CELL_ROWS, SAMPLE_ROWS[1] // CELL_SAMPLE))
    crowd = max(0, round(math.log2(max(1, rows / cells / CELL_ROWS))))
    sample = min(SAMPLE_ROWS[1], max(SAMPLE_ROWS[0], cells * CELL_SAMPLE))
    return Layout(sample, cells, max(4, round(4 * math.sqrt(cells / 125))), min(LANE, 8 + crowd), 2 if crowd else 1)


def matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows) of the lists that hold ``width`` finite numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    sound = np.flatnonzero((np.diff(offsets) == width) & lists.is_valid().to_numpy(zero_copy_only=False))
    flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat[offsets[sound][:, None] + np.arange(width)] if len(sound) else np.zeros((0, width))
    finite = np.isfinite(rows).all(axis=1)
    return sound[finite], rows[finite]


class Codes:
    """Cells, rotations and thresholds learned from a sample of rows."""

    def __init__(self, sample: np.ndarray, cells: int, sub_bits: int = 8, rounds: int = 10, seed: int = 0) -> None:
        self.sub_bits = sub_bits
        rng = np.random.default_rng(seed)
        n, width = sample.shape
        sample = sample[np.lexsort(sample.T)]  # whatever order the rows arrived in
        cells = max(1, min(cells, n // CELL_SAMPLE))
        self.centres = sample[rng.choice(n, cells, replace=False)].copy() if n else np.zeros((1, width))
        for _ in range(rounds):
            home = self.nearest(sample, 1)[:, 0]
            for cell in range(cells):
                if (home == cell).any():
                    self.centres[cell] = sample[home == cell].mean(axis=0)
        home = self.nearest(sample, 1)[:, 0]
        rest = sample - self.centres[home]
        pooled = self._learn(rest)
        self.turn, self.axis, self.cut = [], [], []
        for cell in range(len(self.centres)):
            own = rest[home == cell]
            for to, part in zip((self.turn, self.axis, self.cut), self._learn(own) if len(own) > 2 * width else pooled):
                to.append(part)
        self.turn, self.axis, self.cut = map(np.array, (self.turn, self.axis, self.cut))

    def _learn(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotation, and axis and cut of each bit; an axis has bits in proportion to its spread."""
        width = rest.shape[1]
        turn = np.linalg.svd(rest, full_matrices=False)[2].T if len(rest) >= width else np.eye(width)
        spread = (rest @ turn).std(axis=0) + 1e-12 if len(rest) else np.ones(width)
        total = SUBSTRINGS * self.sub_bits
        share = spread / spread.sum() * total
        bits = np.floor(share).astype(int)
        bits[np.argsort(bits - share, kind="stable")[: total - bits.sum()]] += 1
        axis = np.repeat(np.arange(width), bits)
        cut = np.concatenate([np.linspace(-2.2, 2.2, b + 2)[1:-1] * s for b, s in zip(bits, spread)])
        return turn, axis, cut

    def nearest(self, rows: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` closest cells of each row, the closest first."""
        found = [np.zeros((0, count), np.int64)]
        for begin in range(0, len(rows), 4_096):
            apart = (self.centres**2).sum(axis=1) - 2 * rows[begin : begin + 4_096] @ self.centres.T
            found.append(apart.argmin(axis=1)[:, None] if count == 1 else np.argsort(apart, axis=1, kind="stable")[:, :count])
        return np.concatenate(found)

    def encode(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Code of each row in its given cell, two signed numbers with a substring in each lane of 16 bits."""
        codes = np.zeros((len(rows), 2), np.int64)
        # Neighbouring thresholds of an axis fall into different substrings.
        order = np.arange(SUBSTRINGS * self.sub_bits).reshape(self.sub_bits, SUBSTRINGS).T.ravel()
        for cell in np.unique(cells):
            at = np.flatnonzero(cells == cell)
            passed = ((rows[at] - self.centres[cell]) @ self.turn[cell])[:, self.axis[cell]] > self.cut[cell]
            lanes = np.zeros((len(at), SUBSTRINGS, LANE), bool)
            lanes[:, :, : self.sub_bits] = passed[:, order].reshape(len(at), SUBSTRINGS, self.sub_bits)
            codes[at] = np.packbits(lanes.reshape(len(at), -1), axis=1, bitorder="little").view(np.int64)
        return codes


def fit(rows: DataFrame, id_column: str, column: str, width: int, plan: Layout, count: int) -> Codes:
    """Codes learned from about ``plan.sample`` rows, the first in the order of a hash of the id: the sample, not the corpus, reaches the driver."""
    share = min(1.0, 1.5 * plan.sample / max(1, count))
    mark = F.pmod(F.xxhash64(id_column), F.lit(1 << 30))
    picked = rows.where(mark < int(share * (1 << 30))).orderBy(mark, id_column).limit(plan.sample).select(column).toArrow()
    return Codes(matrix(picked.column(0), width)[1], plan.cells, plan.bits)


def _coded(rows: DataFrame, id_column: str, column: str, width: int, model, cells: int) -> DataFrame:
    """(id, cell, low, high) of each sound row in its nearest ``cells`` cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(1), width)
            near = model.value.nearest(values, cells)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[at], near.shape[1])
            home = near.ravel()
            codes = model.value.encode(np.repeat(values, near.shape[1], axis=0), home)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(home, pa.int32()), pa.array(codes[:, 0]), pa.array(codes[:, 1])], ["id", "cell", "low", "high"])

    plain = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    return plain.mapInArrow(run, "id long, cell int, low long, high long")


def _in_parts(codes: DataFrame) -> DataFrame:
    """Each code eight times, with the number of a substring (``part``) and the substring (``sub``)."""
    parted = codes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SUBSTRINGS - 1))))
    lane = f"shiftright(if(part < 4, low, high), {LANE} * (part % 4)) & {2**LANE - 1}"
    return parted.withColumn("sub", F.expr(lane).cast("int"))


def _sound(column: str, width: int) -> Column:
    v = F.col(column)
    return F.coalesce((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, id_column: str, column: str, width: int, k: int, wider: tuple[int, ...] = (32, 0), plan: Layout | None = None) -> DataFrame:
    """(query, id, distance): for each id of ``queries`` (column ``id``) its k nearest other rows by Euclidean distance.

    ``wider`` are the cells that queries short of k rows take whole, one after another; 0 stands for all of them.
    """
    spark, rows = rows.sparkSession, rows.select(F.col(f"`{id_column}`").alias("rid"), F.col(f"`{column}`").alias("vector"))
    id_column, column = "rid", "vector"
    count = rows.count()
    plan = plan or layout(count)
    codes = fit(rows, id_column, column, width, plan, count)
    model = spark.sparkContext.broadcast(codes)
    stored = _coded(rows, id_column, column, width, model, 1)
    asked = rows.where(F.col(id_column).isNotNull() & _sound(column, width)).join(queries.select(F.col("id").alias(id_column)).distinct(), id_column, "left_semi").dropDuplicates([id_column])
    asked = durable(asked.select(id_column, column))
    vectors = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    query_vectors = asked.select(F.col(id_column).cast("long").alias("query"), F.col(column).alias("q"))

    def rerank(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (_, q), (_, v) = matrix(batch.column(2), width), matrix(batch.column(3), width)
                distance = np.sqrt(((q - v) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance)], ["query", "id", "distance"])

        full = pairs.join(vectors, "id").join(query_vectors, "query").select("query", "id", "q", "v")
        best = full.mapInArrow(run, "query long, id long, distance double").groupBy("query", "id").agg(F.min("distance").alias("distance"))
        return _first_k(best, k)

    index = _in_parts(stored)
    masks = [sum(1 << b for b in chosen) for n in range(plan.flips + 1) for chosen in itertools.combinations(range(plan.bits), n)]
    near = _coded(asked, id_column, column, width, model, min(plan.probed, len(codes.centres)))
    probes = (
        _in_parts(near.withColumnRenamed("id", "query"))
        .withColumn("flip", F.explode(F.array(*map(F.lit, masks))))
        .select("query", "cell", F.col("low").alias("qlow"), F.col("high").alias("qhigh"), "part", F.col("sub").bitwiseXOR(F.col("flip")).alias("sub"))
    )
    apart = F.bit_count(F.col("qlow").bitwiseXOR(F.col("low"))) + F.bit_count(F.col("qhigh").bitwiseXOR(F.col("high")))
    met = probes.join(index, ["cell", "part", "sub"]).where((F.col("query") != F.col("id")) & (apart <= plan.radius))
    found = [durable(rerank(met.select("query", "id").distinct()))]
    for cells in wider:
        done = reduce(DataFrame.unionByName, found).groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        left = asked.join(done.select(F.col("query").alias(id_column)), id_column, "left_anti")
        if left.isEmpty():
            break
        whole = _coded(left, id_column, column, width, model, min(cells, len(codes.centres)) or len(codes.centres)).select(F.col("id").alias("query"), "cell")
        found.append(durable(rerank(whole.join(stored.select("id", "cell"), "cell").where("query <> id").select("query", "id").distinct())))
    return _first_k(reduce(DataFrame.unionByName, found).distinct(), k)


def _first_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k closest of each query; Spark keeps k rows of a query in each map task before the shuffle."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "id", "distance")
