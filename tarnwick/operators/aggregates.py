"""Aggregates: counts by status, vectors by place, histograms, regions and segmentation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.numeric import ratio


def long_form(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pos, v): one row for each value of an array, places from zero."""
    return rows.select(*keys, F.posexplode(vector).alias("pos", "v"))


def mean_vector(rows: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """(group, n, mean): the element-wise mean of arrays of one size, without exploding them."""
    sums = [F.avg(F.col(vector)[i]) for i in range(size)]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("mean"))


def density_histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: str) -> DataFrame:
    """(by, bin, n, density): equal bins, the last one closed, empty bins kept, values outside left out."""
    width = (high - low) / bins
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high))
    counted = inside.groupBy(by, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(by).agg(F.sum("n").alias("total"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counted, [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(by, "bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def region_means(pixels: DataFrame, image: str, y: str, channels: list[str]) -> DataFrame:
    """Means of the upper and lower half of each image's rows and their difference; an empty half counts as zero."""
    spans = pixels.groupBy(image).agg(F.floor((F.min(y) + F.max(y)) / 2).alias("mid"))
    halves = pixels.join(spans, image)
    upper = lambda c, is_up: F.coalesce(F.avg(F.when((F.col(y) < F.col("mid")) == is_up, F.col(c))), F.lit(0.0))
    parts = [x for c in channels for x in (upper(c, True).alias(f"up_{c}"), upper(c, False).alias(f"low_{c}"))]
    means = halves.groupBy(image).agg(*parts)
    return means.select("*", *[(F.col(f"up_{c}") - F.col(f"low_{c}")).alias(f"diff_{c}") for c in channels])


def confusion(rows: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn of each key."""
    return rows.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    )


def measures(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, f1 and iou beside the counts; zero where a denominator is."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    named = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "iou": ratio(tp, tp + fp + fn)}
    return counts.withColumns({k: F.round(v, digits) for k, v in named.items()})


def macro(measured: DataFrame, names: list[str]) -> DataFrame:
    """Means of the rounded measures over all rows."""
    return measured.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(n) for n in names])


def micro(counts: DataFrame) -> DataFrame:
    """Measures of the pooled counts; f1 from the rounded precision and recall."""
    pooled = measures(counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))
    return pooled.withColumn("f1", F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 4))


def average_precision_at(rows: DataFrame, key: str, iou: str) -> DataFrame:
    """(key, ap): the share of rows with iou at or above each of 0.50, 0.55 ... 0.95, averaged; null iou counts as zero."""
    steps = F.transform(F.sequence(F.lit(10), F.lit(19)), lambda k: F.when(F.coalesce(F.col(iou), F.lit(0.0)) >= k / 20, 1.0).otherwise(0.0))
    return rows.groupBy(key).agg(F.avg(F.aggregate(steps, F.lit(0.0), lambda t, v: t + v) / 10).alias("ap"))


def bounding_box(pixels: DataFrame, image: str, x: str, y: str, inside: Column) -> DataFrame:
    """(image, box, area, fraction) of the pixels inside; box is x, y, width, height, null where none is inside."""
    lows = [F.min(F.when(inside, F.col(c))) for c in (x, y)]
    highs = [F.max(F.when(inside, F.col(c))) for c in (x, y)]
    box = F.when(lows[0].isNotNull(), F.array(*lows, highs[0] - lows[0], highs[1] - lows[1]))
    return pixels.groupBy(image).agg(box.alias("box"), F.count_if(inside).alias("area"), (F.count_if(inside) / F.count(F.lit(1))).alias("fraction"))
