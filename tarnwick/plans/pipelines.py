"""Whole runs: images to a feature table, features and a tree to statistics, predictions to measures.

Every command-line choice of such a run is a parameter here: which files, the size, thresholds, the number of
permutations, a dry run (the listing that comes before the work), a single image (a filter on the listing).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.text import clean_filename, parent, stem
from tarnwick.operators import aggregates, images, matrix, trees
from tarnwick.session import durable
from tarnwick.sources import readers

GROUPS = {"hue_hist": 18, "sat_hist": 8, "val_hist": 8, "dom_colours": 20, "dorsal_ventral": 9, "gabor": 24, "lbp": 10, "entropy": 2}
LEAST_PIXELS = 500


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit hue (half degrees), saturation and value of red, green and blue in the last axis."""
    r, g, b = np.moveaxis(rgb.astype(float), -1, 0)
    high, span = rgb.max(axis=-1).astype(float), np.ptp(rgb.astype(float), axis=-1)
    safe = np.where(span > 0, span, 1.0)
    turn = np.where(high == r, (g - b) / safe, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 30
    hue = np.where(span > 0, np.round(turn) % 180, 0.0)
    return np.stack([hue, np.where(high > 0, np.round(span * 255 / np.where(high > 0, high, 1.0)), 0.0), high], axis=-1)


def dominant(pixels: np.ndarray, count: int = 5, rounds: int = 50) -> np.ndarray:
    """Centres of ``count`` clusters of normalised colours, most frequent first, then their shares; starts are spread along the value axis."""
    pixels = pixels / [180, 255, 255]
    spread = np.linspace(0, len(pixels) - 1, count).round().astype(int)
    centres = pixels[np.lexsort(pixels.T)][spread].astype(float)
    for _ in range(rounds):
        home = ((pixels[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([pixels[home == k].mean(axis=0) if (home == k).any() else centres[k] for k in range(count)])
        if np.allclose(moved, centres):
            break
        centres = moved
    shares = np.bincount(home, minlength=count) / len(pixels)
    order = np.argsort(-shares, kind="stable")
    return np.concatenate([centres[order].ravel(), shares[order]])


def _entropy(histogram: np.ndarray) -> float:
    p = histogram / (histogram.sum() + 1e-8) + 1e-8
    p = p / p.sum()
    return float(-(p * np.log(p)).sum())


def describe_image(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray | None:
    """The 99 features of the pixels inside a mask, groups in the order of ``GROUPS``; null below the least size."""
    if mask.shape != rgb.shape[:2]:
        mask = images.resized_nearest(mask, *rgb.shape[:2])
    if mask.sum() < LEAST_PIXELS:
        return None
    hsv = to_hsv(rgb)
    inside = hsv[mask]
    density = lambda v, n, top: np.histogram(v, bins=n, range=(0, top), density=True)[0]
    hue = density(inside[:, 0], 18, 180)
    rows = np.flatnonzero(mask.any(axis=1))
    upper = np.arange(mask.shape[0]) < (rows[0] + rows[-1]) // 2
    mean = lambda part: hsv[part].mean(axis=0) / [180, 255, 255] if part.any() else np.zeros(3)
    back, belly = mean(mask & upper[:, None]), mean(mask & ~upper[:, None])
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    patterns = np.bincount(images.uniform_lbp(np.floor(grey))[mask], minlength=10) / mask.sum()
    parts = [hue, density(inside[:, 1], 8, 256), density(inside[:, 2], 8, 256), dominant(inside), back, belly, back - belly, images.gabor_energy(grey / 255, mask), patterns, [_entropy(hue), _entropy(patterns)]]
    values = np.round(np.concatenate([np.asarray(p, float) for p in parts]), 6)
    return np.where(np.isfinite(values), values, 0.0)


def image_listing(spark: SparkSession, image_path: str, mask_path: str) -> DataFrame:
    """(path, mask, genus, name): each image with its mask of the same name, null if there is none; the dry run."""
    name = lambda c: F.regexp_replace(stem(F.col(c)), "_mask$", "")
    pictures = readers.image_files(spark, image_path).select("path", "genus", name("path").alias("name"))
    masks = readers.image_files(spark, mask_path).groupBy(name("path").alias("name")).agg(F.min("path").alias("mask"))
    return pictures.join(masks, "name", "left").select("path", "mask", "genus", clean_filename(F.col("name")).alias("name"))


def extract_features(spark: SparkSession, image_path: str, mask_path: str) -> DataFrame:
    """(genus, name, status, mask_area_frac, n_pixels, f): one row an image; status OK, FAILED (too small) or NO_MASK.

    Image and mask travel as the two rows' bytes to one task; nothing is gathered beyond one pair.
    """

    def raster(row, channels: bool) -> np.ndarray:
        shape = (row["height"], row["width"], row["nChannels"])
        data = np.frombuffer(row["data"], np.uint8).reshape(shape)
        if channels:
            return data[..., [2, 1, 0]] if shape[2] >= 3 else data[..., :1].repeat(3, axis=2)
        # A mask of several channels counts by its luminance; equal channels have that of each.
        return (data[..., :3].astype(np.int64) @ [7471, 38470, 19595] + 32768) >> 16 if shape[2] >= 3 else data[..., 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                if r["mask"] is None:
                    rows.append((r["genus"], r["name"], "NO_MASK", None, None, None))
                    continue
                rgb, mask = raster(r["image"], True), raster(r["mask"], False) > 127
                f = describe_image(rgb, mask)
                rows.append((r["genus"], r["name"], "OK" if f is not None else "FAILED", float(mask.mean()), int(mask.sum()), None if f is None else f.tolist()))
            yield pd.DataFrame(rows, columns=["genus", "name", "status", "mask_area_frac", "n_pixels", "f"])

    picture = lambda path: spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image")
    name = lambda c: F.regexp_replace(stem(F.col(f"{c}.origin")), "_mask$", "")
    left = picture(image_path).select(name("image").alias("name"), parent(F.col("image.origin")).alias("genus"), "image")
    right = picture(mask_path).select(name("image").alias("name"), F.col("image").alias("mask")).dropDuplicates(["name"])
    return left.join(right, "name", "left").mapInPandas(run, "genus string, name string, status string, mask_area_frac double, n_pixels long, f array<double>")


def signal_statistics(features: DataFrame, key: str, vector: str, size: int, nodes: DataFrame, permutations: int = 9_999) -> DataFrame:
    """(space, r, p, rho, rho_p, pairs): agreement of feature distances, standardised and in principal components, with the paths of a tree.

    ``key`` must name the tips as the tree does; rows are averaged to one vector a key, tips without rows take no part.
    """
    means = durable(aggregates.mean_vector(features, key, vector, size))
    tree = durable(trees.pruned(nodes, means.select(F.col(key).alias("label"))))
    paths = durable(trees.path_distances(tree))
    spaces = {"standardised": matrix.distances(matrix.standardised(means, key, "mean", size), key, "z"), "components": matrix.principal_distances(means, key, "mean", size)}
    found = [matrix.mantel(durable(pairs), paths, permutations).select(F.lit(space).alias("space"), "r", "p", "rho", "rho_p", "pairs") for space, pairs in spaces.items()]
    return found[0].unionByName(found[1])


def segmentation_report(pixels: DataFrame, image: str, predicted: str, actual: str) -> DataFrame:
    """Measures of each image, then the rows MACRO (means of the images) and MICRO (pooled counts)."""
    counts = aggregates.confusion(pixels, [image], F.col(predicted), F.col(actual))
    each = aggregates.measures(counts).withColumn(image, F.col(image).cast("string"))
    names = ["accuracy", "precision", "recall", "f1", "iou"]
    macro = aggregates.macro(each, names).drop("n").withColumn(image, F.lit("MACRO"))
    micro = aggregates.micro(counts).withColumn(image, F.lit("MICRO"))
    return each.unionByName(macro, allowMissingColumns=True).unionByName(micro)
