"""Image kernels: one raster is one row, so a task holds single images only; the rasters spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANGLES = (0, 45, 90, 135)
FREQUENCIES = (0.1, 0.2, 0.4)


def gabor_energy(grey: np.ndarray, inside: np.ndarray) -> list[float]:
    """Mean and population deviation of the magnitude of a complex Gabor response, for each angle and frequency."""
    found = []
    for angle in np.deg2rad(ANGLES):
        for frequency in FREQUENCIES:
            sigma = 0.56 / frequency
            reach = int(np.ceil(3 * sigma))
            y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
            along = x * np.cos(angle) + y * np.sin(angle)
            kernel = np.exp(-(x**2 + y**2) / (2 * sigma**2)) / (2 * np.pi * sigma**2) * np.exp(2j * np.pi * frequency * along)
            padded = np.pad(grey, reach, mode="symmetric") if reach <= min(grey.shape) else np.pad(grey, reach, mode="edge")
            shape = [a + b - 1 for a, b in zip(padded.shape, kernel.shape)]
            full = np.fft.ifft2(np.fft.fft2(padded, shape) * np.fft.fft2(kernel, shape))
            part = np.abs(full[2 * reach : 2 * reach + grey.shape[0], 2 * reach : 2 * reach + grey.shape[1]])[inside]
            found += [float(part.mean()), float(part.std())] if part.size else [0.0, 0.0]
    return found


def uniform_lbp(grey: np.ndarray) -> np.ndarray:
    """Uniform local binary pattern of eight neighbours at radius one, 0-9; diagonal neighbours are interpolated."""
    padded = np.pad(grey.astype(float), 2, mode="edge")
    h, w = grey.shape
    bits = []
    for k in range(8):
        dy, dx = -np.sin(2 * np.pi * k / 8), np.cos(2 * np.pi * k / 8)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        at = lambda a, b: padded[2 + a : 2 + a + h, 2 + b : 2 + b + w]
        value = at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x0 + 1) * (1 - fy) * fx + at(y0 + 1, x0) * fy * (1 - fx) + at(y0 + 1, x0 + 1) * fy * fx
        bits.append(value >= grey - 1e-9)
    stack = np.stack(bits)
    changes = (stack != np.roll(stack, 1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, stack.sum(axis=0), 9)


def resized_nearest(raster: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-neighbour resize of a mask."""
    rows = np.minimum((np.arange(height) * raster.shape[0] / height).astype(int), raster.shape[0] - 1)
    cols = np.minimum((np.arange(width) * raster.shape[1] / width).astype(int), raster.shape[1] - 1)
    return raster[rows][:, cols]


def resized_lanczos(raster: np.ndarray, height: int, width: int, lobes: int = 3) -> np.ndarray:
    """Lanczos resize, rows then columns; the window widens when the image shrinks."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(1.0, old / new)
        centre = (np.arange(new) + 0.5) * old / new - 0.5
        gap = (np.arange(old)[None, :] - centre[:, None]) / scale
        w = np.where(np.abs(gap) < lobes, np.sinc(gap) * np.sinc(gap / lobes), 0.0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(raster.shape[0], height) @ raster @ weights(raster.shape[1], width).T


def filled_polygon(points: list[tuple[float, float]], height: int, width: int) -> np.ndarray:
    """Mask of a polygon by the even-odd rule at pixel centres; corners are cut to whole numbers first."""
    mask = np.zeros((height, width), bool)
    corners = [(int(x), int(y)) for x, y in points]
    y, x = np.mgrid[0:height, 0:width]
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 != y1:
            crossed = (np.minimum(y0, y1) <= y) & (y < np.maximum(y0, y1))
            mask ^= crossed & (x >= x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return mask


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Corners of an open line that lie farther than ``tolerance`` from their chord, by repeated splitting."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    line = np.asarray(points, float)
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, inner = line[b] - line[a], line[a + 1 : b] - line[a]
        length = np.hypot(*chord)
        gap = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        far = int(gap.argmax())
        if gap[far] > tolerance:
            keep.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return [points[i] for i in sorted(keep)]


def outlines(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer and inner borders of a mask along pixel edges, each a closed ring of corners without the repeated first one."""
    padded = np.pad(mask.astype(bool), 1)
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(padded)):
        y, x = int(y), int(x)
        for other, a, b in (((y - 1, x), (x, y), (x + 1, y)), ((y, x + 1), (x + 1, y), (x + 1, y + 1)), ((y + 1, x), (x + 1, y + 1), (x, y + 1)), ((y, x - 1), (x, y + 1), (x, y))):
            if not padded[other]:
                step.setdefault(a, []).append(b)
    rings = []
    while step:
        start = min(step)
        ring, here = [], start
        while True:
            there = step[here].pop()
            if not step[here]:
                del step[here]
            ring.append((here[0] - 1, here[1] - 1))
            here = there
            if here == start:
                break
        rings.append(ring)
    return rings


def mask_polygons(mask: np.ndarray, tolerance: float = 0.001) -> list[list[tuple[int, int]]]:
    """Simplified borders with three corners or more; the tolerance is a share of the border's length."""
    found = []
    for ring in outlines(mask):
        line = simplified([*ring, ring[0]], tolerance * len(ring))[:-1]
        if len(line) >= 3:
            found.append(line)
    return found


def blended(pixel: np.ndarray, inside: np.ndarray, colour: tuple[int, int, int] = (0, 255, 0)) -> np.ndarray:
    """A quarter of ``colour`` over three quarters of the image where the mask holds."""
    return np.where(inside[..., None], pixel * 0.75 + np.array(colour) * 0.25, pixel)


def lineitem_rasters(lines: DataFrame) -> DataFrame:
    """(image, height, width, grey, inside): one raster for each supplier, at most seven rows by fifty columns."""
    cell = F.struct((F.col("l_linenumber") - 1).alias("y"), (F.least(F.col("l_quantity"), F.lit(50.0)) - 1).cast("int").alias("x"))
    cells = lines.where("l_linenumber between 1 and 7 and l_quantity between 1 and 50").groupBy("l_suppkey", cell.alias("c")).agg(F.avg("l_extendedprice").alias("v"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("m"))
    packed = F.map_from_entries(F.collect_list(F.struct(F.col("c.y") * 50 + F.col("c.x"), F.struct("v", "m"))))
    rasters = cells.groupBy("l_suppkey").agg(packed.alias("p"))
    place = F.sequence(F.lit(0), F.lit(349))
    grey = F.transform(place, lambda k: F.coalesce(F.try_element_at("p", k)["v"], F.lit(0.0)) / 1000)
    inside = F.transform(place, lambda k: F.coalesce(F.try_element_at("p", k)["m"], F.lit(0)))
    return rasters.select(F.col("l_suppkey").alias("image"), F.lit(7).alias("height"), F.lit(50).alias("width"), grey.alias("grey"), inside.alias("inside"))


def texture(rasters: DataFrame, key: str) -> DataFrame:
    """(key, gabor, lbp, polygons): Gabor energies, the density of patterns inside the mask, and the mask's borders counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h, w, grey, inside in zip(batch["key"], batch["height"], batch["width"], batch["grey"], batch["inside"]):
                image, mask = np.reshape(grey, (h, w)), np.reshape(inside, (h, w)).astype(bool)
                patterns = np.bincount(uniform_lbp(image)[mask], minlength=10)
                rows.append((k, gabor_energy(image, mask), (patterns / max(1, patterns.sum())).tolist(), len(mask_polygons(mask))))
            yield pd.DataFrame(rows, columns=["key", "gabor", "lbp", "polygons"])

    kind = rasters.schema[key].dataType.simpleString()
    plain = rasters.select(F.col(key).alias("key"), "height", "width", "grey", "inside")
    return plain.mapInPandas(run, f"key {kind}, gabor array<double>, lbp array<double>, polygons int").withColumnRenamed("key", key)
