"""Column functions on numbers, colours, boxes and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def finite_or_zero(value: Column) -> Column:
    """Null stays null; NaN and infinities become zero."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)


def array_sum(values: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + of(v))


def norm(values: Column) -> Column:
    return F.sqrt(array_sum(values, lambda v: v * v))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def sound(values: Column, size: int) -> Column:
    """Whether an array has ``size`` finite values."""
    return (F.size(values) == size) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def entropy(histogram: Column) -> Column:
    """Natural-log entropy of a histogram; a small constant enters before both normalisations."""
    total = array_sum(histogram)
    raised = F.transform(histogram, lambda h: h / (total + EPSILON) + EPSILON)
    again = array_sum(raised)
    return -array_sum(raised, lambda p: (p / again) * F.ln(p / again))


def ratio(part: Column, whole: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hue8(r: Column, g: Column, b: Column) -> Column:
    """Hue of 8-bit red, green and blue in half degrees (0-179)."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    turn = F.when(high == r, (g - b) / span).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 30
    return F.when(span == 0, F.lit(0.0)).otherwise(F.when(turn < 0, turn + 180).otherwise(turn))


def saturation8(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(high == 0, F.lit(0.0)).otherwise((high - low) * 255 / high)


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luminance cut to a whole number."""
    return F.floor((r * 0.299 + g * 0.587 + b * 0.114) / 255 * 255)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """8-bit luminance in fixed point, as imaging libraries convert to one channel; equal channels stay as they are."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def on_white(channel: Column, alpha: Column) -> Column:
    """8-bit channel of a half-transparent pixel laid on white, rounded by the usual division by 255 in bits."""
    mixed = channel * alpha + (255 - alpha) * 255 + 128
    return F.shiftright(F.shiftright(mixed, 8) + mixed, 8)


def normalised_hsv(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Hue, saturation and value from 0 to 1 of their 8-bit numbers."""
    return {"h": h / 180, "s": s / 255, "v": v / 255}


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Red, green and blue (0-1) of hue, saturation and value (0-1)."""
    sector = F.floor(h * 6)
    part = h * 6 - sector
    p, q, t = v * (1 - s), v * (1 - part * s), v * (1 - (1 - part) * s)
    k = F.pmod(sector, F.lit(6))
    pick = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    found = F.struct(*[F.lit(None).cast("double").alias(n) for n in "rgb"])
    for place, (r, g, b) in enumerate(pick):
        found = F.when(k == place, F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))).otherwise(found)
    return found


def corners(box: Column) -> Column:
    """(x0, y0, x1, y1) of a box given as (x, y, width, height)."""
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    return F.array(x, y, x + w, y + h)


def mirrored(box: Column, width: Column) -> Column:
    """A box (x, y, width, height) after a flip of an image ``width`` wide."""
    x, y, w, h = (F.get(box, F.lit(i)) for i in range(4))
    return F.array(width - (x + w), y, w, h)


def fit_square(width: Column, height: Column, longest: int) -> dict[str, Column]:
    """Scale to the longest edge and the offsets that centre the result in a square."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return {"scale": scale, "new_width": w, "new_height": h, "pad_left": F.floor((longest - w) / 2).cast("int"), "pad_top": F.floor((longest - h) / 2).cast("int")}


def rotation(orientation: Column) -> Column:
    """Degrees that an image must be turned by its orientation mark."""
    return F.when(orientation == 3, 180).when(orientation == 6, 270).when(orientation == 8, 90).otherwise(0)


def least_detectable_r(pairs: Column) -> Column:
    """Smallest correlation found at 5 % one-sided with 80 % power."""
    return F.lit(1.645 + 0.842) / F.sqrt(pairs - 3)
