import math

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import numeric as N
from tarnwick.functions import text as X


def test_labels_and_paths(spark):
    rows = [("a b_c", "/x/Genus/one two_ .PNG"), ("Ab Ab cd ef", "plain"), ("single", ""), ("", None), (None, "a.b/c")]
    got = spark.createDataFrame(rows, "l string, p string").select(
        X.short_label(F.col("l")).alias("short"), X.last_words(F.col("l"), 2).alias("two"), X.stem(F.col("p")).alias("stem"),
        X.parent(F.col("p")).alias("parent"), X.suffix(F.col("p")).alias("suffix"), X.clean_filename(X.stem(F.col("p"))).alias("clean"), X.newick_label(F.col("l")).alias("n"),
    ).collect()
    assert got[0] == ("a. b c", "b c", "one two_ ", "Genus", ".png", "One two", "a_b_c")
    assert got[1]["short"] == "A. cd ef" and got[1]["two"] == "cd ef" and got[1]["parent"] == ""
    assert got[2]["short"] == "single" and got[3]["short"] == "" and got[4]["short"] is None
    assert got[4]["stem"] == "c" and got[4]["suffix"] == ""


def test_numbers(spark):
    row = spark.createDataFrame([([1.0, 3.0], [4.0, 7.0], float("nan"), 0.0)], "a array<double>, b array<double>, x double, z double").select(
        N.euclidean(F.col("a"), F.col("b")).alias("d"), N.finite_or_zero(F.col("x")).alias("x"), N.ratio(F.col("z"), F.col("z")).alias("r"),
        N.entropy(F.col("a")).alias("e"), N.sound(F.array(F.lit(1.0), F.col("x")), 2).alias("sound"), N.corners(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("c"),
        N.mirrored(F.array(*map(F.lit, (1, 2, 3, 4))), F.lit(10)).alias("m"), N.least_detectable_r(F.lit(1128)).alias("least"),
        N.hue8(F.lit(0), F.lit(255), F.lit(0)).alias("hue"), N.saturation8(F.lit(5), F.lit(5), F.lit(5)).alias("s"), N.hsv_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("rgb"),
    ).first()
    assert row["d"] == 5.0 and row["x"] == 0.0 and row["r"] == 0.0 and row["sound"] is False
    assert row["e"] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)), abs=1e-6)
    assert row["c"] == [1, 2, 4, 6] and row["m"] == [6, 2, 3, 4] and row["least"] == pytest.approx(0.0741480, abs=1e-7)
    assert row["hue"] == 60 and row["s"] == 0 and tuple(row["rgb"]) == (1.0, 0.0, 0.0)


def test_square_fit_rounds_half_to_even(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in N.fit_square(F.lit(2048), F.lit(1025), 1024).items()]).first()
    assert (row["new_width"], row["new_height"], row["pad_left"], row["pad_top"]) == (1024, 512, 0, 256)


def test_names_colours_and_masks(spark):
    groups = {"hue_hist": 18, "sat_hist": 8, "val_hist": 8, "dom_colours": 20, "dorsal_ventral": 9, "gabor": 24, "lbp": 10, "entropy": 2}
    names = [r["n"] for g, size in groups.items() for r in spark.range(size).orderBy("id").select(X.feature_name(g, F.col("id").cast("int")).alias("n")).collect()]
    assert len(set(names)) == 99 and {"hue_bin_090_100", "sat_bin_224_256", "val_bin_000_032", "domcol_4_val", "domcol_0_freq", "dv_diff_val_mean", "gabor_t135_f0p4_std", "lbp_bin_09", "hue_entropy"} <= set(names)
    row = spark.range(1).select(
        X.replaced(F.lit("Naso_x Naso y Zebra_Naso"), {"Naso": "N.", "Zebra": "Z."}).alias("short"), X.looked_up(F.lit("a"), {"a": "1"}, "0").alias("known"), X.looked_up(F.lit(None).cast("string"), {"a": "1"}, "0").alias("unknown"),
        X.percent(F.lit(0.1234)).alias("percent"), N.luminance(F.lit(7), F.lit(7), F.lit(7)).alias("same"), N.luminance(F.lit(255), F.lit(0), F.lit(0)).alias("red"), N.on_white(F.lit(10), F.lit(0)).alias("clear"), N.on_white(F.lit(10), F.lit(255)).alias("full"), N.on_white(F.lit(0), F.lit(128)).alias("half"),
    ).first()
    assert tuple(row) == ("N.x N.y Z.Naso", "1", "0", "12.3%", 7, 76, 255, 10, 127)
