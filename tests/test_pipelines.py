import numpy as np
import pytest

from tarnwick.operators import matrix
from tarnwick.plans import pipelines as P
from tarnwick.sources import sinks


def test_images_to_features(spark, tmp_path):
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    mask = np.zeros((40, 40, 3), np.uint8)
    mask[5:35, 5:35] = 255
    small = np.zeros_like(mask)
    small[:3, :3] = 255
    pictures = [("fish_one", rgb), ("fish_two", rgb), ("fish_three", rgb)]
    write = lambda rows, folder: sinks.write_pngs(spark.createDataFrame([(n, 40, 40, bytearray(x.tobytes())) for n, x in rows], "name string, width int, height int, rgb binary"), str(folder))
    write(pictures, tmp_path / "img" / "Genus")
    write([("fish_one_mask", mask), ("fish_two_mask", small)], tmp_path / "masks")
    listing = {r["name"]: r["mask"] for r in P.image_listing(spark, str(tmp_path / "img"), str(tmp_path / "masks")).collect()}
    assert set(listing) == {"Fish_one", "Fish_two", "Fish_three"} and listing["Fish_three"] is None
    got = {r["name"]: r for r in P.extract_features(spark, str(tmp_path / "img"), str(tmp_path / "masks")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"fish_one": "OK", "fish_two": "FAILED", "fish_three": "NO_MASK"}
    f = np.array(got["fish_one"]["f"])
    assert len(f) == 99 == sum(P.GROUPS.values()) and got["fish_one"]["n_pixels"] == 900
    assert f[:18].sum() * 10 == pytest.approx(1, abs=1e-4) and f[18:26].sum() * 32 == pytest.approx(1, abs=1e-4) and f[87:97].sum() == pytest.approx(1, abs=1e-4)
    assert f[49:54].sum() == pytest.approx(1, abs=1e-4) and (np.diff(f[49:54]) <= 0).all()
    assert np.allclose(f[60:63], f[54:57] - f[57:60], atol=2e-6)


def test_statistics_and_report(spark):
    nodes = spark.createDataFrame([(0, None, None, 0.0), (1, 0, None, 1.0), (2, 0, None, 1.0)] + [(3 + i, 1 + i % 2, f"t{i}", 1.0 + i) for i in range(6)], "node int, parent int, label string, length double")
    rows = spark.createDataFrame([(f"t{i}", [float(i % 2) * 9, float(i)]) for i in range(6)] + [("absent", [1.0, 1.0])], "k string, v array<double>")
    got = {r["space"]: r for r in P.signal_statistics(rows, "k", "v", 2, nodes, 19).collect()}
    assert set(got) == {"standardised", "components"} and all(r["pairs"] == 15 and -1 <= r["r"] <= 1 and 0 < r["p"] <= 1 for r in got.values())
    pixels = spark.createDataFrame([("i", True, True), ("i", False, True), ("j", True, False)], "image string, p boolean, a boolean")
    report = {r["image"]: r for r in P.segmentation_report(pixels, "image", "p", "a").collect()}
    assert report["MICRO"]["tp"] == 1 and report["MACRO"]["recall"] == 0.25 and report["i"]["recall"] == 0.5


def test_leaf_orders(spark):
    order = lambda labels: spark.createDataFrame(list(zip(labels, range(len(labels)))), "label string, place int")
    facing = matrix.facing_leaves(order(["a", "b", "c"]), order(["b", "x", "c", "a"]))
    assert {tuple(r) for r in facing.collect()} == {("a", 0, 2, False), ("b", 1, 0, False), ("c", 2, 1, False)}
    pairs = spark.createDataFrame([("a", "b", 2.0)], "a string, b string, d double")
    assert {tuple(r) for r in matrix.reordered(pairs, order(["b", "a"])).collect()} == {(0, 0, 0.0), (1, 1, 0.0), (0, 1, 2.0), (1, 0, 2.0)}
