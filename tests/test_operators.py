import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import aggregates as A
from tarnwick.operators import images as I
from tarnwick.operators import joins as J
from tarnwick.operators import matrix as M
from tarnwick.operators import ranking as R
from tarnwick.operators import trees as T

TREE = [(0, None, None, 0.0), (1, 0, None, 1.0), (2, 0, None, 2.0), (3, 1, "A_a", 1.0), (4, 1, "B_b", 2.0), (5, 2, "C_c", 3.0), (6, 2, "D_d", 4.0)]
NODES = "node int, parent int, label string, length double"


def tree(spark, rows=TREE):
    return spark.createDataFrame(rows, NODES)


def test_cascade_takes_the_first_step_that_matches(spark):
    tips = spark.createDataFrame([(1, "Ab_cd"), (2, "Ef_gh"), (3, "Ij_gh")], "tip_id int, tip_label string")
    labels = spark.createDataFrame([("Ab cd",), ("x Ab cd",), ("Zz gh",), ("q Ab_cd",), ("none at all",), (None,), (" ",), ("Zz CD",), ("Q GH",)], "label string")
    got = {r["label"]: (r["tip"], r["method"]) for r in J.label_cascade(labels, tips, "label", "tip_label", "tip_id").collect()}
    assert got == {"Ab cd": ("Ab_cd", "exact"), "x Ab cd": ("Ab_cd", "last_two_words"), "Zz gh": ("Ef_gh", "epithet_only"), "q Ab_cd": ("Ab_cd", "epithet_underscore_stripped"), "none at all": (None, "none"), "Zz CD": ("Ab_cd", "epithet_only"), "Q GH": ("Ef_gh", "epithet_only")}


def test_priority_upsert_and_alignment(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (None, "w")], "k int, v string")
    assert {tuple(r) for r in J.by_priority([a, b], "k", "v").collect()} == {(1, "y", 1), (2, "x", 0)}
    assert {tuple(r) for r in J.upsert(a, b.where("k = 1"), "k").collect()} == {(1, "y"), (2, "x")}
    assert {r["k"] for r in J.aligned_keys([a, b], "k").collect()} == {1, 2}
    rows = spark.createDataFrame([(1, [0.0, 1.0])], "k int, v array<double>")
    centres = spark.createDataFrame([(7, [0.0, 0.0]), (5, [0.0, 2.0])], "c int, m array<double>")
    assert J.nearest_centre(rows, centres, "k", "v", "c", "m").first()["nearest"] == 5
    with pytest.raises(ValueError):
        J.nearest_centre(rows, centres, "k", "v", "c", "m", most_centres=1)


def test_histogram_closes_its_last_bin(spark):
    rows = spark.createDataFrame([("a", v) for v in (0.0, 9.999, 10.0, 20.0)] + [("a", 25.0), ("a", None)], "g string, v double")
    got = {r["bin"]: (r["n"], r["density"]) for r in A.density_histogram(rows, "v", 0.0, 20.0, 2, "g").collect()}
    assert got == {0: (2, 0.05), 1: (2, 0.05)}
    assert A.density_histogram(rows.where("false"), "v", 0.0, 20.0, 2, "g").count() == 0


def test_measures(spark):
    rows = spark.createDataFrame([("i", True, True), ("i", True, False), ("i", False, True), ("i", False, False), ("j", False, False)], "k string, p boolean, a boolean")
    found = {r["k"]: r for r in A.measures(A.confusion(rows, ["k"], F.col("p"), F.col("a"))).collect()}
    assert (found["i"]["accuracy"], found["i"]["precision"], found["i"]["iou"]) == (0.5, 0.5, 0.3333)
    assert found["j"]["precision"] == 0.0 and found["j"]["accuracy"] == 1.0
    ap = A.average_precision_at(spark.createDataFrame([("k", 1.0), ("k", None)], "k string, iou double"), "k", "iou").first()["ap"]
    assert ap == 0.5
    box = A.bounding_box(spark.createDataFrame([(1, 2, 3, True), (1, 5, 4, True), (1, 9, 9, False), (2, 0, 0, False)], "i int, x int, y int, m boolean"), "i", "x", "y", F.col("m"))
    got = {r["i"]: r for r in box.collect()}
    assert got[1]["box"] == [2, 3, 3, 1] and got[1]["area"] == 2 and got[2]["box"] is None


def test_ranks_curves_and_samples(spark):
    scores = spark.createDataFrame([("a", 0.9, True), ("a", 0.9, False), ("a", 0.1, False), ("b", 0.5, True), ("b", 0.6, True)], "g string, s double, y boolean")
    assert {tuple(r) for r in R.roc_auc(scores, "g", "s", "y").collect()} == {("a", 0.75), ("b", 0.5)}
    assert {r["g"]: round(r["ap"], 6) for r in R.pr_area(scores, "g", "s", "y").collect()} == {"a": 0.75, "b": 1.0}
    ranks = R.average_rank(spark.createDataFrame([("g", 1), ("g", 1), ("g", 3)], "g string, v int"), "v", "g")
    assert sorted(r["rank"] for r in ranks.collect()) == [1.5, 1.5, 3.0]
    rows = spark.range(1000).select("id", F.lit("x").alias("g"))
    one, two = (R.hash_sample(rows.repartition(n), "g", "id", 50, 1) for n in (2, 7))
    assert {r["id"] for r in one.collect()} == {r["id"] for r in two.collect()} and one.count() == 50
    split = {r["split"]: r["count"] for r in R.stratified_split(rows, "g", "id", {"a": 0.7, "b": 0.3}, 1).groupBy("split").count().collect()}
    assert split == {"a": 700, "b": 300}


def test_standardise_and_distances_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 4))
    x[:, 3] = 5.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    z = {r["k"]: r["z"] for r in M.standardised(rows, "k", "v", 4).collect()}
    scale = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    want = (x - x.mean(axis=0)) / scale
    assert np.allclose([z[i] for i in range(20)], want)
    pairs = {(r["a"], r["b"]): r["d"] for r in M.distances(rows, "k", "v").collect()}
    assert len(pairs) == 190 and all(abs(d - np.linalg.norm(x[a] - x[b])) < 1e-9 for (a, b), d in pairs.items())
    with pytest.raises(ValueError):
        M.checked(rows, 19)
    spread = M.principal_distances(rows, "k", "v", 4, share=1.0).collect()
    assert all(abs(r["d"] - np.linalg.norm(want[r["a"]] - want[r["b"]])) < 1e-6 for r in spread)


def test_mantel_ranks_and_chunks(spark):
    names, rng = list("abcdef"), np.random.default_rng(4)
    v, p = rng.random((6, 6)).round(1), rng.random((6, 6)) ** 4
    at = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    one, two = (spark.createDataFrame([(names[i], names[j], float(m[i, j])) for i, j in at], "a string, b string, d double") for m in (v, p))
    rank = lambda x: np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])
    x, y = (np.array([m[i, j] for i, j in at]) for m in (v, p))
    row = M.mantel(one, two, 29).first()
    assert abs(row["r"] - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(row["rho"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9
    perms = {}
    for perm in range(1, 30):
        marked = sorted(range(6), key=lambda i: hashlib.md5(f"{perm}_{names[i]}".encode()).hexdigest())
        perms[perm] = {i: place for place, i in enumerate(marked)}
    place = {pair: n for n, pair in enumerate(at)}
    for name, a, b in (("p", x, y), ("rho_p", rank(x), rank(y))):
        null = [np.corrcoef(a[[place[tuple(sorted((o[i], o[j])))] for i, j in at]], b)[0, 1] for o in perms.values()]
        assert row[name] == pytest.approx((sum(round(n, 9) >= round(np.corrcoef(a, b)[0, 1], 9) for n in null) + 1) / 30)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(M, "TASK_PERMUTATIONS", 3)
        assert tuple(M.mantel(one, two, 29).first()) == pytest.approx(tuple(row))
        patch.setattr(M, "MOST_PERMUTED", 5)
        with pytest.raises(ValueError):
            M.mantel(one, two, 29)
    flat = M.mantel(one.withColumn("d", F.lit(1.0)), two, 9).first()
    assert np.isnan(flat["r"]) and flat["p"] == 1.0 and M.mantel(one.where("false"), two, 9).first()["pairs"] == 0


def test_one_group_of_all_rows_is_counted_in_ranges(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 500, 3_000) / 7
    rows = spark.createDataFrame([("all", i, float(x), bool(x > 20 + 40 * rng.random())) for i, x in enumerate(v)] + [("few", 10_000 + i, float(i), i > 1) for i in range(4)], "g string, i long, v double, y boolean")
    ranks = {r["i"]: r["rank"] for r in R.average_rank(rows, "v", "g", parts=7).collect()}
    assert all(ranks[i] == (v < v[i]).sum() + ((v == v[i]).sum() + 1) / 2 for i in range(3_000)) and ranks[10_003] == 4
    placed = R.running(rows, ["g"], [F.col("v"), F.col("i")], ["i"], 7)
    assert placed.select(F.spark_partition_id()).count() == 3_004
    spread = R.row_index(rows, ["g"], [F.col("v"), F.col("i")], 7)
    want = np.lexsort((np.arange(3_000), v)).argsort()
    assert all(want[r["i"]] == r["place"] for r in spread.where("g = 'all'").collect())
    ranges = rows.repartitionByRange(7, "g", "v", "i").where("g = 'all'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges > 3
    y = np.array([r["y"] for r in rows.where("g = 'all'").orderBy("i").collect()])
    auc = ((v[y][:, None] > v[~y]).mean() + (v[y][:, None] == v[~y]).mean() / 2)
    assert {r["g"]: r["auc"] for r in R.roc_auc(rows, "g", "v", "y", 7).collect()}["all"] == pytest.approx(auc)
    assert {r["g"]: r["ap"] for r in R.pr_area(rows, "g", "v", "y", 7).collect()} == pytest.approx({r["g"]: r["ap"] for r in R.pr_area(rows, "g", "v", "y", 1).collect()})
    got = {r["g"]: r for r in R.percentiles(rows, "g", "v", {"p99": 0.99, "mid": 0.5, "low": 0.0}, 7).collect()}
    assert [got["all"][k] for k in ("p99", "mid", "low")] == pytest.approx(np.quantile(v, [0.99, 0.5, 0.0]).tolist()) and got["few"]["mid"] == 1.5
    assert R.average_rank(rows.where("false"), "v", "g").count() == R.percentiles(rows.where("false"), "g", "v", {"m": 0.5}).count() == 0


def test_a_deep_tree_and_a_loop(spark):
    comb = [(0, None, None, 0.0)] + [(2 * i + 1, 2 * i, f"t{i:03d}", 1.0) for i in range(150)] + [(2 * i + 2, 2 * i, None, 0.5) for i in range(150)]
    d = {(r["a"], r["b"]): r["d"] for r in T.path_distances(tree(spark, comb)).where("a = 't000' or b = 't149'").collect()}
    assert d["t000", "t149"] == 1 + 149 * 0.5 + 1 and d["t148", "t149"] == 1 + 0.5 + 1
    with pytest.raises(ValueError):
        T.lineages(tree(spark, [(0, 1, None, 0.0), (1, 0, None, 0.0), (2, 1, "x", 1.0)])).count()


def test_upsert_resume_and_order_of_another_table(spark):
    base = spark.createDataFrame([(4, "a", 1, "k"), (9, "b", 2, "l")], "id int, name string, v int, kept string")
    change = spark.createDataFrame([("b", 20), ("d", 40), ("c", 30)], "name string, v int")
    assert {tuple(r) for r in J.upsert_with_ids(base, change, "name", "id").collect()} == {(4, "a", 1, "k"), (9, "b", 20, "l"), (10, "c", 30, None), (11, "d", 40, None)}
    assert {r["id"] for r in J.upsert_with_ids(base.where("false"), change, "name", "id").collect()} == {1, 2, 3}
    log = spark.createDataFrame([("a", "ok"), ("b", "failed")], "name string, status string")
    assert {r["name"] for r in J.remaining(change.union(spark.createDataFrame([("a", 1)], "name string, v int")), log, "name", F.col("status") == "ok").collect()} == {"b", "c", "d"}
    assert {tuple(r) for r in J.continued(log, change, "name").collect()} == {("a", "ok", None), ("b", "failed", None), ("c", None, 30), ("d", None, 40)}
    order = spark.createDataFrame([("d", 0), ("b", 1)], "name string, place int")
    assert [tuple(r) for r in J.in_order_of(change, order, "name", "place").orderBy("place").collect()] == [(0, "d", 40), (1, "b", 20)]
    pairs = [spark.createDataFrame(rows, "a string, b string, d double") for rows in ([("x", "y", 1.0), ("x", "z", 2.0), ("y", "z", 3.0)], [("x", "y", 5.0)])]
    assert [t.count() for t in J.aligned_pairs(pairs)] == [1, 1] and M.ordered_pairs(pairs[0]).count() == 6


def test_mantel_of_a_table_with_itself(spark):
    x = np.random.default_rng(1).normal(size=(8, 2))
    pairs = M.distances(spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "k string, v array<double>"), "k", "v").cache()
    row = M.mantel(pairs, pairs, 19).first()
    assert row["r"] == pytest.approx(1.0) and 0 < row["p"] <= 0.1 and row["pairs"] == 28
    p = spark.createDataFrame([(0.5, 20), (0.0, 20), (1.0, 20)], "r double, n int").select(M.pearson_p("r", "n").alias("p")).collect()
    assert p[0]["p"] == pytest.approx(0.0247, abs=2e-4) and p[1]["p"] == pytest.approx(1.0) and p[2]["p"] == 0.0


def test_linkage_and_tree_text(spark):
    pairs = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 6.0), ("b", "c", 8.0)], "a string, b string, d double")
    merges = M.upgma(pairs).cache()
    assert [tuple(r) for r in merges.orderBy("step").collect()] == [(0, "a", "b", 2.0, 2), (1, "#0", "c", 7.0, 3)]
    nodes = M.merge_nodes(merges).cache()
    assert T.newick(nodes).first()["text"] == "((a:1,b:1):2.5,c:3.5);"
    places = {r["label"]: r["place"] for r in T.leaf_places(nodes).collect()}
    assert places == {"a": 0, "b": 1, "c": 2}
    cells = {(r["row"], r["column"]): r["d"] for r in M.reordered(pairs, spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "label string, place int")).collect()}
    assert cells[0, 1] == cells[1, 0] == 8.0 and cells[2, 2] == 0.0 and len(cells) == 9
    facing = M.facing_leaves(spark.createDataFrame([("a", 4), ("b", 9), ("x", 5)], "label string, place int"), spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "label string, place int"))
    assert {tuple(r) for r in facing.collect()} == {("a", 0, 1, False), ("b", 1, 0, False)}
    assert M.upgma(pairs.where("false")).count() == 0


def test_linkage_against_one_merge_at_a_time(spark):
    rng = np.random.default_rng(12)
    x = rng.random((14, 2))
    names = [f"k{i:02d}" for i in range(14)]
    pairs = [(names[i], names[j], float(np.linalg.norm(x[i] - x[j]))) for i in range(14) for j in range(i + 1, 14)]
    groups = {k: [k] for k in names}
    d = {frozenset(p[:2]): p[2] for p in pairs}
    want = []
    while len(groups) > 1:
        mean = lambda a, b: np.mean([d[frozenset((p, q))] for p in groups[a] for q in groups[b]])
        h, a, b = min((round(mean(a, b), 9), a, b) for a in groups for b in groups if a < b)
        groups[a] = groups[a] + groups.pop(b)
        want.append((h, len(groups[a])))
    got = M.upgma(spark.createDataFrame(pairs, "a string, b string, d double")).orderBy("step").collect()
    assert len(got) == 13 and sorted(round(r["height"], 6) for r in got) == pytest.approx(sorted(round(h, 6) for h, _ in want)) and got[-1]["size"] == 14
    tied = M.upgma(spark.createDataFrame([(a, b, 1.0) for a, b, _ in pairs], "a string, b string, d double"))
    assert tied.count() == 13 and tied.where("height = 1").count() == 13


def test_paths_prune_and_splits(spark):
    d = {(r["a"], r["b"]): r["d"] for r in T.path_distances(tree(spark)).collect()}
    assert d == {("A_a", "B_b"): 3.0, ("A_a", "C_c"): 7.0, ("A_a", "D_d"): 8.0, ("B_b", "C_c"): 8.0, ("B_b", "D_d"): 9.0, ("C_c", "D_d"): 7.0}
    kept = T.pruned(tree(spark), spark.createDataFrame([("A_a",), ("C_c",), ("D_d",)], "label string"))
    got = {r["label"]: (r["parent"], r["length"]) for r in kept.where("label is not null").collect()}
    assert got == {"A_a": (0, 2.0), "C_c": (2, 3.0), "D_d": (2, 4.0)}
    assert tuple(T.robinson_foulds(tree(spark), tree(spark)).first()) == (0, 0.0)
    other = [(n, {4: 2, 5: 1}.get(n, p), label, length) for n, p, label, length in TREE]
    assert tuple(T.robinson_foulds(tree(spark), tree(spark, other)).first()) == (2, 1.0)


def test_newick(spark):
    rows = spark.createDataFrame([("t", "((A:1,'B b':2)x:0.5,C[note]:3);"), ("u", None), ("v", "")], "k string, t string")
    got = {(r["label"], r["parent"], r["length"], r["tip_order"]) for r in T.parse_newick(rows, "k", "t").collect()}
    assert got == {(None, None, None, None), ("x", 0, 0.5, None), ("A", 1, 1.0, 0), ("B b", 1, 2.0, 1), ("C", 0, 3.0, 2)}


def test_image_kernels(spark):
    mask = I.filled_polygon([(1, 1), (6, 1), (6, 5), (1, 5)], 8, 8)
    assert mask.sum() == 20 and I.mask_polygons(mask) == [[(1, 1), (6, 1), (6, 5), (1, 5)]]
    assert I.resized_nearest(mask, 16, 16).sum() == 80
    assert np.allclose(I.resized_lanczos(np.full((9, 7), 3.0), 4, 5), 3.0)
    assert set(np.unique(I.uniform_lbp(np.full((5, 5), 7.0)))) == {8}
    wave = np.cos(2 * np.pi * 0.2 * np.arange(64))[None, :] * np.ones((64, 1))
    energy = np.reshape(I.gabor_energy(wave, np.ones_like(wave, bool))[::2], (4, 3))
    assert np.unravel_index(energy.argmax(), energy.shape) == (0, 1)
    assert I.blended(np.zeros((1, 1, 3)), np.ones((1, 1), bool))[0, 0, 1] == 63.75
    rows = spark.createDataFrame([(1, 2, 2, [1.0, 2.0, 3.0, 4.0], [0, 0, 0, 0])], "image long, height int, width int, grey array<double>, inside array<int>")
    assert I.texture(rows, "image").first()["polygons"] == 0
