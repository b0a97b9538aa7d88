"""Edge cases and brute-force comparisons of the eight operators on small fixtures."""

import base64
import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.llm import canonical, clusters, dedupe, encoding, language, leakage, splits, vectors

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _rows(df):
    return {tuple(r) for r in df.collect()}


# 1


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=12, unique=True), st.lists(st.text("abc", max_size=6), min_size=1, max_size=6, unique=True), st.integers(0, 3))
def test_tree_search_equals_brute_force(words, keys, limit):
    got = set()
    for at, word, distance in canonical.BKTree(words).within(keys, np.full(len(keys), limit)):
        got |= {(keys[i], word, int(d)) for i, d in zip(at, distance)}
    assert got == {(k, w, _lev(k, w)) for k in keys for w in words if _lev(k, w) <= limit}


@settings(max_examples=60, deadline=None)
@given(st.text("abé", max_size=70), st.lists(st.text("abéc", max_size=75), min_size=1, max_size=8))
def test_distances_by_bits_equal_the_table(word, others):
    codes = [canonical._codes(o) for o in others]
    table = np.full((len(others), max(1, max(map(len, codes)))), 0xFFFFFFFF, np.uint32)
    for row, c in zip(table, codes):
        row[: len(c)] = c
    assert canonical.levenshtein(canonical._codes(word), table, np.array([len(c) for c in codes])).tolist() == [_lev(word, o) for o in others]


@pytest.mark.parametrize("shard_rows, task_keys", [(1, 1), (3, 2), (100, 1), (7, 100)])
def test_shards_and_parts_change_nothing(spark, shard_rows, task_keys):
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(12)})
    keys = sorted({"".join(rng.choice(list("abc"), rng.integers(0, 7))) for _ in range(15)})
    asked = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "key string, most int")
    got = [tuple(r) for r in canonical.within(asked, spark.createDataFrame([(w,) for w in words], "word string"), shard_rows, task_keys).collect()]
    want = [(k, w, _lev(k, w)) for i, k in enumerate(keys) for w in words if _lev(k, w) <= i % 3]
    assert sorted(got) == sorted(want)


def test_a_near_epithet_of_a_cut_genus_is_found_beside_an_equal_one_elsewhere(spark):
    tips = spark.createDataFrame([("Naso_albuss",), ("Zebrasoma_albus",)], "entry string")
    values = spark.createDataFrame([("N. albus",), ("Zebr. albus",), ("Zebrasom. albus",)], "value string")
    assert _rows(canonical.match(values, tips, True)) == {("N. albus", "Naso_albuss"), ("Zebr. albus", "Zebrasoma_albus"), ("Zebrasom. albus", "Zebrasoma_albus")}


def test_typed_names_and_terms(spark):
    tips = spark.createDataFrame([("Langnatha_golinloensis",), ("Zulirsoma_vesoboum",), ("Barthurus_vesoboum",), ("Volnaso_pecocualis",)], "entry string")
    terms = spark.createDataFrame([("exact",), ("last_two_words",), ("none",)], "entry string")
    typed = {
        "LANGNATHA GOLINLOENSIS": "Langnatha_golinloensis", "golinloensis, Langnatha": "Langnatha_golinloensis", "Langnatha cf. golinloensiss": "Langnatha_golinloensis",
        "Lang. golinloensis": "Langnatha_golinloensis", "LangnathaGolinloensis": "Langnatha_golinloensis", "Langnatha Langnatha_golinloensis (de Quorn, 1907)": "Langnatha_golinloensis",
        "golinlóensis": "Langnatha_golinloensis", "vesoboum": "", "Zulirsoma vesoboum.png": "Zulirsoma_vesoboum", "Barthurus vesobom?": "Barthurus_vesoboum", "V0lnaso pecocua1is": "Volnaso_pecocualis",
        "Langnatha sp. 2": "", "Langnatha": "", "Volnaso vesoboum": "", "IMG_4671": "", "??": "", "x" * 100_000: "",
    }
    rows = [(i, v, "Last two wrods" if i % 2 else "exat", 1) for i, v in enumerate(typed)] + [(0, list(typed)[0], "exat", 1), (90, None, " ", 1), (91, " \t", "see notes", 1), (92, "tank 6", "None.", 1)]
    df = spark.createDataFrame(rows, "audit_id long, label string, method string, value int")
    got = _rows(canonical.match_fields(df, "audit_id", [(["label"], tips, True), (["method"], terms, False)]))
    want = {(i, "label", e) for i, e in enumerate(typed.values())} | {(i, "method", "last_two_words" if i % 2 else "exact") for i in range(len(typed))}
    assert got == want | {(91, "method", ""), (92, "label", ""), (92, "method", "none")}
    assert canonical.match_fields(df.where("false"), "audit_id", [(["label"], tips, True)]).count() == 0
    assert {r["entry"] for r in canonical.match(df.select(F.col("label").alias("value")).where("value is not null"), tips.where("false"), True).collect()} == {""}


# 2


def _copies(df, key, content):
    return dedupe.copies([dedupe.Source("t", df, key, content)]).select("id_a", "id_b")


def _counted(df, key, content):
    return dedupe.counted([dedupe.Source("t", df, key, content)]).select("id_a", "copies")


def test_lines_of_different_tables_are_no_copies(spark):
    one, two = (spark.createDataFrame(rows, "id long, v string") for rows in ([(1, "Ab cd"), (2, "cd ab")], [(1, "AB_CD"), (7, "abcd"), (3, "x")]))
    sources = [dedupe.Source("one", one, "id", ["v"]), dedupe.Source("two", two, "id", ["v"])]
    assert _rows(dedupe.copies(sources)) == {("one", 1, 2), ("two", 1, 7)}
    assert _rows(dedupe.counted(sources)) == {("one", 1, 2), ("two", 1, 2), ("two", 3, 1)}


def test_copies(spark):
    rows = [
        (5, "Ab cd 12.png", None, 1.5, "x"), (3, "12_CD-AB .PNG", None, 1.5, "X!"), (9, "AbCd12.png", None, 1.5, "x"), (9, "AbCd12.png", None, 1.5, "x"),
        (1, "Ab cd 21.png", None, 1.5, "x"), (2, "Ab cd 12.png", "", 1.5, "x"), (4, "Ab cd 12.png", None, 1.6, "x"), (7, None, None, None, None), (8, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "log_id long, lo string, hi string, n double, raw string")
    names = ["lo", "hi", "n", "raw"]
    assert _rows(_copies(df, "log_id", names)) == {(3, 5), (3, 9), (7, 8)}
    assert _rows(_counted(df, "log_id", names)) == {(3, 3), (1, 1), (2, 1), (4, 1), (7, 2)}
    assert _copies(df.where("false"), "log_id", names).count() == 0


def test_words_written_together_are_copies_and_anagrams_are_not(spark):
    values = [
        "Naso tonganus", "Naso nagnotus", "silent", "listen", "IMG 12 34", "IMG1234", "img-1243", "tonganusnaso", "TONGANUS_NASO", "Abc def ghi 7", "GHI7 ABCDEF", "abc ghidef 7", "ghi abc def7",
        "a ab", "aab", "aba", "x" * 5_000 + " y", "Y" + "X" * 5_000, None, "", " - ", "é e", "ée", "12 3", "1 23", "123",
    ]
    df = spark.createDataFrame([(i, v, i % 3 if i < 0 else 1) for i, v in enumerate(values)], "id long, v string, n int")
    got = _rows(_copies(df, "id", ["v", "n"]))
    same = [[0, 7, 8], [4, 5], [9, 10, 11, 12], [13, 14, 15], [16, 17], [19, 20], [21, 22], [23, 24, 25]]
    assert got == {(g[0], other) for g in same for other in g[1:]}
    assert {r["copies"] for r in _counted(df, "id", ["v", "n"]).where("id_a = 9").collect()} == {4}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=3), min_size=1, max_size=5), st.data())
def test_joined_words_against_all_orders(fine, data):
    coarse = data.draw(st.lists(st.text("ab", min_size=1, max_size=5), min_size=1, max_size=4))

    def splits(words):
        if not words:
            return {()}
        return {tuple(sorted((*rest, head))) for n in range(1, len(words) + 1) for chosen in itertools.permutations(range(len(words)), n) if 0 in chosen
                for head in ["".join(words[i] for i in chosen)] for rest in splits([w for i, w in enumerate(words) if i not in chosen])}

    assert dedupe.joined(fine, coarse) == (tuple(sorted(coarse)) in splits(fine))


def test_a_hot_line_is_counted_once_for_each_id(spark):
    hot = spark.range(4_000).selectExpr("id", "'Naso - tonganus' as v").union(spark.range(4_000).selectExpr("id", "'Naso - tonganus' as v"))
    df = hot.union(spark.range(4_000, 6_000).selectExpr("id", "concat(repeat(' ', cast(id % 50 as int)), 'tonganus naso')"))
    assert _rows(_counted(df, "id", ["v"])) == {(0, 6_000)}
    assert _copies(df, "id", ["v"]).count() == 5_999


# 3


def _vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 60), width)) * 10
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width))


def test_neighbours_recall_and_edges(spark):
    x = _vectors(1500, 8, 2)
    bad = [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 8), (5003, [None] * 8), (None, x[0].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad + [(0, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "fid long, v array<double>, id int, code string")
    asked = spark.createDataFrame([(i,) for i in range(0, 1500, 50)] + [(5001,), (99999,), (0,)], "id long")
    got: dict = {}
    for r in vectors.nearest(df, asked, "fid", "v", 8, 5).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    assert set(got) == set(range(0, 1500, 50)) and all(len(v) == 5 for v in got.values())
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9
    # More bits, probed within two, in few cells: as a table of many rows would have.
    crowded = vectors.nearest(df, asked, "fid", "v", 8, 5, plan=vectors.Layout(20_000, 2, 2, 12, 2))
    exact = {(q, int(i)) for q in range(0, 1500, 50) for i in np.argsort([*((x[:q] - x[q]) ** 2).sum(axis=1), np.inf, *((x[q + 1 :] - x[q]) ** 2).sum(axis=1)])[:5]}
    assert len(_rows(crowded.select("query", "id")) & exact) >= 0.9 * len(exact)
    few = df.where("fid < 3")
    assert {(r["query"], r["id"]) for r in vectors.nearest(few, asked, "fid", "v", 8, 5).collect()} == {(0, 1), (0, 2)}
    assert vectors.nearest(df.where("false"), asked, "fid", "v", 8, 5).count() == 0


def test_the_layout_grows_with_the_rows():
    plans = [vectors.layout(10**n) for n in range(0, 11)]
    assert [p.bits for p in plans] == sorted(p.bits for p in plans) and plans[-1].bits == 16 and plans[4].bits == 8
    assert [p.cells for p in plans] == sorted(p.cells for p in plans) and all(p.sample <= 200_000 for p in plans)
    assert all(p.radius == 8 * (p.flips + 1) - 1 for p in plans)


# 4


def test_species_names(spark):
    rows = [("Ab", "Ab cd"), (" ab ", "Ab_Ab_cd"), (None, "cd, Ab"), ("Ab", "cd"), ("Ab", "A. cd"), ("Ab", "abCd"), (None, "cd"), ("Ab", None), ("Ab", " "), (None, "cd Ab"), ("Abel", "AbelCd")]
    got = [r["n"] for r in spark.createDataFrame(rows, "g string, s string").select(splits.species_name(F.col("g"), F.col("s")).alias("n")).collect()]
    assert got == ["ab cd", "ab cd", "ab cd", "ab cd", "ab cd", "ab cd", None, None, None, "ab cd", "abel cd"]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)] + [(7, 7), (None, 3)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    groups: dict = {}
    for v in list(parent):
        groups.setdefault(find(v), set()).add(v)
    got: dict = {}
    for r in splits.components(spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(r["root"], set()).add(r["v"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_groups_and_splits(spark):
    rows = [(1, "Beta", "beta xus", 1), (1, "Alfa", "Alfa mus", 1), (2, "Alfa", "MUS Alfa", 1), (3, "Gamma", "Gamma cus", 1), (4, "Gamma", None, 1), (None, "Gamma", "G. cus", 1)]
    df = spark.createDataFrame(rows, "image_id int, genus string, species string, v int")
    assert _rows(splits.image_groups(df)) == {(1, "alfa mus"), (2, "alfa mus"), (3, "gamma cus")}
    assert splits.image_groups(df.where("false")).count() == 0
    many = spark.range(6000).select(F.concat(F.lit("g"), F.pmod("id", F.lit(300))).alias("group_key"))
    shares = {r["split"]: r["w"] / 6000 for r in splits.group_splits(many, {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    assert abs(shares["train"] - 0.7) < 0.02 and abs(shares["test"] - 0.15) < 0.02


def test_splits_of_the_tables_keep_groups_whole_and_their_shares(spark):
    from tarnwick.llm.queries import SHARES, p4_splits

    rows = p4_splits(spark, "/root/testdata/sf0.01").cache()
    assert rows.count() == rows.select("image_id").distinct().count() > 4_000
    assert rows.groupBy("group_key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    found = {r["split"]: r["count"] / rows.count() for r in rows.groupBy("split").count().collect()}
    assert all(abs(found[name] - share) < 0.02 for name, share in SHARES.items())


# 5


def _colours(rng, n):
    return np.hstack([rng.random((n, 15)), np.sort(rng.random((n, 5)), axis=1)[:, ::-1], rng.random((n, 9))])


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = _colours(rng, 12)
    x = np.round(base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 29)) * 0.004, 6)
    x[0], x[1] = base[0], base[0]
    x[0][0], x[1][0] = 0.999, 0.001
    x[:2, 15:20] = [0.3, 0.2995, 0.2, 0.1, 0.05]
    x[1][[0, 1, 2, 3, 4, 5]] = x[1][[3, 4, 5, 0, 1, 2]]
    rows = [(i, v[:20].tolist(), v[20:].tolist()) for i, v in enumerate(x)] + [(900, None, x[0][20:].tolist()), (901, [1.0], x[0][20:].tolist()), (902, [float("inf")] * 20, x[0][20:].tolist()), (3, x[3][:20].tolist(), x[3][20:].tolist())]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "fid long, dom array<double>, side array<double>, id int, x int")
    pts = clusters.points(df, "fid", "dom", "side")
    assert pts.count() == 300
    every = np.hstack([x[:, :20], x[:, 20:26]])
    assert clusters.distances(every[:1].copy(), every[1:2].copy(), 0.002)[0] < 0.25
    alike = [clusters.distances(np.repeat(every[[i]], 300, 0), every.copy(), 0.002) < 0.25 for i in range(300)]
    want = {(i, int(np.flatnonzero(a)[0])) for i, a in enumerate(alike) if a.sum() >= 3}
    grouped = clusters.members(clusters.cluster(pts, 0.25, 0.002), 3)
    assert _rows(grouped.select("id", "cluster_id")) == want
    told = clusters.describe(pts, grouped, 3).collect()
    assert sum(r["size"] for r in told) == len(want) and all(r["medoid"] == r["typical"][0] and len(r["typical"]) == 3 for r in told)
    none = clusters.points(df.where("false"), "fid", "dom", "side")
    assert clusters.members(clusters.cluster(none, 0.25, 0.002), 3).count() == 0


def test_values_keep_all_their_decimals_and_equal_shares_cost_one_row_a_table(spark):
    x = np.zeros((40, 29))
    # The last four blocks are empty: their orders are one and the same, the first block stands in five places.
    x[:, 0] = 0.12345678 + np.arange(40) * 1e-8
    df = spark.createDataFrame([(i, v[:20].tolist(), v[20:].tolist()) for i, v in enumerate(x)], "fid long, dom array<double>, side array<double>")
    pts = clusters.points(df, "fid", "dom", "side")
    got = {r["id"]: clusters._unpacked(pa.array([bytes(r["x"])]))[0] for r in pts.collect()}
    assert all((got[i][:20] == x[i, :20]).all() for i in range(40))
    assert 160 <= clusters._in_buckets(pts, lambda v: clusters.buckets(v, 1, 4, 10, 0.3), 0.002).count() <= 5 * 160
    # Just inside and outside of the radius: the difference lies in the eighth decimal.
    ends = np.zeros((6, 29))
    ends[:3, 1], ends[3:, 1] = 0.1, 0.1 + np.array([0.24999999, 0.24999999, 0.24999999])
    many = spark.createDataFrame([(i, v[:20].tolist(), v[20:].tolist()) for i, v in enumerate(ends)], "fid long, dom array<double>, side array<double>")
    assert {r["cluster_id"] for r in clusters.members(clusters.cluster(clusters.points(many, "fid", "dom", "side"), 0.25, 0.002), 3).collect()} == {0}
    ends[3:, 1] += 2e-8
    many = spark.createDataFrame([(i, v[:20].tolist(), v[20:].tolist()) for i, v in enumerate(ends)], "fid long, dom array<double>, side array<double>")
    assert {r["cluster_id"] for r in clusters.members(clusters.cluster(clusters.points(many, "fid", "dom", "side"), 0.25, 0.002), 3).collect()} == {0, 3}


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_rows_without_block_order_are_no_further_apart_and_packing_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((20, 26)), rng.random((20, 26))
    gap = np.sqrt(((clusters._orderless(a) - clusters._orderless(b)) ** 2).sum(axis=1))
    for order in itertools.permutations(range(5)):
        assert (gap <= np.sqrt(clusters._apart(a[:, clusters._columns(list(order))].copy(), b)) + 1e-12).all()
    a[::2], b[0], b[1, 3] = np.round(a[::2], 6), -0.0, 1e300
    for x in (a, b, a[:0]):
        assert clusters._unpacked(clusters._packed(x)).tobytes() == x.tobytes()


@pytest.mark.parametrize("bits", [6, 14, 22])
def test_rows_at_the_radius_meet_with_the_same_chance(bits):
    rng = np.random.default_rng(bits)
    a = np.tile([0.5] * 26, (400, 1))
    step = rng.normal(size=a.shape)
    step[:, clusters.HUES] = 0
    b = a + step / np.linalg.norm(step, axis=1, keepdims=True) * 0.2499
    tables = clusters.tables_for(bits, 0.9)
    met = (clusters.buckets(a, 3, tables, bits, clusters.CELL * 0.25) == clusters.buckets(b, 3, tables, bits, clusters.CELL * 0.25)).any(axis=1)
    assert 0.8 < met.mean() <= 1


def test_a_pivot_with_many_members_is_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(clusters, "HOT_ROWS", 50)
    rng = np.random.default_rng(8)
    x = np.repeat(_colours(rng, 2), [700, 40], axis=0) + rng.normal(size=(740, 29)) * 0.003
    df = spark.createDataFrame([(i, v[:20].tolist(), v[20:].tolist()) for i, v in enumerate(x)], "fid long, dom array<double>, side array<double>")
    pts = clusters.points(df, "fid", "dom", "side")
    told = clusters.describe(pts, clusters.members(clusters.cluster(pts, 0.25, 0.002), 3), 5).collect()
    assert {(r["cluster_id"], r["size"]) for r in told} == {(0, 700), (700, 40)}


def test_typical_rows_of_a_cluster_in_both_block_orders(spark):
    rng = np.random.default_rng(6)
    base = np.hstack([[0.99, 0.9, 0.9, 0.3, 0.1, 0.2], rng.random(9), [0.3, 0.3, 0.2, 0.15, 0.05], rng.random(9)])
    x = np.repeat(base[None], 40, 0)
    x[:, 1] += np.linspace(-0.05, 0.05, 41)[np.arange(40) + (np.arange(40) >= 20)]
    x[:, 0] = (x[:, 0] + rng.normal(size=40) * 0.001) % 1.0
    x[20] = base
    order = [3, 4, 5, 0, 1, 2]
    x[::3, :6] = x[::3][:, order]
    x = np.round(x, 6)
    pts = clusters.points(spark.createDataFrame([(i, v[:20].tolist(), v[20:].tolist()) for i, v in enumerate(x)], "fid long, dom array<double>, side array<double>"), "fid", "dom", "side")
    (told,) = clusters.describe(pts, clusters.members(clusters.cluster(pts, 0.25, 0.002), 3), 5).collect()
    every = np.hstack([x[:, :20], x[:, 20:26]])
    sums = np.array([(clusters.distances(np.repeat(every[[i]], 40, 0), every.copy(), 0.002) ** 2).sum() for i in range(40)])
    assert told["size"] == 40 and told["medoid"] == np.argmin(sums) == 20
    assert set(told["typical"]) == set(np.argsort(sums)[:5].tolist())


@pytest.mark.parametrize("swapped", [0, 1])
def test_rows_come_into_the_order_of_their_pivot(swapped):
    a = np.linspace(0.02, 0.98, 26)[None]
    a[0, 15:20] = [0.3, 0.2, 0.2, 0.15, 0.1]
    b = a[:, clusters._columns([0, 2, 1, 3, 4])]
    pair = (a, b) if swapped else (b, a)
    assert (clusters.aligned(*pair, 0.002) == pair[1]).all()
    assert (clusters._centre(clusters._embed(a)).round(9) == a.round(9)).all()


# 6


def _reference():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


REFERENCE = _reference()
ENCODER = encoding.Encoder(VOCABULARY)
PIECES = st.sampled_from(["'s", "'re", "'", "a", "Ж", "7", "²", " ", "  ", "\n", "\t", " ", "\r\n", "!", "🐟", "é", "é", "<|endoftext|>", "_"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PIECES, st.text(max_size=6)), max_size=12).map("".join))
def test_ids_equal_the_reference(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, offsets, _ = ENCODER.chunk([text, "x", text])
    want = REFERENCE.encode_ordinary(text)
    assert ids[offsets[0] : offsets[1]].tolist() == want and ids[offsets[2] : offsets[3]].tolist() == want


@pytest.mark.parametrize("rounds", [10, 11, 12])
def test_pieces_of_one_hash_keep_their_own_ids(rounds):
    word = "a"
    for _ in range(rounds):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    ids, upto, starts = ENCODER.chunk([word, other, f"{other} {word}", word])
    for k, text in enumerate([word, other, f"{other} {word}", word]):
        assert ids[upto[k] : upto[k + 1]].tolist() == REFERENCE.encode_ordinary(text)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_PIECES", 3)
    encoder, texts = encoding.Encoder(VOCABULARY), ["zqx wvu", "kjh zqx", "tre wqa zqx", "wvu"]
    ids, upto, _ = encoder.chunk(texts)
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:])] == [REFERENCE.encode_ordinary(t) for t in texts] and len(encoder.cache) <= 3


def test_encode_and_decode(spark):
    texts = [(1, "Hello it's 2024\r\n\n  <|endoftext|>"), (2, ""), (3, None), (4, "ab " * 70_000), (5, "x" * 20_000), (1, "Hello it's 2024\r\n\n  <|endoftext|>")]
    df = spark.createDataFrame([(*t, 1, [2]) for t in texts], "doc long, body string, key int, ids array<int>")
    coded = encoding.encode(df, "doc", "body", VOCABULARY, offsets=True).cache()
    got = {r["doc"]: r for r in coded.collect()}
    assert got[2]["ids"] == [] and got[3]["ids"] == [] and len(got[4]["starts"]) == len(got[4]["ids"])
    for doc, text in texts:
        assert got[doc]["ids"] == REFERENCE.encode_ordinary(text or "")
    back = {r["doc"]: r["text"] for r in encoding.decode(coded, "doc", "ids", VOCABULARY).collect()}
    assert back == {doc: text or "" for doc, text in texts}
    placed = {r["doc"]: (r["text"], r["placed"]) for r in encoding.decode(coded, "doc", "ids", VOCABULARY, "starts").collect()}
    assert placed == {doc: (text or "", True) for doc, text in texts}
    moved = coded.withColumn("starts", F.transform("starts", lambda s: s + 1))
    assert {r["doc"] for r in encoding.decode(moved, "doc", "ids", VOCABULARY, "starts").where("not placed").collect()} == {1, 4, 5}
    assert encoding.encode(df.where("false"), "doc", "body", VOCABULARY).count() == 0


# 7

ITEM = "It was the woollen glazier who rewrote the buttons of Cuzewick above the cracked sundial. The muddy bakery of Lamuwick abandoned 316 tilted masks near the lacquered vault. Years later 358 receipts without the rival treaty were all that the beekeeper dismantled. Who kept the list?"


def test_leaks(spark):
    s = ITEM.split(". ")
    two = f"{s[0]}. {s[1]}."
    docs = {
        1: ITEM, 2: "Before. " + two + " After.", 3: s[0] + ".", 4: two.upper(), 5: two.replace("buttons", "[[x|buttons]]").replace("bakery", "ba-\nkery"), 6: two.replace("e", "е"),
        7: two.replace("glazier", "tinker").replace("buttons", "hats").replace("Cuzewick", "Lopowick").replace("cracked", "oily").replace("sundial", "anchor").replace("muddy", "blunt").replace("bakery", "chapel").replace("masks", "goats"),
        8: two.replace("woollen ", "").replace("316", "317"), 9: "", 10: None, 11: "unrelated words only. " * 50_000 + two, 12: "{{quote|" + two + "}}", 13: s[1] + ". " + s[0] + ".",
    }
    df = spark.createDataFrame([(k, v, 1, "t") for k, v in docs.items()] + [(1, ITEM, 1, "t")], "doc long, body string, item int, text string")
    items = spark.createDataFrame([(7, ITEM, 0), (8, None, 0), (9, "", 0)], "iid long, body string, code int")
    found = leakage.leaks(df, "doc", "body", items, "iid", "body")
    got = {(r["id"], r["item"]) for r in found.where("sentences >= least(2, of)").collect()}
    assert got == {(d, 7) for d in (1, 2, 4, 5, 6, 8, 11, 12)}
    assert leakage.leaks(df.where("false"), "doc", "body", items, "iid", "body").count() == 0
    assert leakage.leaks(df, "doc", "body", items.where("false"), "iid", "body").count() == 0


def test_a_closing_instruction_is_no_passage(spark):
    ask = "Name the place described above."
    bodies = [f"{ITEM.split('. ')[0]}. The muddy bakery of Lamuwick abandoned 316 tilted masks near the lacquered vault number {w}." for w in ("alpha", "beta", "gamma")]
    items = spark.createDataFrame([(k, f"{b} {ask}") for k, b in enumerate(bodies)] + [(5, bodies[0]), (6, bodies[0])], "iid long, body string")
    df = spark.createDataFrame([(1, bodies[0]), (2, "Other words. " + bodies[0].split(". ")[1] + " " + ask)], "doc long, body string")
    got = {(r["id"], r["item"]): r for r in leakage.leaks(df, "doc", "body", items, "iid", "body").collect()}
    assert all(r["of"] == 2 for r in got.values()) and got[1, 0]["sentences"] == got[1, 5]["sentences"] == 2
    assert all(r["sentences"] < 2 for (doc, _), r in got.items() if doc == 2)


def test_sentences_are_sought_at_every_place():
    s = [x.rstrip(".") + "." for x in ITEM.split(". ")[:3]]
    judged = lambda text: leakage.judge(leakage.passages(ITEM), leakage.plain_words(text), 0.75)[:2]
    far = " unrelated words only." * 30
    assert judged(s[0] + far + s[0] + " " + s[1]) == (2, 1.0)
    cut = [x.replace("woollen ", "").replace("tilted ", "") for x in s]
    got = judged(cut[0] + " " + s[1] + far + s[0] + " " + cut[1])
    assert got[0] == 2 and 0.9 < got[1] < 1
    assert judged(s[0] + far + s[1] + far + s[0]) == (1, 1.0)
    assert judged(s[1] + " " + s[0]) == (1, 1.0)
    assert judged((s[0] + " ") * 300 + s[1] + " " + s[2]) == (3, 1.0)


def test_a_template_with_other_slots_is_a_leak_only_if_they_are_replaced_one_to_one(spark):
    body = "In 1871 the miller of Cuzewick sold 316 sacks to Lamuwick for 20 coins. After 1872 the roads between Lamuwick and Cuzewick carried 40 carts of grain each day. Nobody in Cuzewick ever counted them."
    told = body.replace("1871", "1911").replace("1872", "1912").replace("316", "90").replace("20", "7").replace("40", "66").replace("Cuzewick", "Solustad").replace("Lamuwick", "Betihollow")
    docs = {
        1: told, 2: told.replace("Betihollow", "Solustad"), 3: told.replace("After 1912 the roads between Betihollow and Solustad", "After 1912 the roads between Fisolith and Vedolith"),
        4: told.replace("miller", "baker").replace("sacks", "spoons").replace("roads", "ferries").replace("carts", "boats").replace("grain", "salt").replace("coins", "kettles").replace("sold", "lent").replace("carried", "moved"),
        5: "x {{note|" + told + "}} y", 6: body, 7: told.split(". ")[0] + ".",
    }
    df = spark.createDataFrame(list(docs.items()), "doc long, body string")
    items = spark.createDataFrame([(1, body)], "iid long, body string")
    got = {r["id"]: r for r in leakage.leaks(df, "doc", "body", items, "iid", "body").collect()}
    assert {d for d, r in got.items() if r["sentences"] >= 2} == {1, 5, 6}
    assert got[1]["changed"] >= 6 and got[1]["inconsistent"] == 0 and got[6]["changed"] == 0
    names = {"cuzewick", "lamuwick", "solustad", "betihollow"}
    judged = {d: leakage.judge(leakage.passages(body), leakage.plain_words(docs[d]), 0.75, names) for d in (1, 2)}
    assert judged[1][0] == 3 and judged[2][0] < 2


def test_notes_and_templates_of_any_length(spark):
    s = [x.rstrip(".") + "." for x in ITEM.split(". ")[:3]]
    note = "<ref>" + "see the long list of sources " * 40 + "</ref>"
    docs = {
        1: s[0].replace("buttons", "buttons" + note) + " " + s[1], 2: "{{quote|" + s[0] + "}} " + s[1], 3: "<ref>" + s[0] + " " + s[1] + "</ref>", 4: "{{a|{{b|" + s[1] + " " + s[2] + "}} c",
        5: s[0] + " {{box|" + "other words " * 60 + "}} " + s[1], 6: "{{" * 3_000 + s[0] + " " + s[1] + "}}" * 2_000, 7: s[0] + note,
    }
    df = spark.createDataFrame(list(docs.items()), "doc long, body string")
    items = spark.createDataFrame([(1, ITEM)], "iid long, body string")
    assert _rows(leakage.leaks(df, "doc", "body", items, "iid", "body").where("sentences >= 2").select("id")) == {(d,) for d in (1, 2, 3, 4, 5, 6)}


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = _rows(leakage.leaks(docs, "doc_id", "text", items, "item_id", "text"))
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 70)
    assert _rows(leakage.leaks(docs, "doc_id", "text", items, "item_id", "text")) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), st.lists(st.sampled_from("abcdx"), max_size=40))
def test_placements_against_brute_force(sentence, words):
    places: dict = {}
    for p, word in enumerate(words):
        places.setdefault(word, []).append(p)
    doc = leakage.Document(words)
    got = leakage._placements(sentence, places, doc.counted, 0.75)
    whole = lambda a, b: len(leakage._hits([doc.counted(w) for w in sentence], words[a : b + 1])) / len(sentence)
    assert all(whole(a, b) == share >= 0.75 for a, b, share in got)
    for a in range(len(words)):
        for b in range(a, min(len(words), a + len(sentence) + 20)):
            if whole(a, b) >= 0.75:
                assert any(a <= c and d <= b and share >= 0.75 for c, d, share in got)


# 8

ENGLISH = ["The young fish sleeps near the outer reef during the day.", "It returns to the lagoon when the water is warm.", "Few divers have ever seen the whole school at once.", "The tail is longer than the body of the male."]
GERMAN = ["Der junge Fisch schläft am Tag nahe dem äußeren Riff.", "Er kehrt in die Lagune zurück, wenn das Wasser warm ist.", "Nur wenige Taucher haben je den ganzen Schwarm gesehen.", "Der Schwanz ist länger als der Körper des Männchens."]


def test_code_lengths_equal_a_plain_model():
    text = b"abracadabra abc"
    model = language.Ppm({"en": text, "de": b"zzzz yyyy"})
    padded = b" " * language.ORDER + text

    def bits(context, byte):
        if len(context) < 0:
            return 8.0
        follow = [padded[i + len(context)] for i in range(language.ORDER - len(context), len(padded) - len(context)) if padded[i : i + len(context)] == context]
        kinds, total = len(set(follow)), len(follow)
        below = (lambda: bits(context[1:], byte)) if context else (lambda: 8.0)
        if not total:
            return below()
        n = follow.count(byte)
        return -np.log2(n / (total + kinds)) if n else -np.log2(kinds / (total + kinds)) + below()

    for word in ("abra", "cab", "q", "zz"):
        data = (" " * language.ORDER + " " + word).encode()
        want = sum(bits(data[i - language.ORDER : i], data[i]) for i in range(language.ORDER, len(data)))
        assert model.lengths([word])[0][0][model.languages.index("en")] == pytest.approx(want, rel=1e-5)


def test_languages(spark):
    rng = np.random.default_rng(0)
    mix = lambda s: " ".join(s[i] for i in rng.permutation(4))
    rows = [(i, mix(ENGLISH), "en" if i % 9 else "de") for i in range(60)] + [(100 + i, mix(GERMAN), "de_DE" if i % 9 else "eng") for i in range(60)]
    rows += [(500, mix(ENGLISH), None), (501, mix(ENGLISH), "ENG"), (502, mix(GERMAN) + "\r\n\r\n" + mix(ENGLISH), "de"), (503, ENGLISH[0], "de"), (504, "", "en"), (505, None, "de"), (506, "== x ==\n{| a\n|-\n| b || c\n|}", "fr"), (507, "asdkj qwe zxmn qpwo. lkjas dqwe mnzx vbnq. " * 3, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc long, body string, label string, id int")
    model = language.fit(df, "doc", "body", "label")
    found = {(r["id"], r["lang"]): r for r in language.document_languages(df, "doc", "body", "label", model).collect()}
    assert found[(500, "en")]["label"] is None and found[(501, "en")]["label"] == "en"
    assert found[(502, "de")]["languages"] == 2 and (502, "en") in found
    assert not {503, 504, 505, 506} & {i for i, _ in found}
    assert all(r["lang"] == "en" for (i, _), r in found.items() if i < 60) and all(r["lang"] == "de" for (i, _), r in found.items() if 100 <= i < 160)
    assert all(0 < r["confidence"] <= 1 for r in found.values())
    cases = {
        600: ("\n\n".join(GERMAN), None, {"de"}), 601: ("\r\n\r\n".join(ENGLISH + GERMAN), "en", {"en", "de"}), 602: (f"{ENGLISH[0]}\n\n== x ==\n\n{ENGLISH[1]}", None, {"en"}),
        603: ("{{quote|text=" + " ".join(GERMAN) + "}}", None, {"de"}), 604: (" ".join(ENGLISH[:2]) + "<ref>" + " ".join(GERMAN) + "</ref>", None, {"en"}),
        605: (f"{GERMAN[0]}\n\n{ENGLISH[0]}\n\n{ENGLISH[1]}", None, {"en"}), 606: ("The fish sleeps. It returns.", None, {"en"}), 607: ("{{" * 2_000 + " ".join(ENGLISH) + "}}" * 1_000, None, {"en"}),
        610: (" ".join(ENGLISH[:2] + [x.upper() for x in ENGLISH]), None, {"en"}), 611: (" ".join(GERMAN).upper(), None, {"de"}),
        612: ("~~~~ $%*!*!?$*?\n\n~~~~ $%*!*!*!?$*?", None, set()), 613: ("Dr. " + GERMAN[0], "en", set()),
        608: (" ".join(ENGLISH) * 3_000, None, {"en"}), 609: ("{{x|a=1|" + ENGLISH[0] + "}}", None, set()),
    }
    also = spark.createDataFrame([(i, text, label, 1) for i, (text, label, _) in cases.items()] * 2, "doc long, body string, label string, id int")
    got = _rows(language.document_languages(also, "doc", "body", "label", model).select("id", "lang"))
    assert got == {(i, lang) for i, (_, _, want) in cases.items() for lang in want}
    empty = df.where("false")
    assert language.document_languages(empty, "doc", "body", "label", language.fit(empty, "doc", "body", "label")).count() == 0
