"""The registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import numeric as N
from tarnwick.functions import text as X
from tarnwick.operators import aggregates as A
from tarnwick.operators import images as I
from tarnwick.operators import joins as J
from tarnwick.operators import matrix as M
from tarnwick.operators import ranking as R
from tarnwick.operators import trees as T
from tarnwick.operators import validation as V
from tarnwick.session import durable, shared_folder, table
from tarnwick.sources import readers, sinks
from tarnwick.streaming import gates

GROUPS = {"hue_hist": 18, "sat_hist": 8, "val_hist": 8, "dom_colours": 20, "dorsal_ventral": 9, "gabor": 24, "lbp": 10, "entropy": 2}
#: Parameters of the queries on names: initials and colours of some genera.
SHORT = {"Tufalsoma": "T.", "Cemildonis": "C.", "Langnatha": "L.", "Zulirsoma": "Z."}
COLOURS = {"Tufalsoma": "#4fc3f7", "Cemildonis": "#81c784", "Langnatha": "#ffb74d", "Zulirsoma": "#ff8a65"}
#: Parts of names that stand for a plain, a patterned, a striped and a smooth species in the checks.
ANCHORS = {"plain": "fudantoina", "patterned": "bosilvoina", "striped": "nucungaum", "smooth": "remenmeum"}
#: Genera of the checks: the first two are expected closer to each other than to the others.
GENERA = ["tufalsoma", "cemildonis", "langnatha", "zulirsoma"]
SIGNAL = ["dorsal_ventral", "hue_hist", "entropy", "sat_hist"]
Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Rows sent twice, once: they repeat their content, so any of them will do."""
    return rows.drop("arrived_at").distinct() if key is None else rows.dropDuplicates([key])


def features(spark: SparkSession, d: str) -> DataFrame:
    return _once(table(spark, d, "image_features"), "feature_id")


def sound_features(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    rows = features(spark, d)
    return reduce(lambda df, c: df.where(N.sound(F.col(c), GROUPS[c])), fields, rows)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Scalars, projections, filters


@query
def clean_filename(spark, d):
    name = F.col("original_file")
    return table(spark, d, "standardization_log").select("log_id", X.clean_filename(X.stem(name)).alias("clean"), X.suffix(name).alias("suffix")).distinct()


@query
def path_parts(spark, d):
    path = F.col("image_path")
    return table(spark, d, "extraction_log").select("log_id", X.parent(path).alias("folder"), X.stem(path).alias("stem"), X.suffix(path).alias("suffix")).distinct()


@query
def clean_label(spark, d):
    label = F.col("species")
    rows = table(spark, d, "annotation_log").where(label.isNotNull() & (F.size(X.words(label)) > 0)).select("species").distinct()
    return rows.select(
        "species", X.short_label(label).alias("short"), X.last_words(label, 1).alias("epithet"), X.last_words(label, 2).alias("pair"),
        F.get(X.words(label), F.lit(0)).alias("genus"), X.newick_label(label).alias("newick"),
    )


@query
def composite_key(spark, d):
    rows = features(spark, d).where("genus is not null and species is not null")
    return rows.groupBy(F.concat_ws(" ", "genus", "species").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query
def selected_features(spark, d):
    rows = sound_features(spark, d, SIGNAL)
    chosen = F.concat(*SIGNAL)
    return rows.select("feature_id", F.size(chosen).alias("n"), _r(N.array_sum(chosen)).alias("total"), _r(F.get(chosen, F.lit(9))).alias("tenth"))


@query
def finite_values(spark, d):
    rows = features(spark, d).where("gabor is not null")
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    count = F.size(F.filter("gabor", bad))
    total = N.array_sum(F.transform("gabor", lambda v: F.coalesce(N.finite_or_zero(v), F.lit(0.0))))
    return rows.select("feature_id", count.alias("bad"), _r(total, 6).alias("total"))


@query
def quality_gate(spark, d):
    score, area = F.col("sam_score"), F.col("mask_area_frac")
    gate = F.when(score < 0.70, "LOW_CONFIDENCE").when(area < 0.10, "LOW_CONFIDENCE").when(area > 0.90, "LOW_CONFIDENCE").when(score.isNull(), "FAILED").otherwise("OK")
    reason = F.when(score < 0.70, "score").when(area < 0.10, "small").when(area > 0.90, "large").otherwise("")
    lines = table(spark, d, "annotation_log").select("log_id", "sam_score", "mask_area_frac", "status").distinct()
    return lines.groupBy(gate.alias("gate"), reason.alias("reason"), F.upper("status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def size_gate(spark, d):
    pixels = F.col("n_fish_pixels")
    lines = table(spark, d, "extraction_log").select("log_id", "genus", "n_fish_pixels").distinct()
    return lines.groupBy("genus").agg(F.count_if(pixels < 100_000).alias("small"), F.count_if(pixels >= 100_000).alias("large"), F.count_if(pixels.isNull()).alias("missing"))


@query
def binarised(spark, d):
    rows = table(spark, d, "events")
    return rows.groupBy("event_type").agg(F.count_if(F.col("value") > 127).alias("over"), F.count_if(F.col("value") <= 127).alias("under"))


@query
def title_filter(spark, d):
    rows = table(spark, d, "documents")
    hits = rows.where(F.contains(F.lower("title"), F.lit("naso"))).groupBy("page_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"), F.count_if(F.contains("title", F.lit("naso"))).alias("same_case"))
    return hits


@query
def square_geometry(spark, d):
    size = F.split(F.lower("original_size"), "x")
    rows = table(spark, d, "standardization_log").where(F.col("original_size").rlike("^[0-9]+x[0-9]+$")).select("log_id", size[0].cast("int").alias("w"), size[1].cast("int").alias("h")).distinct()
    return rows.select("log_id", "w", "h", *[(_r(c) if n == "scale" else c).alias(n) for n, c in N.fit_square(F.col("w"), F.col("h"), 1024).items()])


@query
def colour_space(spark, d):
    rgb = [F.pmod(F.col("l_quantity").cast("int") * 37, F.lit(256)), F.pmod(F.col("l_partkey").cast("int") * 13, F.lit(256)), F.pmod(F.col("l_suppkey").cast("int") * 7, F.lit(256))]
    pixels = table(spark, d, "lineitem").select("l_returnflag", *[c.alias(n) for c, n in zip(rgb, "rgb")])
    r, g, b = map(F.col, "rgb")
    return pixels.groupBy("l_returnflag").agg(_r(F.avg(N.hue8(r, g, b)), 4).alias("hue"), _r(F.avg(N.saturation8(r, g, b)), 4).alias("saturation"), F.sum(F.greatest(r, g, b)).alias("value"), F.sum(N.grey(r, g, b)).alias("grey"))


@query
def swatch_colours(spark, d):
    rows = sound_features(spark, d, ["dom_colours"])
    block = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("block")
    parts = rows.select("feature_id", "dom_colours", block).select("feature_id", "block", *[F.get("dom_colours", F.col("block") * 3 + i).alias(c) for i, c in enumerate("hsv")])
    rgb = N.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    return parts.select("feature_id", "block", *[_r(rgb[c]).alias(c) for c in "rgb"])


@query
def flattened_pixels(spark, d):
    """Half-transparent pixels on white and their luminance, summed by flag."""
    c = lambda name, k: F.pmod(F.col(name).cast("int") * k, F.lit(256)).cast("int")
    pixels = table(spark, d, "lineitem").select("l_returnflag", c("l_quantity", 37).alias("r"), c("l_partkey", 13).alias("g"), c("l_suppkey", 7).alias("b"), c("l_linenumber", 41).alias("a"))
    flat = pixels.select("l_returnflag", *[N.on_white(F.col(x), F.col("a")).alias(x) for x in "rgb"])
    return flat.groupBy("l_returnflag").agg(*[F.sum(x).alias(x) for x in "rgb"], F.sum(N.luminance(*map(F.col, "rgb"))).alias("l"), F.count_if(N.luminance(*map(F.col, "rgb")) > 127).alias("inside"))


@query
def normalised_colours(spark, d):
    """Mean of the normalised hue, saturation and value of each flag's pixels."""
    rgb = [F.pmod(F.col("l_quantity").cast("int") * 37, F.lit(256)), F.pmod(F.col("l_partkey").cast("int") * 13, F.lit(256)), F.pmod(F.col("l_suppkey").cast("int") * 7, F.lit(256))]
    pixels = table(spark, d, "lineitem").select("l_returnflag", *[c.alias(n) for c, n in zip(rgb, "rgb")])
    r, g, b = map(F.col, "rgb")
    scaled = N.normalised_hsv(N.hue8(r, g, b), N.saturation8(r, g, b), F.greatest(r, g, b))
    return pixels.groupBy("l_returnflag").agg(*[_r(F.avg(c), 5).alias(n) for n, c in scaled.items()])


@query
def boxes(spark, d):
    lines = table(spark, d, "lineitem")
    box = F.array(F.min("l_linenumber").cast("double"), F.min("l_quantity"), (F.max("l_linenumber") - F.min("l_linenumber")).cast("double"), F.max("l_quantity") - F.min("l_quantity"))
    made = lines.groupBy("l_suppkey").agg(box.alias("box"))
    return made.select("l_suppkey", *[N.corners(F.col("box"))[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], N.mirrored(F.col("box"), F.lit(100.0))[0].alias("mirrored"), N.rotation(F.pmod("l_suppkey", F.lit(9))).alias("turn"))


@query
def histogram_entropy(spark, d):
    return sound_features(spark, d, ["hue_hist"]).select("feature_id", _r(N.entropy(F.col("hue_hist"))).alias("entropy"))


@query
def feature_summary(spark, d):
    """Each feature by its name: its sound rows, mean and bounds, from one read."""
    rows = features(spark, d)
    parts = F.array(*[F.struct(F.lit(g).alias("grp"), F.when(N.sound(F.col(g), n), F.col(g)).alias("f")) for g, n in GROUPS.items()])
    long = rows.select(F.explode(parts).alias("p")).select("p.grp", F.posexplode("p.f").alias("pos", "v"))
    stats = long.groupBy("grp", "pos").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("v"), 5).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return stats.select(_feature(F.col("grp"), F.col("pos")).alias("feature"), "n", "mean", "low", "high")


def _feature(group, pos):
    return F.coalesce(*[F.when(group == g, X.feature_name(g, pos)) for g in GROUPS])


@query
def short_names(spark, d):
    """Tip labels with the names of some genera cut to their initial."""
    return table(spark, d, "tree_tips").select("tip_id", X.replaced(F.col("tip_label"), SHORT).alias("name"))


@query
def genus_colours(spark, d):
    """The colour of each tip's genus, grey for genera without one."""
    genus = F.element_at(F.split("tip_label", "_"), 1)
    return table(spark, d, "tree_tips").select("tip_id", genus.alias("genus"), X.looked_up(genus, COLOURS, "#666677").alias("colour"))


@query
def percent_shares(spark, d):
    """Share of each status among the lines of annotation_log, as a percentage with one decimal."""
    lines = table(spark, d, "annotation_log").select("log_id", F.upper("status").alias("status")).distinct().groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = lines.agg(F.sum("n").alias("total"))
    return lines.join(F.broadcast(total)).select("status", "n", X.percent(F.col("n") / F.col("total")).alias("share"))


# Joins


@query
def annotation_join(spark, d):
    images = features(spark, d).select("feature_id", "image_id").where("image_id is not null")
    notes = table(spark, d, "annotation_log").select("image_id", F.upper("status").alias("status"), "log_id").distinct()
    return images.join(notes, "image_id").groupBy("status").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("feature_id").alias("features"))


@query
def unmatched_left_join(spark, d):
    images = features(spark, d).select("feature_id", "image_id")
    notes = table(spark, d, "annotation_log").select("image_id").where("image_id is not null").distinct().withColumn("noted", F.lit(True))
    return images.join(notes, "image_id", "left").groupBy(F.coalesce("noted", F.lit(False)).alias("noted")).agg(F.count(F.lit(1)).alias("n"))


@query
def semi_labels(spark, d):
    noted = table(spark, d, "annotation_log").where("image_id is not null")
    return features(spark, d).join(noted, "image_id", "left_semi").select("feature_id", "image_id")


@query
def anti_labels(spark, d):
    noted = table(spark, d, "annotation_log").where("image_id is not null")
    return features(spark, d).join(noted, "image_id", "left_anti").select("feature_id", "image_id")


@query
def label_cascade(spark, d):
    audit, tips = table(spark, d, "tree_tip_matching_audit"), table(spark, d, "tree_tips")
    return J.label_cascade(audit, tips, "visual_label", "tip_label", "tip_id")


@query
def matching_audit(spark, d):
    """How many labels each step of the cascade matched, and how many are dropped."""
    audit = J.matching_audit(table(spark, d, "tree_tip_matching_audit"), table(spark, d, "tree_tips"), "visual_label", "tip_label", "tip_id")
    return audit.groupBy("method", "in_tree").agg(F.count(F.lit(1)).alias("n"), F.min("visual_label").alias("first_label"))


@query
def epithet_join(spark, d):
    epithet = F.lower(X.last_words(F.col("species"), 1))
    rows = features(spark, d).where("species is not null").select("feature_id", epithet.alias("epithet"))
    tips = table(spark, d, "tree_tips").select("tip_id", "tip_label", F.lower(F.element_at(F.split("tip_label", "_"), -1)).alias("epithet"))
    return J.first_match(rows, tips, "epithet", "tip_label", "tip_id").select("feature_id", "tip_label")


@query
def aligned_labels(spark, d):
    name = lambda t: table(spark, d, t).select(F.lower(F.trim("genus")).alias("genus"))
    return J.aligned_keys([name("standardization_log"), name("annotation_log"), name("extraction_log"), name("image_features")], "genus")


@query
def aligned_distances(spark, d):
    """Feature and path distances of the genera that both tables hold, in the order of the tree's tips."""
    order = table(spark, d, "tree_tips").groupBy(F.lower(F.element_at(F.split("tip_label", "_"), 1)).alias("k")).agg(F.min("tip_id").alias("place"))
    seen, path = J.aligned_pairs([M.distances(_genera(spark, d, "gabor"), "genus", "mean"), _tree_distances(spark, d)])
    both = seen.join(path.select("a", "b", F.col("d").alias("p")), ["a", "b"])
    placed = J.in_order_of(both.withColumnRenamed("a", "k"), order, "k", "place").select(F.col("place").alias("pa"), F.col("k").alias("a"), F.col("b").alias("k"), "d", "p")
    return J.in_order_of(placed, order, "k", "place").select("pa", F.col("place").alias("pb"), "a", F.col("k").alias("b"), _r(F.col("d"), 5).alias("d"), _r(F.col("p"), 9).alias("p"))


@query
def remaining_images(spark, d):
    """Images with features that no successful annotation names: what a run that goes on has still to annotate."""
    log = table(spark, d, "annotation_log").select("image_id", F.upper("status").alias("status"))
    return J.remaining(features(spark, d).where("image_id is not null").select("feature_id", "image_id"), log, "image_id", F.col("status") == "OK")


@query
def continued_log(spark, d):
    """The best line of each annotated image followed by lines for the images that have none."""
    log = best_annotation(spark, d).select("image_id", "log_id", "strategy")
    added = features(spark, d).where("image_id is not null").select("image_id", F.lit("NEW").alias("status")).distinct()
    return J.continued(log, added, "image_id")


@query
def upserted_annotations(spark, d):
    """Best lines whose strategy is put right where an image has features, new images with ids after the largest."""
    base = best_annotation(spark, d).select("log_id", "image_id", "sam_score", "strategy")
    change = features(spark, d).where("image_id is not null").select("image_id", F.lit("again").alias("strategy")).distinct()
    return J.upsert_with_ids(base, change, "image_id", "log_id")


@query
def source_priority(spark, d):
    name = lambda t, c: table(spark, d, t).select(F.lower(F.trim("genus")).alias("genus"), F.col(c).alias("file"))
    return J.by_priority([name("extraction_log", "mask_path"), name("annotation_log", "file_name"), name("standardization_log", "original_file")], "genus", "file")


@query
def upserted_lines(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("lines"), F.sum("l_quantity").alias("quantity"))
    change = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("lines"), F.lit(0.0).alias("quantity"))
    return J.upsert(lines, change, "l_orderkey")


@query
def nearest_centroid(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    centres = A.mean_vector(rows.where("label is not null"), "label", "v", 64)
    return J.nearest_centre(rows, centres, "vec_id", "v", "label", "mean").select("vec_id", "nearest", _r(F.col("distance"), 5).alias("distance"))


# Aggregates


@query
def status_counts(spark, d):
    parts = [table(spark, d, t).select("log_id", F.lit(t).alias("tbl"), F.upper("status").alias("status")).distinct() for t in ("standardization_log", "annotation_log", "extraction_log")]
    return reduce(DataFrame.unionByName, parts).groupBy("tbl", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def genus_counts(spark, d):
    rows = table(spark, d, "standardization_log").select("log_id", F.lower(F.trim("genus")).alias("genus"), F.upper("status").alias("status")).distinct()
    ok = F.count_if(F.col("status") == "OK")
    return rows.groupBy("genus").agg(F.count(F.lit(1)).alias("total"), ok.alias("ok"), F.count_if(F.col("status") != "OK").alias("failed"))


@query
def genus_mean_vector(spark, d):
    rows = sound_features(spark, d, ["gabor"]).where("genus is not null")
    means = A.mean_vector(rows, "genus", "gabor", 24)
    return means.select("genus", "n", *[_r(F.col("mean")[i], 5).alias(f"m{i}") for i in range(24)])


@query
def genus_entropy(spark, d):
    rows = sound_features(spark, d, ["entropy"]).where("genus is not null").withColumn("e", F.col("entropy")[0])
    return rows.groupBy("genus").agg(_r(F.avg("e"), 9).alias("mean"), F.min("e").alias("low"), F.max("e").alias("high"), F.count(F.lit(1)).alias("n"))


@query
def slice_variance(spark, d):
    long = A.long_form(sound_features(spark, d, ["gabor"]), ["feature_id"], "gabor")
    return long.groupBy(F.floor(F.col("pos") / 6).cast("int").alias("angle")).agg(_r(F.var_pop("v"), 3).alias("variance"), F.min("v").alias("low"))


@query
def density_histogram(spark, d):
    return A.density_histogram(table(spark, d, "events"), "value", 0.0, 500.0, 20, "event_type").withColumn("density", _r(F.col("density"), 9))


@query
def cluster_frequencies(spark, d):
    counts = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", _r(F.col("n") / F.col("total")).alias("share"))


@query
def dorsal_ventral(spark, d):
    pixels = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_discount", "h").withColumnRenamed("l_tax", "s")
    means = A.region_means(pixels, "l_suppkey", "l_linenumber", ["h", "s"])
    return means.select("l_suppkey", *[_r(F.col(c), 9).alias(c) for c in means.columns[1:]])


@query
def energy_stats(spark, d):
    long = A.long_form(sound_features(spark, d, ["gabor"]), ["feature_id"], "gabor")
    return long.groupBy("pos").agg(_r(F.avg("v"), 5).alias("mean"), _r(F.stddev_pop("v"), 5).alias("deviation"))


@query
def best_filter(spark, d):
    energy = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(F.get("gabor", k * 2).alias("e"), (-k).alias("k")))
    best = F.array_max(energy)
    return sound_features(spark, d, ["gabor"]).select("feature_id", F.floor(-best["k"] / 3).cast("int").alias("angle"), (-best["k"] % 3).cast("int").alias("frequency"), best["e"].alias("energy"))


def _predicted(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_suppkey", (F.col("l_quantity") > 25).alias("predicted"), (F.col("l_extendedprice") > 40_000).alias("actual"), (F.col("l_quantity") / 50).alias("score"), "l_shipdate")


@query
def confusion(spark, d):
    counts = A.confusion(_predicted(spark, d), ["l_suppkey"], F.col("predicted"), F.col("actual"))
    return A.measures(counts)


@query
def macro_average(spark, d):
    names = ["accuracy", "precision", "recall", "f1", "iou"]
    means = A.macro(confusion(spark, d), names)
    return means.select("n", *[_r(F.col(n), 9).alias(n) for n in names])


@query
def micro_average(spark, d):
    return A.micro(A.confusion(_predicted(spark, d), ["l_suppkey"], F.col("predicted"), F.col("actual")))


@query
def mask_average_precision(spark, d):
    rows = confusion(spark, d).withColumn("part", F.pmod("l_suppkey", F.lit(5)))
    return A.average_precision_at(rows, "part", "iou").withColumn("ap", _r(F.col("ap")))


@query
def summary_rows(spark, d):
    rows = confusion(spark, d).select(F.col("l_suppkey").cast("string").alias("name"), "iou", "tp")
    summary = rows.agg(F.lit("MACRO").alias("name"), _r(F.avg("iou"), 9).alias("iou"))
    return sinks.with_summary(rows, [summary])


@query
def bounding_boxes(spark, d):
    found = A.bounding_box(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity", F.col("l_returnflag") == "R")
    return found.select("l_suppkey", *[F.col("box")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "width", "height"))], "area", _r(F.col("fraction")).alias("fraction"))


@query
def duplicate_ids(spark, d):
    return table(spark, d, "annotation_log").where("image_id is not null").select("image_id", "log_id").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query
def within_between(spark, d):
    rows = sound_features(spark, d, ["hue_hist"]).where("genus is not null")
    means = A.mean_vector(rows, "genus", "hue_hist", 18).where("n >= 3")
    long = A.long_form(rows.join(means.select("genus"), "genus"), ["genus"], "hue_hist")
    within = long.groupBy("genus", "pos").agg(F.var_pop("v").alias("v")).groupBy("genus").agg(F.avg("v").alias("v")).agg(F.avg("v").alias("within"))
    between = M.distances(means, "genus", "mean").agg(F.avg("d").alias("between"), F.count(F.lit(1)).alias("pairs"))
    joined = within.join(F.broadcast(between))
    return joined.select(_r(F.col("within"), 9).alias("within"), _r(F.col("between"), 9).alias("between"), "pairs", (F.col("between") > F.col("within") * 0.1).alias("passed"))


@query
def own_other_centroid(spark, d):
    rows = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    means = A.mean_vector(rows, "label", "v", 64)
    every = M.checked(means).agg(F.collect_list(F.struct("label", "mean")).alias("all"))
    gap = lambda c: N.euclidean(F.col("v"), c["mean"])
    own = F.aggregate("all", F.lit(0.0), lambda t, c: t + F.when(c["label"] == F.col("label"), gap(c)).otherwise(0.0))
    other = F.aggregate("all", F.lit(0.0), lambda t, c: t + F.when(c["label"] == F.col("label"), 0.0).otherwise(gap(c)))
    sums = rows.join(F.broadcast(every)).groupBy("label").agg(F.avg(own).alias("own"), F.sum(other).alias("other"), F.count(F.lit(1)).alias("n"), F.first(F.size("all")).alias("k"))
    return sums.select("label", _r(F.col("own"), 5).alias("own"), _r(F.col("other") / F.nullif(F.col("n") * (F.col("k") - 1), F.lit(0)), 5).alias("other"))


# Ranks, windows, order


@query
def cumulative_curve(spark, d):
    rows = _predicted(spark, d).withColumn("part", F.pmod("l_suppkey", F.lit(5)))
    return R.score_curve(rows, "part", "score", "actual").select("part", _r(F.col("score")).alias("score"), "tp", "fp", "p", "n")


@query
def swatch_offsets(spark, d):
    shares = A.long_form(sound_features(spark, d, ["dom_colours"]).select("feature_id", F.slice("dom_colours", 16, 5).alias("shares")), ["feature_id"], "shares")
    return R.running_offsets(shares, "feature_id", "pos", "v").select("feature_id", "pos", _r(F.col("offset")).alias("offset"))


@query
def average_rank(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice"), -3).alias("price"))
    return R.average_rank(rows, "price", "o_orderpriority").select("o_orderkey", "rank")


@query
def row_index(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "page_id", "rev_no")
    return R.row_index(rows, ["page_id"], [F.col("rev_no"), F.col("doc_id")]).select("doc_id", "page_id", F.col("place").cast("int").alias("place"))


@query
def top_orders(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "c_name", "o_totalprice")


@query
def percentiles(spark, d):
    found = R.percentiles(table(spark, d, "events"), "event_type", "value", {"p99": 0.99, "median": 0.5})
    return found.select("event_type", _r(F.col("p99")).alias("p99"), _r(F.col("median")).alias("median"))


@query
def best_annotation(spark, d):
    rows = table(spark, d, "annotation_log").where("image_id is not null and sam_score is not null").select("image_id", "log_id", "sam_score", "strategy").distinct()
    return rows.groupBy("image_id").agg(F.max(F.struct("sam_score", (-F.col("log_id")).alias("k"), "strategy")).alias("best")).select("image_id", (-F.col("best.k")).alias("log_id"), F.col("best.sam_score").alias("sam_score"), F.col("best.strategy").alias("strategy"))


@query
def sorted_species(spark, d):
    rows = table(spark, d, "extraction_log").where("genus is not null and species is not null").select(F.concat("genus", "species").alias("name")).distinct()
    return rows.orderBy("name")


@query
def label_difference(spark, d):
    a = table(spark, d, "extraction_log").select("species").where("species is not null").distinct()
    b = table(spark, d, "annotation_log").select("species").where("species is not null").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("extraction")).union(b.exceptAll(a).withColumn("side", F.lit("annotation")))


@query
def hash_sample(spark, d):
    return R.hash_sample(table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).select("l_returnflag", "k").distinct(), "l_returnflag", "k", 200, 42).select("l_returnflag", "k", "place")


@query
def stratified_split(spark, d):
    rows = table(spark, d, "documents").withColumn("stratum", F.coalesce("source", F.lit("")))
    return R.stratified_split(rows, "stratum", "doc_id", {"train": 0.70, "validation": 0.15, "test": 0.15}, 42)


# Statistics


@query
def standardised(spark, d):
    rows = sound_features(spark, d, ["gabor"])
    return M.standardised(rows, "feature_id", "gabor", 24).select("feature_id", *[_r(F.col("z")[i], 5).alias(f"z{i}") for i in range(24)])


def _genera(spark, d, field):
    rows = sound_features(spark, d, [field]).where("genus is not null")
    return A.mean_vector(rows.withColumn("genus", F.lower(F.trim("genus"))), "genus", field, GROUPS[field])


@query
def genus_distances(spark, d):
    return M.distances(_genera(spark, d, "gabor"), "genus", "mean").withColumn("d", _r(F.col("d"), 5))


@query
def distance_range(spark, d):
    pairs = M.distances(_genera(spark, d, "hue_hist"), "genus", "mean")
    return pairs.agg(_r(F.min("d"), 8).alias("low"), _r(F.max("d"), 8).alias("high"), _r(F.min(F.when(F.col("d") > 0, F.col("d"))), 8).alias("low_positive"), F.count(F.lit(1)).alias("pairs"))


def _signal(spark, d):
    rows = sound_features(spark, d, SIGNAL).where("genus is not null").select(F.lower(F.trim("genus")).alias("genus"), F.concat(*SIGNAL).alias("f"))
    return M.standardised(A.mean_vector(rows, "genus", "f", 37), "genus", "mean", 37)


@query
def selected_distances(spark, d):
    return M.distances(_signal(spark, d), "genus", "z").withColumn("d", _r(F.col("d"), 4))


@query
def pearson(spark, d):
    return M.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", _r(F.col("r")))


@query
def spearman(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", F.pmod("user_id", F.lit(50)).alias("u"))
    return M.spearman(rows, "value", "u", "event_type").withColumn("rho", _r(F.col("rho")))


def _genus_nodes(spark, d):
    """A root and below it each genus of the tips, its branch as long as the mean of theirs."""
    genus = table(spark, d, "tree_tips").groupBy(F.lower(F.element_at(F.split("tip_label", "_"), 1)).alias("label")).agg((F.min("tip_id") + 1).alias("node"), F.avg("branch_length").alias("length"))
    root = genus.agg(F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("length"))
    return genus.select("node", F.lit(0).alias("parent"), "label", "length").unionByName(root)


def _tree_distances(spark, d):
    """Path distances between the genera of the tree."""
    return T.path_distances(_genus_nodes(spark, d))


def _mantel(spark, d, count):
    found = M.mantel(M.distances(_genera(spark, d, "gabor"), "genus", "mean"), _tree_distances(spark, d), count)
    rounded = [_r(F.col(c), n).alias(c) for c, n in (("r", 5), ("p", 6), ("rho", 5), ("rho_p", 6))]
    return found.select(*rounded, "pairs", _r(N.least_detectable_r(F.col("pairs"))).alias("least_r"))


@query
def mantel(spark, d):
    return _mantel(spark, d, 99)


@query
def mantel_test(spark, d):
    """Rows only: ``mantel`` with 9,999 permutations; its SQL counts 99."""
    return _mantel(spark, d, 9_999)


@query
def feature_correlations(spark, d):
    found = M.feature_correlations(_genera(spark, d, "gabor"), "genus", "mean", _tree_distances(spark, d), 24)
    return found.select("pos", _r(F.col("r"), 5).alias("r"), "n")


def _all_correlations(spark, d):
    """(grp, feature, r, n) of all features of all groups: one pass for the means, one for the pairs."""
    rows = features(spark, d).where("genus is not null").withColumn("genus", F.lower(F.trim("genus")))
    parts = [(g, i) for g, n in GROUPS.items() for i in range(n)]
    usable = {g: N.sound(F.col(g), n) for g, n in GROUPS.items()}
    means = rows.groupBy("genus").agg(F.array(*[F.avg(F.when(usable[g], F.get(g, F.lit(i)))) for g, i in parts]).alias("f"))
    found = M.feature_correlations(means, "genus", "f", _tree_distances(spark, d), len(parts))
    place = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(i).alias("i")) for g, i in parts])
    return found.withColumn("at", F.get(place, F.col("pos"))).select("at.grp", _feature(F.col("at.grp"), F.col("at.i")).alias("feature"), "r", "n")


def _group_means(spark, d):
    return _all_correlations(spark, d).groupBy("grp").agg(F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("deviation"), F.count_if(F.col("r") < 0).alias("negative"))


@query
def group_mean_r(spark, d):
    return _group_means(spark, d).select("grp", _r(F.col("mean_r"), 5).alias("mean_r"), _r(F.col("deviation"), 5).alias("deviation"), "negative")


@query
def strongest_group(spark, d):
    """The group whose features agree best with the tree on average."""
    best = _group_means(spark, d).agg(F.max(F.struct(F.round("mean_r", 9).alias("mean_r"), "grp")).alias("best"))
    return best.select("best.grp", _r(F.col("best.mean_r"), 5).alias("mean_r"))


@query
def correlation_p(spark, d):
    """Two-sided p of each feature's correlation, the strongest first, features of one r by name; rows only, DuckDB has no t distribution."""
    found = _all_correlations(spark, d).select("grp", "feature", "r", "n", M.pearson_p("r", "n").alias("p"))
    return found.orderBy(F.desc("r"), "feature")


@query
def significant_features(spark, d):
    """Rows only: how many features have p below 0.05 and how many a negative r."""
    found = _all_correlations(spark, d).select("r", M.pearson_p("r", "n").alias("p"))
    return found.agg(F.count_if(F.col("p") < 0.05).alias("significant"), F.count_if(F.col("r") < 0).alias("negative"), F.count(F.lit(1)).alias("features"))


@query
def roc_auc(spark, d):
    rows = _predicted(spark, d).withColumn("part", F.pmod("l_suppkey", F.lit(5)))
    return R.roc_auc(rows, "part", "score", "actual").withColumn("auc", _r(F.col("auc")))


@query
def pr_area(spark, d):
    rows = _predicted(spark, d).withColumn("part", F.pmod("l_suppkey", F.lit(5)))
    return R.pr_area(rows, "part", "score", "actual").withColumn("ap", _r(F.col("ap")))


@query
def principal_distances(spark, d):
    """Rows only: components come from an eigenvector routine."""
    means = _genera(spark, d, "gabor")
    return M.principal_distances(means, "genus", "mean", 24)


def _linked(spark, d):
    return M.upgma(M.distances(_genera(spark, d, "gabor"), "genus", "mean"))


@query
def average_linkage(spark, d):
    """Rows only: average-linkage merges of the genera."""
    return _linked(spark, d)


@query
def linkage_order(spark, d):
    """Rows only: the genera in the order of the leaves of their merges, facing their order by name."""
    places = T.leaf_places(M.merge_nodes(durable(_linked(spark, d))))
    by_name = R.row_index(places.select("label").withColumn("all_", F.lit(1)), ["all_"], [F.col("label")]).select("label", F.col("place").cast("int").alias("place"))
    return M.facing_leaves(places, by_name)


@query
def reordered_distances(spark, d):
    """Rows only: the square matrix of the genera with rows and columns in the order of the leaves."""
    pairs = durable(M.distances(_genera(spark, d, "gabor"), "genus", "mean"))
    return M.reordered(pairs, T.leaf_places(M.merge_nodes(durable(M.upgma(pairs)))))


@query
def linkage_tree(spark, d):
    """Rows only: the merges of the genera as one tree text."""
    return T.newick(durable(M.merge_nodes(durable(_linked(spark, d)))))


@query
def explained_variance(spark, d):
    """Rows only: shares of variance of the components and their running sum."""
    return M.explained_variance(_genera(spark, d, "gabor"), "genus", "mean", 24)


@query
def ordered_distances(spark, d):
    """Both directions of each pair of genera and the zero diagonal: the cells of the square matrix."""
    means = _genera(spark, d, "gabor")
    cells = M.ordered_pairs(M.distances(means, "genus", "mean")).union(means.select("genus", "genus", F.lit(0.0)))
    return cells.select("a", "b", _r(F.col("d"), 5).alias("d"))


def _checks():
    structure = V.structure_checks(GROUPS, ["hue_hist", "sat_hist", "val_hist", "lbp"], "entropy", "genus")
    mean = V.anchored(GROUPS, "species")
    plain, patterned, striped, smooth = (ANCHORS[k] for k in ("plain", "patterned", "striped", "smooth"))
    first = F.get("entropy", F.lit(0))
    energies = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.get("gabor", k * 2))
    crowd = F.size(F.filter(F.slice("dom_colours", 16, 5), lambda v: v > 0.15))
    total = N.array_sum(F.col("gabor")) / 24
    return structure + [
        V.Check("plain_hue_entropy", mean(plain, "entropy", first), lambda v: v < 2.0),
        V.Check("plain_saturation", mean(plain, "sat_hist", N.array_sum(F.col("sat_hist")) / 8), lambda v: v > 0.1),
        V.Check("plain_yellow", mean(plain, "hue_hist", N.array_sum(F.slice("hue_hist", 4, 3))), lambda v: v > 0.05),
        V.Check("smooth_hue_entropy", mean(smooth, "entropy", first), lambda v: v < 2.2),
        V.Check("smooth_low_saturation", mean(smooth, "sat_hist", F.get("sat_hist", F.lit(0))), lambda v: v > 0.0),
        V.Check("patterned_over_plain", mean(patterned, "entropy", first) - mean(plain, "entropy", first), lambda v: v > 0),
        V.Check("striped_peak", mean(striped, "gabor", F.array_max(energies)) - 1.2 * mean(striped, "gabor", N.array_sum(energies) / 12), lambda v: v > 0),
        V.Check("striped_over_smooth", mean(striped, "gabor", total) - 0.8 * mean(smooth, "gabor", total), lambda v: v > 0),
        V.Check("striped_clusters", mean(striped, "dom_colours", crowd), lambda v: v >= 2),
        V.Check("smooth_fewer_clusters", mean(smooth, "dom_colours", crowd) - mean(striped, "dom_colours", crowd), lambda v: v <= 0),
        V.Check("texture_entropy", mean(striped, "entropy", F.get("entropy", F.lit(1))) - 0.9 * mean(smooth, "entropy", F.get("entropy", F.lit(1))), lambda v: v >= 0),
        *[V.Check(f"countershading_{k}", mean(v, "dorsal_ventral", F.abs(F.get("dorsal_ventral", F.lit(8)))), lambda v: v > 0.01) for k, v in ANCHORS.items()],
    ]


@query
def validation_report(spark, d):
    """Structure of the table and patterns of the anchor species, all in one pass."""
    return V.report(features(spark, d), _checks())


@query
def genus_validation(spark, d):
    """Distances between the mean vectors of the genera of the checks, and of their rows to their own and another mean."""
    rows = sound_features(spark, d, SIGNAL).where("genus is not null").select(F.lower(F.trim("genus")).alias("genus"), F.concat(*SIGNAL).alias("f")).where(F.col("genus").isin(GENERA))
    means = A.mean_vector(rows, "genus", "f", 37)
    wide = means.agg(*[F.max(F.when(F.col("genus") == g, F.col("mean"))).alias(f"m{i}") for i, g in enumerate(GENERA)])
    apart = lambda a, b: F.max(N.euclidean(F.col(f"m{a}"), F.col(f"m{b}")))
    gap = lambda own, m: F.avg(F.when(F.col("genus") == GENERA[own], N.euclidean(F.col("f"), F.col(f"m{m}"))))
    return V.report(rows.join(F.broadcast(wide)), [
        V.Check("genera_differ", apart(0, 1), lambda v: v > 0.1),
        V.Check("closer_than_third", apart(0, 1) - apart(0, 2), lambda v: v < 0),
        V.Check("closer_than_fourth", apart(0, 1) - apart(0, 3), lambda v: v < 0),
        V.Check("own_centre", gap(2, 2) - gap(2, 3), lambda v: v < 0),
    ])


@query
def closest_species(spark, d):
    """The two closest species of each genus of the checks by their mean vectors, and whether they differ."""
    rows = sound_features(spark, d, SIGNAL).where("genus is not null and species is not null").select(F.lower(F.trim("genus")).alias("genus"), F.lower(F.regexp_replace("species", r"[^\p{L}]+", "")).alias("name"), F.concat(*SIGNAL).alias("f"))
    keyed = rows.where(F.col("genus").isin(GENERA)).select(F.concat_ws("|", "genus", "name").alias("k"), "f")
    pairs = M.distances(A.mean_vector(keyed, "k", "f", 37), "k", "mean").select(F.split("a", r"\|").alias("a"), F.split("b", r"\|").alias("b"), F.round("d", 6).alias("d"))
    near = pairs.where(F.col("a")[0] == F.col("b")[0]).groupBy(F.col("a")[0].alias("genus")).agg(F.min(F.struct("d", F.col("a")[1].alias("a"), F.col("b")[1].alias("b"))).alias("m"))
    return near.select("genus", F.col("m.a").alias("first"), F.col("m.b").alias("second"), F.round("m.d", 4).alias("d"), (F.col("m.d") > 0.01).alias("differ"))


# Trees


def nodes(spark, d) -> DataFrame:
    """Root, regions and nations; a branch is as long as the mean balance of its customers, in thousands."""
    balance = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.avg("c_acctbal") / 1000).alias("length"))
    nation = table(spark, d, "nation").join(balance, "n_nationkey", "left")
    leaf = nation.select((F.col("n_nationkey") + 100).alias("node"), (F.col("n_regionkey") + 10).alias("parent"), F.col("n_name").alias("label"), F.coalesce("length", F.lit(0.0)).alias("length"))
    inner = table(spark, d, "region").select((F.col("r_regionkey") + 10).alias("node"), F.lit(1).alias("parent"), F.lit(None).cast("string").alias("label"), (F.length("r_name") / 10).alias("length"))
    root = inner.agg(F.lit(1).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("length"))
    return leaf.unionByName(inner).unionByName(root)


@query
def tree_tips_sorted(spark, d):
    return T.tips(nodes(spark, d)).select("label", _r(F.col("length"), 9).alias("length")).orderBy("label")


@query
def patristic(spark, d):
    return T.path_distances(nodes(spark, d)).withColumn("d", _r(F.col("d"), 9))


@query
def region_distances(spark, d):
    """Mean path distance inside and between regions."""
    of = table(spark, d, "nation").select(F.col("n_name"), F.col("n_regionkey"))
    pairs = T.path_distances(nodes(spark, d))
    named = pairs.join(of.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra")), "a").join(of.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("rb")), "b")
    return named.groupBy((F.col("ra") == F.col("rb")).alias("same")).agg(_r(F.avg("d"), 9).alias("mean"), _r(F.min("d"), 9).alias("low"))


@query
def pruned_tree(spark, d):
    keep = table(spark, d, "supplier").where("s_acctbal > 9000").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"))
    return T.pruned(nodes(spark, d), keep).where("label is not null").select("label", F.col("parent"), _r(F.col("length"), 9).alias("length"))


@query
def robinson_foulds(spark, d):
    """Nations below their regions against nations below the remainder of their number of customers by five."""
    first = nodes(spark, d)
    customers = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 100).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    placed = first.join(customers, "node", "left")
    second = placed.select("node", F.when(F.col("label").isNotNull(), (F.pmod(F.coalesce("n", F.lit(0)), F.lit(5)) + 10).cast("int")).otherwise(F.col("parent")).alias("parent"), "label", "length")
    return T.robinson_foulds(first, second).withColumn("share", _r(F.col("share")))


@query
def newick_nodes(spark, d):
    """Rows only: nodes parsed from a tree text of each genus, written from its species and their mean entropy."""
    rows = sound_features(spark, d, ["entropy"]).where("genus is not null and species is not null")
    species = rows.groupBy(F.lower(F.trim("genus")).alias("genus"), F.regexp_replace(F.lower("species"), "[^a-z]+", "_").alias("tip")).agg(F.avg(F.col("entropy")[0]).alias("length"))
    tips = species.select("genus", F.format_string("%s:%.6f", "tip", "length").alias("t"))
    texts = tips.groupBy("genus").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("t")), ","), F.lit(");")).alias("text"))
    return T.parse_newick(texts, "genus", "text")


# Reports, rasters, streams


def _cards(spark, d):
    rows = table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit(""))).withColumn("title", F.coalesce("title", F.lit("")))
    return sinks.html_card_rows(rows.groupBy("source", "title").agg(F.count(F.lit(1)).cast("string").alias("n")), "title", "n", "source")


@query
def html_report(spark, d):
    """A card for each source and title over all revisions; a section is what a writer partitioned by source puts together."""
    return _cards(spark, d)


@query
def html_report_cards(spark, d):
    """The cards of ``html_report`` written and read again."""
    path = shared_folder(spark)
    _cards(spark, d).write.partitionBy("source").option("compression", "zstd").parquet(path)
    read = spark.read.schema("title string, html string, source string").parquet(path)
    return read.select(F.coalesce("source", F.lit("")).alias("source"), "title", "html")


@query
def summary_document(spark, d):
    """One nested document: the lines of annotation_log and those of each status, in order."""
    lines = table(spark, d, "annotation_log").select("log_id", F.upper("status").alias("status")).distinct().groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    one = lines.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("status", "n"))).alias("by_status"))
    path = shared_folder(spark)
    sinks.json_document(one, path)
    return spark.read.text(path).select(F.col("value").alias("document"))


@query
def csv_round_trip(spark, d):
    """Feature rows written as CSV with a fixed order of fields, read as a feature table."""
    rows = sound_features(spark, d, ["entropy"]).select("genus", "species", F.get("entropy", F.lit(0)).alias("hue_entropy"), F.get("entropy", F.lit(1)).alias("lbp_entropy"), "feature_id")
    path = shared_folder(spark)
    sinks.csv(rows, path, ["feature_id", "genus", "species", "hue_entropy", "lbp_entropy"])
    read = readers.feature_table(spark, path, meta=("feature_id", "genus", "species"))
    return read.select(F.col("feature_id").cast("long").alias("feature_id"), _r(F.col("f")[0]).alias("hue_entropy"), _r(F.col("f")[1]).alias("lbp_entropy"))


@query
def json_round_trip(spark, d):
    """Lines of extraction_log written as JSON lines and read again."""
    path = shared_folder(spark)
    sinks.json_lines(table(spark, d, "extraction_log").select("log_id", "n_fish_pixels", "status").distinct(), path)
    return spark.read.schema("log_id long, n_fish_pixels long, status string").json(path)


@query
def list_round_trip(spark, d):
    """The annotated image ids written as a text list and read as ids."""
    path = shared_folder(spark)
    sinks.text_list(table(spark, d, "annotation_log").where("image_id is not null").select("image_id").distinct(), "image_id", path)
    return readers.id_list(spark, path)


@query
def matrix_round_trip(spark, d):
    """The square matrix of the genera written as CSV and read as pairs."""
    pairs = M.distances(_genera(spark, d, "gabor"), "genus", "mean").select("a", "b", F.round("d", 5).alias("d"))
    labels = [r["k"] for r in M.checked(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()).orderBy("k").collect()]
    path = shared_folder(spark)
    M.wide(pairs, labels).coalesce(1).write.csv(path, header=True)
    return readers.square_matrix(spark, path)


@query
def tree_round_trip(spark, d):
    """The tree of the genera written as text, read and parsed: its tips and their lengths."""
    tips = T.tips(_genus_nodes(spark, d)).where("label is not null").select(F.format_string("%s:%.9f", "label", "length").alias("t"))
    path = shared_folder(spark)
    sinks.text_list(M.checked(tips).agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("t")), ","), F.lit(");")).alias("text")), "text", path)
    found = T.parse_newick(readers.tree_texts(spark, path), "tree", "text")
    return found.where("tip_order is not null").select("label", _r(F.col("length"), 6).alias("length"))


@query
def annotation_document(spark, d):
    """Images and their best annotations written as one document, read and joined again."""
    images = table(spark, d, "annotation_log").where("image_id is not null").groupBy(F.col("image_id").cast("long").alias("id")).agg(F.min("file_name").alias("file_name"))
    notes = best_annotation(spark, d).select(F.col("log_id").alias("id"), F.col("image_id").cast("long").alias("image_id"), F.col("sam_score").alias("area"))
    path = shared_folder(spark)
    # A row of one part of each list is a document of its own; readers take all of them together.
    part = lambda df, name: df.groupBy(F.pmod("id", F.lit(64)).alias("part")).agg(F.collect_list(F.struct("*")).alias(name))
    both = part(images, "images").join(part(notes, "annotations"), "part", "full").select(F.coalesce("images", F.array()).alias("images"), F.coalesce("annotations", F.array()).alias("annotations"))
    sinks.json_lines(both, path)
    pictures, read = readers.coco_lines(spark, path)
    return pictures.join(read.withColumnRenamed("id", "note"), pictures.id == read.image_id).select("image_id", "file_name", "note", _r(F.col("area")).alias("area"))


@query
def image_round_trip(spark, d):
    """Swatches of five pixels written as PNG files and read as pixels: the sums of each channel."""
    rows = table(spark, d, "supplier").select("s_suppkey", *[F.pmod(F.col("s_suppkey") * k, F.lit(256)).cast("int").alias(c) for c, k in (("r", 37), ("g", 13), ("b", 7))])
    hexed = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgb"])
    rasters = rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(5).alias("width"), F.lit(1).alias("height"), F.unhex(F.repeat(hexed, 5)).alias("rgb"))
    path = shared_folder(spark)
    sinks.write_pngs(rasters, path.removeprefix("file:"))
    seen = readers.pixels(spark, path)
    return seen.groupBy(X.stem(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(c).alias(c) for c in "rgb"])


@query
def raster_features(spark, d):
    """Rows only: texture features of rasters, one for each supplier, made from its lines' values."""
    return I.texture(I.lineitem_rasters(table(spark, d, "lineitem")), "image")


@query
def event_windows(spark, d):
    return gates.gate_counts(table(spark, d, "events"), "ts", "value", 50.0, 400.0)
