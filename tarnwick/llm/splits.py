"""Splits that keep related records together.

Records and entities form a graph. Its components come from random-mate contraction: in each round every
vertex draws a coin, and each tail that has a head among its neighbours is contracted into the smallest such
head, by SQL joins; the rounds' contractions are unwound into labels once no edge is left. Whole components
then go to the splits by their cumulative weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.session import durable


def species_name(genus: Column, species: Column) -> Column:
    """Lower-case genus, one blank, lower-case epithet, from a genus and a species written unevenly.

    Words are runs of letters, split at a change from lower to upper case. The genus is that of its own column
    if given; else the last word where a comma follows the epithet or only the last word is capitalised, else the
    first word. The epithet is the
    first word that is not the genus, its repetition or an initial of it. Null if the species is null or blank,
    or if no genus is given anywhere.
    """
    parted = F.regexp_replace(species, r"(\p{Ll})(\p{Lu}\p{Ll})", "$1 $2")
    words = F.filter(F.split(F.lower(parted), r"[^\p{L}]+"), lambda w: F.length(w) > 0)
    own = F.nullif(F.regexp_replace(F.lower(genus), r"[^\p{L}]+", ""), F.lit(""))
    told = F.when(F.size(words) > 1, F.when(species.rlike(r"^\s*\p{L}+\s*,|^\s*\p{Ll}+[\s_-]+\p{Lu}\p{Ll}"), F.element_at(words, -1)).otherwise(F.element_at(words, 1)))
    name = F.coalesce(own, told)
    rest = F.filter(words, lambda w: (w != name) & ~((F.length(w) <= 4) & F.startswith(name, w)))
    epithet = F.get(rest, F.lit(0))
    joined = F.when(F.startswith(epithet, name), F.substr(epithet, F.length(name) + 1)).otherwise(epithet)
    return F.when(species.isNotNull() & (F.length(joined) > 0), F.concat(name, F.lit(" "), joined))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(v, root) for each vertex of ``edges`` (u, v); both ends of every edge, directly or over others, share a root.

    Null ends and self loops make no edge. Contraction removes about a quarter of the vertices a round; the
    coins are hashes of vertex and round, so a lost task recomputes the same result.
    """
    both = edges.where("u <> v").select("u", "v")
    live = durable(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        if len(rounds) >= max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        head = lambda c, r=len(rounds): F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2)) == 1
        into = durable(live.where(~head("u") & head("v")).groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "v"))
        rounds.append(into)
        to_u, to_v = into.select(F.col("v").alias("u"), F.col("root").alias("ru")), into.select("v", F.col("root").alias("rv"))
        moved = live.join(to_u, "u", "left").join(to_v, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        live = durable(moved.where("u <> v").distinct())
    labels = None
    for into in reversed(rounds):
        if labels is None:
            labels = into
            continue
        up = labels.select(F.col("v").alias("root"), F.col("root").alias("top"))
        labels = durable(into.join(up, "root", "left").select("v", F.coalesce("top", "root").alias("root")).union(labels))
    empty = edges.select("v", F.col("u").alias("root")).where("false")
    return empty if labels is None else labels.union(labels.select(F.col("root").alias("v"), "root").distinct()).distinct()


def image_groups(annotations: DataFrame) -> DataFrame:
    """(image_id, group_key): each image with a named species and the alphabetically first name of its group.

    An image's names are linked as a star around the first of them, so the edges are as many as the pairs of
    image and name, whatever the size of a group. Images without id or without a named species are left out.
    """
    named = annotations.select("image_id", species_name(F.col("genus"), F.col("species")).alias("name")).where("image_id is not null and name is not null")
    pairs = durable(named.distinct())
    first = pairs.groupBy("image_id").agg(F.min("name").alias("u"), F.max("name").alias("last"))
    edges = pairs.join(first.where("u < last"), "image_id").where("name <> u").select("u", F.col("name").alias("v")).distinct()
    roots = components(edges)
    keys = roots.join(roots.groupBy("root").agg(F.min("v").alias("group_key")), "root").select(F.col("v").alias("u"), "group_key")
    return first.join(keys, "u", "left").select("image_id", F.coalesce("group_key", "u").alias("group_key"))


def group_splits(groups: DataFrame, proportions: dict[str, float], seed: int = 0) -> DataFrame:
    """(group_key, weight, split): whole groups dealt by cumulative weight so that the proportions come out.

    Groups are laid end to end by falling class of weight (powers of two), within a class in hashed order, and
    the split whose stretch holds the middle of a group takes it. The running sum is taken over at most 64 parts
    of each class first and within each part second, so no task orders all groups. ``groups`` has one row for
    each record; a group heavier than a share takes its whole weight to one split.
    """
    names = list(proportions)
    total_share = sum(proportions.values())
    weights = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("weight"))
    sized = weights.withColumn("class", F.floor(F.log2("weight"))).withColumn("part", F.pmod(F.xxhash64("group_key", F.lit(seed)), F.lit(64)))
    cells = sized.groupBy("class", "part").agg(F.sum("weight").alias("cell"))
    before = Window.orderBy(F.desc("class"), "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("class", "part", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("offset"), F.sum("cell").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("class", "part").orderBy(F.desc("weight"), F.xxhash64("group_key", F.lit(seed)), "group_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, ["class", "part"]).withColumn("at", F.col("offset") + F.coalesce(F.sum("weight").over(inside), F.lit(0)) + F.col("weight") / 2)
    split, edge = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        edge -= proportions[names[names.index(name) + 1]] / total_share
        split = F.when(F.col("at") < F.col("total") * F.lit(edge), F.lit(name)).otherwise(split)
    return placed.select("group_key", "weight", split.alias("split"))
