"""Trees as tables of nodes (node, parent, label, length); the root has a null parent.

Ways to the root come from joins that double them; pairs of tips are a small result (see ``checked``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.matrix import checked, entity_pairs
from tarnwick.operators.ranking import row_index
from tarnwick.session import durable


def parse_newick(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, parent, label, length, tip_order): the nodes of each tree text, numbered in preorder of opening.

    Quoted labels lose their quotes, comments in brackets are dropped, missing labels and lengths are null; a null
    or blank text has no nodes.
    """

    def nodes(tree: str) -> Iterator[tuple]:
        tokens = re.findall(r"'(?:[^']|'')*'|[(),:;]|[^\s(),:;']+", re.sub(r"\[[^\]]*\]", "", tree))
        found: list[list] = []
        stack: list[int] = []
        current, tips, after_colon = None, 0, False
        for token in tokens:
            if token == "(":
                found.append([len(found), stack[-1] if stack else None, None, None, None])
                stack.append(len(found) - 1)
                current = None
            elif token in ",)":
                if current is None:
                    found.append([len(found), stack[-1] if stack else None, None, None, tips])
                    tips += 1
                current = stack.pop() if token == ")" else None
            elif token == ":":
                after_colon = True
                continue
            elif token != ";":
                if current is None:
                    found.append([len(found), stack[-1] if stack else None, None, None, tips])
                    tips += 1
                    current = len(found) - 1
                if after_colon:
                    found[current][3] = float(token)
                else:
                    found[current][2] = token.strip("'").replace("''", "'")
            after_colon = False
        return map(tuple, found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *n) for k, t in zip(batch["key"], batch["text"]) if t and t.strip() for n in nodes(t)]
            frame = pd.DataFrame(out, columns=["key", "node", "parent", "label", "length", "tip_order"])
            yield frame.astype({"node": "Int32", "parent": "Int32", "tip_order": "Int32"})

    plain = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return plain.mapInPandas(run, "key string, node int, parent int, label string, length double, tip_order int").withColumnRenamed("key", key)


def tips(nodes: DataFrame) -> DataFrame:
    """Nodes that are no other node's parent."""
    return nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def lineages(nodes: DataFrame) -> DataFrame:
    """(node, way): each node's way from the root down to itself, as structs of node and depth (lengths summed).

    The way up doubles in each round, so a tree takes as many rounds as its depth has binary digits. Missing
    lengths count as zero; a loop of parents is an error.
    """
    # The root's own length belongs to no way between two nodes.
    step = F.struct(F.col("node").alias("node"), F.when(F.col("parent").isNull(), 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("depth"))
    level = durable(nodes.select("node", F.col("parent").alias("up"), F.array(step).alias("way")))
    state = lambda df: df.agg(F.count(F.lit(1)), F.count("up")).first()
    count, still = state(level)
    rounds, most = 0, math.ceil(math.log2(max(2, count))) + 1
    while still:
        if rounds == most:
            raise ValueError("the parents of a node lead back to it")
        above = level.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("way").alias("upper"))
        deeper = F.transform("way", lambda x: F.struct(x["node"].alias("node"), (x["depth"] + F.element_at("upper", -1)["depth"]).alias("depth")))
        level = durable(level.join(above, "up", "left").select("node", F.col("next").alias("up"), F.when(F.col("upper").isNull(), F.col("way")).otherwise(F.concat("upper", deeper)).alias("way")))
        rounds, (_, still) = rounds + 1, state(level)
    return level.select("node", "way")


def leaf_places(nodes: DataFrame) -> DataFrame:
    """(label, place): the tips from left to right; the children of a node are ordered by ``side``, then by node."""
    inner = nodes.select(F.col("node").alias("at"), F.col("side").alias("turn"))
    way = lineages(nodes).select("node", F.posexplode("way").alias("level", "step"))
    turns = way.join(inner, F.col("step.node") == F.col("at")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "turn", "at"))).alias("turns"))
    ends = tips(nodes).where("label is not null").select("node", "label").join(turns, "node").withColumn("all_", F.lit(1))
    return row_index(ends, ["all_"], [F.col("turns")]).select("label", F.col("place").cast("int").alias("place"))


def newick(nodes: DataFrame) -> DataFrame:
    """(text): the tree as one text, children by ``side``; blanks of a label become underscores, full stops go.

    A round writes all nodes whose children are written, so there are as many rounds as levels. A tree's text is one
    value, so at most as many nodes as ``checked`` allows.
    """
    checked(nodes.where("label is not null"))
    own = nodes.select("node", "parent", "side", F.translate(F.translate("label", " ", "_"), ".", "").alias("label"), F.regexp_replace(F.round(F.coalesce("length", F.lit(0.0)), 9).cast("string"), r"\.0$", "").alias("length"))
    open_nodes = durable(own)
    with_children = nodes.select("parent").where("parent is not null").distinct()
    written = durable(own.join(with_children.withColumnRenamed("parent", "node"), "node", "left_anti").select("node", "label"))
    while True:
        placed = written.withColumnRenamed("label", "text").join(open_nodes.select("node", "parent", "side", "length"), "node")
        total = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
        whole = placed.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("side", "node", F.concat("text", F.lit(":"), "length").alias("t")))).alias("parts")).join(total, "parent").where("n = children")
        fresh = whole.select(F.col("parent").alias("node"), F.concat(F.lit("("), F.array_join(F.transform("parts", lambda x: x["t"]), ","), F.lit(")")).alias("label"))
        done = whole.select("parent")
        rest = placed.join(done, "parent", "left_anti").select("node", F.col("text").alias("label"))
        if whole.isEmpty():
            return written.select(F.concat("label", F.lit(";")).alias("text"))
        written = durable(rest.unionByName(fresh))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, length): every node with itself and all nodes above it, and the length of the way up."""
    way = lineages(nodes).select("node", F.explode("way").alias("step"), F.element_at("way", -1)["depth"].alias("depth"))
    return way.select("node", F.col("step.node").alias("ancestor"), (F.col("depth") - F.col("step.depth")).alias("length"))


def path_distances(nodes: DataFrame) -> DataFrame:
    """(a, b, d) for tips a < b by label: down from the deepest node that both ways from the root share.

    Pairs of tips meet in pairs of blocks (see ``entity_pairs``), each with its way, so no ancestor is a hot key.
    """
    ends = tips(nodes).where("label is not null").select("node", "label").join(lineages(nodes), "node")
    pairs = entity_pairs(ends, "label", "way")
    depth = lambda way: F.element_at(way, -1)["depth"]
    shared = F.size(F.array_intersect(F.transform("va", lambda x: x["node"]), F.transform("vb", lambda x: x["node"])))
    return pairs.select("a", "b", (depth(F.col("va")) + depth(F.col("vb")) - 2 * F.get("va", shared - 1)["depth"]).alias("d"))


def pruned(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """(label, parent, length): the kept tips (column ``label``) and the branching nodes above them, unary nodes dissolved.

    A kept node's parent is its nearest ancestor under which two or more branches hold kept tips.
    """
    above = ancestors(nodes)
    kept = above.join(tips(nodes).join(keep.select("label").distinct(), "label", "left_semi").select("node"), "node", "left_semi")
    child = nodes.where("parent is not null").select(F.col("node").alias("child"), F.col("parent").alias("ancestor"))
    used = kept.select(F.col("ancestor").alias("child")).distinct().join(child, "child")
    forks = used.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ancestor")
    stay = kept.where("node = ancestor").select("node").union(forks.select(F.col("ancestor").alias("node")))
    near = above.join(stay, "node", "left_semi").where("node <> ancestor").join(forks, "ancestor").groupBy("node").agg(F.min(F.struct("length", "ancestor")).alias("up"))
    named = stay.join(near, "node", "left").join(nodes.select("node", "label"), "node")
    return named.select("node", "label", F.col("up.ancestor").alias("parent"), F.col("up.length").alias("length"))


def bipartitions(nodes: DataFrame) -> DataFrame:
    """(split): each inner branch as the sorted labels of its side without the first label of the tree."""
    ends = checked(tips(nodes).where("label is not null").select("node", "label"))
    under = ancestors(nodes).join(ends, "node").select("ancestor", "label")
    sides = under.groupBy("ancestor").agg(F.sort_array(F.collect_set("label")).alias("side"))
    every = ends.agg(F.sort_array(F.collect_set("label")).alias("every"))
    both = sides.join(F.broadcast(every)).withColumn("other", F.array_except("every", "side"))
    chosen = F.when(F.array_contains("side", F.get("every", F.lit(0))), F.col("other")).otherwise(F.col("side"))
    return both.where("size(side) > 1 and size(other) > 1").select(F.array_join(chosen, "|").alias("split")).distinct()


def robinson_foulds(first: DataFrame, second: DataFrame) -> DataFrame:
    """(distance, share): splits that only one of two trees on the same labels has, also over 2 (n - 3)."""
    a, b = bipartitions(first), bipartitions(second)
    only = a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("distance"))
    size = tips(first).where("label is not null").agg(F.count_distinct("label").alias("n"))
    return only.join(F.broadcast(size)).select("distance", F.when(F.col("n") > 3, F.col("distance") / (2 * (F.col("n") - 3))).otherwise(F.lit(0.0)).alias("share"))
