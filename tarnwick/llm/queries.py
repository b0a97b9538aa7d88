"""The registered queries of this subpackage: each runs over its whole tables with production parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import canonical, clusters, dedupe, encoding, language, leakage, splits, vectors
from tarnwick.session import durable, table

LOGS = ("standardization_log", "annotation_log", "extraction_log")
NOT_CONTENT = ("log_id", "image_id", "logged_at", "arrived_at")
#: Folder of the vocabularies unless ``spark.tarnwick.tokenizers`` names another.
TOKENIZERS = "/opt/tokenizers"
SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def _content(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_CONTENT]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = table(spark, sf_dir, "tree_tips").select(F.col("tip_label").alias("entry"))
    methods = table(spark, sf_dir, "match_methods").select(F.col("method").alias("entry"))
    lists = [(["visual_label", "matched_tree_tip"], tips, True), (["match_method"], methods, False)]
    return canonical.match_fields(table(spark, sf_dir, "tree_tip_matching_audit"), "audit_id", lists)


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the typed values that mean no entry: (field, rows)."""
    return p1_found(spark, sf_dir).where("entry = ''").groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def _logs(spark: SparkSession, sf_dir: str) -> list[dedupe.Source]:
    tables = {name: table(spark, sf_dir, name) for name in LOGS}
    return [dedupe.Source(name, df, "log_id", _content(df)) for name, df in tables.items()]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.copies(_logs(spark, sf_dir))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each set of copies, with the number of its lines."""
    return dedupe.counted(_logs(spark, sf_dir)).select("tbl", F.col("id_a").alias("log_id"), "copies")


FIELDS = {"hue_hist": 18, "gabor": 24}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "knn_queries").select(F.col("feature_id").alias("id"))
    return _knn(table(spark, sf_dir, "image_features"), asked)


def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row whose id is divisible by 100, against all rows: (field, query, id, distance)."""
    rows = table(spark, sf_dir, "image_features")
    asked = rows.select(F.col("feature_id").alias("id")).where("id % 100 = 0")
    parts = [vectors.nearest(rows, asked, "feature_id", f, w, 5).select(F.lit(f).alias("field"), "query", "id", "distance") for f, w in FIELDS.items()]
    return reduce(DataFrame.unionByName, parts)


def _knn(rows: DataFrame, asked: DataFrame) -> DataFrame:
    parts = []
    for field, width in FIELDS.items():
        near = vectors.nearest(rows, asked, "feature_id", field, width, 5)
        ends = (F.least("query", "id").alias("id_a"), F.greatest("query", "id").alias("id_b"))
        parts.append(near.select(F.lit(field).alias("field"), *ends).distinct())
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.image_groups(table(spark, sf_dir, "annotation_log"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, group_key, split), every group whole in one split."""
    images = splits.image_groups(table(spark, sf_dir, "annotation_log"))
    return images.join(splits.group_splits(images, SHARES).select("group_key", "split"), "group_key").select("image_id", "group_key", "split")


def _coloured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = durable(clusters.points(table(spark, sf_dir, "image_features"), "feature_id", "dom_colours", "dorsal_ventral"))
    return rows, clusters.members(clusters.cluster(rows, radius=0.25, share_gap=0.002), least=3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coloured(spark, sf_dir)[1].select(F.col("id").alias("feature_id"), "cluster_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, medoid and five most typical rows."""
    rows, grouped = _coloured(spark, sf_dir)
    return clusters.describe(rows, durable(grouped), typical=5)


def _vocabulary(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.tarnwick.tokenizers', TOKENIZERS)}/byte_bpe_50k.tiktoken"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text", _vocabulary(spark))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, same): whether ids and offsets of each document, decoded piece by piece, give its text again."""
    docs, path = table(spark, sf_dir, "documents"), _vocabulary(spark)
    ids = encoding.encode(docs, "doc_id", "text", path, offsets=True)
    back = encoding.decode(ids, "doc_id", "ids", path, "starts").select("doc_id", F.md5("text").alias("now"), "placed")
    was = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("was"))
    return was.join(back, "doc_id").select("doc_id", ((F.col("was") == F.col("now")) & F.col("placed")).alias("same"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _leaks(spark, sf_dir).where("sentences >= least(2, of)")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the leaked items: (item_id, documents, whole), the documents that hold it and those that hold all of it."""
    found = _leaks(spark, sf_dir).where("sentences >= least(2, of)")
    return found.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("sentences") == F.col("of")).alias("whole"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.document_languages(docs, "doc_id", "text", "lang", language.fit(docs, "doc_id", "text", "lang"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _languages(spark, sf_dir).where("languages > 1 or label is null or label <> lang")
    return found.select(F.col("id").alias("doc_id"), "lang").distinct()


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of running text with its language and confidence."""
    docs = table(spark, sf_dir, "documents")
    found = language.document_segments(docs, "doc_id", "text", language.fit(docs, "doc_id", "text", "lang"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_copies, p3_found, p3_knn, p4_found, p4_splits, p5_found, p5_clusters, p6_ids, p6_roundtrip, p7_found, p7_items, p8_found, p8_segments)}
