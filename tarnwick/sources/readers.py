"""Readers. Each fails early, through Spark, when the path does not exist; ``required`` guards columns and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.functions.text import parent, stem

IMAGE_ENDINGS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")

COCO = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("genus", T.StringType()), T.StructField("species", T.StringType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.IntegerType()), T.StructField("segmentation", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("area", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("iscrowd", T.IntegerType())]))),
])


def required(df: DataFrame, columns: list[str], rows: bool = True) -> DataFrame:
    """``df`` if it has the ``columns`` and, unless ``rows`` is false, at least one row; else an error that names what is missing."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    if rows and df.isEmpty():
        raise ValueError("the input has no rows")
    return df


def image_files(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """(path, genus, name, length) of the images below ``path``, the directory of each read as its genus; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.where(F.lower("path").rlike(rf"\.({'|'.join(endings)})$"))
    return listed.select("path", parent(F.col("path")).alias("genus"), stem(F.col("path")).alias("name"), "length")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, r, g, b) of every pixel of the decodable images below ``path``."""
    image = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    place = F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("pos", "k")
    each = image.where("width * height > 0").select("origin", "width", "nChannels", "data", place)
    byte = lambda c: F.conv(F.hex(F.substring("data", F.col("k") * F.col("nChannels") + 1 + F.least(F.lit(c), F.col("nChannels") - 1), F.lit(1))), 16, 10).cast("int")
    return each.select(F.col("origin").alias("path"), F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of an annotation document, one row each."""
    return _lists(spark.read.schema(COCO).json(path, multiLine=True))


def coco_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As ``coco``, of documents on a line each, so that a large one is read in parts."""
    return _lists(spark.read.schema(COCO).json(path))


def _lists(document: DataFrame) -> tuple[DataFrame, DataFrame]:
    return document.select(F.explode("images").alias("i")).select("i.*"), document.select(F.explode("annotations").alias("a")).select("a.*")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): the whole numbers of a text, split at white space; other words are left out."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w")).select(F.expr("try_cast(w as bigint)").alias("id")).where("id is not null")


def feature_table(spark: SparkSession, path: str, meta: tuple[str, ...] = ("genus", "species")) -> DataFrame:
    """(meta, names, f): a CSV with a header whose columns beside ``meta`` are numbers, gathered into one array."""
    names = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(n, T.StringType() if n in meta else T.DoubleType()) for n in names])
    rows = spark.read.csv(path, header=True, schema=schema)
    values = [n for n in names if n not in meta]
    return rows.select(*[m for m in meta if m in names], F.array(*[F.lit(n) for n in values]).alias("names"), F.array(*[F.col(f"`{n}`") for n in values]).alias("f"))


def feature_document(spark: SparkSession, path: str) -> DataFrame:
    """(genus, species, f) of a JSON document with a list ``species`` of records."""
    record = "species array<struct<genus:string,species:string,image_path:string,mask_path:string,features:array<double>>>"
    return spark.read.schema(record).json(path, multiLine=True).select(F.explode("species").alias("s")).select("s.genus", "s.species", "s.image_path", "s.mask_path", F.col("s.features").alias("f"))


def square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, d) with a < b of a square CSV with labels in its first column and its header."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    label, *others = rows.columns
    long = rows.unpivot([F.col(f"`{label}`").alias("a")], [F.col(f"`{c}`") for c in others], "b", "d")
    return long.where("a < b").select("a", "b", F.col("d").cast("double").alias("d"))


def tree_texts(spark: SparkSession, path: str) -> DataFrame:
    """(tree, text): each file whole; see ``operators.trees.parse_newick`` for its nodes."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("tree"), F.col("value").alias("text"))
