"""Image folders and result documents as tables. Pixels stay in Spark's own image and binaryFile sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT_SCHEMA = "array<struct<instance_id:int,source_index:int,label:string,class_id:int,area:bigint,x0:int,y0:int,x1:int,y1:int>>"


def scan_images(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".jpg",), recursive: bool = False) -> DataFrame:
    """path, length and modificationTime of files with one of the suffixes, in any case. Names that begin with . or _ are not seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.lower("path")
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | name.endswith(e.lower())
    return files.filter(wanted).select("path", "length", "modificationTime")


def image_dims(spark: SparkSession, path: str) -> DataFrame:
    """Width, height and channels of the images that can be read; orientation tags are not applied."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.width").alias("img_w"), F.col("image.height").alias("img_h"), F.col("image.nChannels").alias("channels"))


#: Pictures that one task writes.
PICTURES_OF_TASK = 100


def write_pictures(pictures: DataFrame, path: str) -> None:
    """One file of text per image, in a folder of its number. pictures: image_id, value, one row per image.

    Tasks grow in number with the pictures, however few bytes tell them, and each puts its own files in their place: the driver moves none.
    """
    tasks = max(1, -(-pictures.count() // PICTURES_OF_TASK))
    dealt = pictures.select("value", "image_id").repartition(tasks, "image_id")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("image_id").text(path)


def read_result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Object rows of JSON lines {image_id, records}, records being a JSON list."""
    docs = spark.read.schema("image_id long, records string").json(path)
    return docs.select("image_id", F.inline(F.from_json("records", OBJECT_SCHEMA)))


def write_result_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def write_label_lines(lines: DataFrame, path: str) -> None:
    """Text files by split; lines: split, text."""
    lines.select("split", "text").write.mode("overwrite").partitionBy("split").text(path)


def overwrite_run(df: DataFrame, path: str, run: str) -> None:
    """Replace one run's output and leave the others."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
