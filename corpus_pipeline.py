"""From raw documents to sharded training data: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to
the shared folder and gives it to the next stage. All stages but the last keep the columns of documents.

Defined cases: null and empty texts, repeated rows and null doc_ids go through as the stages' own modules
define them; in near-dedup rows of one doc_id stay or go together, and rows without doc_id stay; an empty table gives empty
results, and empty labels or benchmark tables drop nothing; long texts are read whole; other columns pass through all stages, and
one named like a column that sharding adds gets `_` behind its name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.common import staged, table
from maskloom.llm.decontaminate import drop_contaminated
from maskloom.llm.minhash import drop_near_copies
from maskloom.llm.mixing import curriculum
from maskloom.llm.quality import keep_good
from maskloom.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 and more."""
    return drop_near_copies(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in training order; a document can stand in it up to twice."""
    return curriculum(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot. The slots of a shard follow the order in which the stage before wrote the rows."""
    file = F.col("_metadata.file_path")
    # Spark numbers the files of a table by partition, and by piece within one.
    number = F.regexp_extract(file, r"part-([0-9]+)", 1).try_cast("long") * 100_000 + F.regexp_extract(file, r"-c([0-9]+)", 1).try_cast("long")
    order = (F.coalesce(number, F.lit(0)), file, F.col("_metadata.row_index"))
    try:
        docs.select(*order)
    except AnalysisException:  # not read from files: there is no such order
        order = None
    return assign_shards(docs, order=order)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first two stages and the hash ring have no SQL form; tests compare the result with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
