"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may do without it: its one machine then gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: lineage is cut, and a lost executor costs nothing.

    The folder belongs to the cluster, which clears it; a table stays there for as long as results that read it can.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write a table in n buckets of a key and read it back: what is joined to it by that key, dealt to n partitions, goes to its rows, which stay.

    Spark keeps buckets for tables of the catalog alone, so it has a name there; its files are in the shared folder as those of `staged` are.
    """
    path = fresh_path(df.sparkSession, name)
    table = f"maskloom_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    df.write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
