"""Queries over files: written from the given tables to the shared folder, and read back by the sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import models
from ..sources import images as src
from ..sources.shared import fresh_path
from ..streaming import frames as streaming
from .base import query
from .fixtures import FRAMES_SQL, duck, table
from .objects import OBJECTS, typed_of
from .streams import arriving


@query("src01_scan_images", """
SELECT o_orderpriority AS folder, sum(strlen(o_orderkey || ':' || o_orderpriority) + 1)::BIGINT AS bytes FROM orders GROUP BY o_orderpriority""")
def src01(spark, sf_dir):
    """Lines of the orders in folders by priority, as .txt and as .json files: only the former are wanted, whatever the case of the suffix."""
    path = fresh_path(spark, "scan")
    rows = table(spark, sf_dir, "orders").select(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"), F.translate("o_orderpriority", " ", "_").alias("folder"), F.col("o_orderpriority").alias("priority"))
    rows.select("value", "folder").write.partitionBy("folder").text(f"{path}/a")
    rows.select("value", "folder").write.partitionBy("folder").json(f"{path}/b")
    found = src.scan_images(spark, path, (".TXT", ".jpg"), recursive=True)
    names = rows.select("folder", F.col("priority").alias("name")).distinct()
    by = found.groupBy(F.regexp_extract(F.url_decode("path"), "folder=([^/]*)/", 1).alias("folder")).agg(F.sum("length").alias("bytes"))
    return by.join(names.hint("merge"), "folder").select(F.col("name").alias("folder"), "bytes")


@query("src02_image_dims", "SELECT DISTINCT CAST(user_id AS BIGINT) AS image_id, CAST(1 + user_id % 90 AS INT) AS img_w, CAST(1 + user_id % 70 AS INT) AS img_h, 3 AS channels FROM events WHERE user_id % 5 <> 0")
def src02(spark, sf_dir):
    """An uncompressed picture per user, grey of one tone; every fifth is cut off in its header and is not read."""
    path = fresh_path(spark, "pictures")
    w, h = 1 + F.col("user_id") % 90, 1 + F.col("user_id") % 70
    # Every byte of the file is below 128, so that it can be written as text; the size in the header only has to be large enough.
    byte = lambda c: F.char(c.cast("long"))
    four = lambda c: F.concat(byte(c), F.lit("\0\0\0"))
    head = F.concat(F.lit("BM\x7f\x7f\x7f\0\0\0\0\0"), four(F.lit(54)), four(F.lit(40)), four(w), four(h), F.lit("\1\0"), F.lit("\x18\0"), F.lit("\0" * 24))
    pixels = F.repeat(F.lit("@"), ((w * 3 + 3 - (w * 3 + 3) % 4) * h).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 5 == 0, F.substring(head, 1, 10)).otherwise(F.concat(head, pixels)).alias("value"))
    src.write_pictures(rows.withColumnRenamed("user_id", "image_id"), path)
    dims = src.image_dims(spark, path)
    return dims.select(F.regexp_extract("path", "image_id=([0-9]+)", 1).cast("long").alias("image_id"), "img_w", "img_h", "channels")


@query("src06_result_documents", duck(*OBJECTS) + " SELECT image_id, instance_id, source_index, label, class_id, area, x0_incl AS x0, y0_incl AS y0, x1_incl AS x1, y1_incl AS y1 FROM typed")
def src06(spark, sf_dir):
    """Objects as one document per image, written and read back as rows."""
    path = fresh_path(spark, "documents")
    o = typed_of(spark, sf_dir)
    record = F.struct("instance_id", "source_index", "label", "class_id", "area", F.col("x0_incl").alias("x0"), F.col("y0_incl").alias("y0"), F.col("x1_incl").alias("x1"), F.col("y1_incl").alias("y1"))
    documents = o.groupBy("image_id").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("records"))
    src.write_result_documents(documents, path)
    return src.read_result_documents(spark, path)


@query("snk09_overwrite_run", "SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey * 2 ELSE o_orderkey END AS value, 'run' || o_orderkey % 3 AS run FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0")
def snk09(spark, sf_dir):
    """Three runs; the second is written again with fewer rows and other values, the others stay."""
    path = fresh_path(spark, "runs")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("value"))
    for k in range(3):
        src.overwrite_run(o.filter(F.col("image_id") % 3 == k), path, f"run{k}")
    src.overwrite_run(o.filter("image_id % 3 = 1 AND image_id % 2 = 0").withColumn("value", F.col("value") * 2), path, "run1")
    return spark.read.parquet(path).select("image_id", "value", F.col("run").cast("string").alias("run"))


@query("udf01_batch_model", "SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * 64)), 3) AS score, CAST(len(embedding) AS INT) AS dims FROM embeddings")
def udf01(spark, sf_dir):
    """A model with one weight, loaded once per worker, over the vectors in Arrow batches."""

    def load():
        weight = 64.0
        return lambda batch: pd.DataFrame({"vec_id": batch["vec_id"], "score": [round(sum(float(x) * weight for x in v[:8]), 3) for v in batch["embedding"]], "dims": [len(v) for v in batch["embedding"]]})

    return models.apply_batch_model(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), load, "vec_id long, score double, dims int", "sum-of-eight")


class OutcomeSink(streaming.TableSink):
    """A sink of its own: of each batch only the counts by outcome are kept."""

    def commit(self, batch, number):
        super().commit(batch.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("peak")), number)


@query("udf02_sink_hook", duck(FRAMES_SQL) + " SELECT outcome, CAST(count(*) AS BIGINT) AS n, max(ms) AS peak FROM frames GROUP BY outcome")
def udf02(spark, sf_dir):
    out, stream = fresh_path(spark, "outcomes"), arriving(spark, sf_dir)
    sink = OutcomeSink(out)
    streaming.drive(stream, sink, "append", fresh_path(spark, "outcomes-log"))
    counts = sink.rows(spark, spark.createDataFrame([], "outcome string, n long, peak double").schema)
    return counts.groupBy("outcome").agg(F.sum("n").alias("n"), F.max("peak").alias("peak"))
