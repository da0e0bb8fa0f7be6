"""Sources, sinks, the model hook, Unicode tokens and streams."""

import struct

import pandas as pd
import pytest

from maskloom import registry
from maskloom.functions import text
from maskloom.operators import models, scoring
from maskloom.sources import images, shared
from maskloom.streaming import frames


def test_scan_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "b.png", "sub/c.jpg"):
        (tmp_path / name).write_bytes(b"x" * 5)
    flat = images.scan_images(spark, f"file://{tmp_path}")
    assert [r.path.rsplit("/", 1)[-1] for r in flat.collect()] == ["a.JPG"]
    assert images.scan_images(spark, f"file://{tmp_path}", (".jpg", ".png"), True).count() == 3


def test_documents_round_trip(spark, sf, tmp_path):
    docs = registry.QUERIES["snk01_records"](spark, sf)
    path = f"file://{tmp_path}/docs"
    images.write_result_documents(docs, path)
    back = images.read_result_documents(spark, path)
    objects = registry.QUERIES["win01_order_objects"](spark, sf)
    assert back.select("image_id", "instance_id", "area").exceptAll(objects.select("image_id", "instance_id", "area")).isEmpty()
    assert back.count() == objects.count()


def test_overwrite_one_run(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    for run, n in (("a", 3), ("b", 4), ("a", 2)):
        images.overwrite_run(spark.range(n), path, run)
    assert {r.run: r["count"] for r in spark.read.parquet(path).groupBy("run").count().collect()} == {"a": 2, "b": 4}


def test_model_hook_loads_once_per_task(spark):
    def load():
        return lambda pdf: pd.DataFrame({"id": pdf["id"], "y": pdf["id"] * 2})

    out = models.apply_batch_model(spark.range(10).repartition(2), load, "id long, y long")
    assert sorted(r.y for r in out.collect()) == list(range(0, 20, 2))


def test_unicode_tokens_and_labels(spark):
    df = spark.createDataFrame([(" Straße!! ",), ("ＹＥＳ.",), ("No?",), (None,)], "t string")
    assert [r[0] for r in df.select(text.nfkc_token("t")).collect()] == ["strasse", "yes", "no", None]
    labels = spark.createDataFrame([("a / b\\c",), ("x" * 90,), ("ﬁg tree",), ("",), (None,)], "t string")
    assert [r[0] for r in labels.select(text.sanitize_any_label("t")).collect()] == ["a _ b_c", "x" * 48, "fig tree", "unknown", "unknown"]


def test_tokens_lose_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("Yes\n",), ("\t no. \r\n",), ("yes \x1f!",), ("Ja\u00a0",)], "t string")
    assert [r[0] for r in df.select(text.nfkc_token("t")).collect()] == ["yes", "no", "yes", "ja"]
    assert [r[0] for r in df.limit(3).select(scoring.normalize_token("t")).collect()] == ["yes", "no", "yes"]
    labels = spark.createDataFrame([("ripe tomato + leaf",), ("a\tb",), ("a\u2003 b",), ("  __x__ ",), ("é" * 3,)], "t string")
    assert [r[0] for r in labels.select(text.sanitize_any_label("t")).collect()] == ["ripe tomato + leaf", "a_b", "a b", "_x_", "_"]


def test_image_dims(spark, tmp_path):
    width, height = 3, 2
    rows = b"".join(bytes([10, 20, 30] * width) + b"\0" * (-3 * width % 4) for _ in range(height))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + rows)
    (tmp_path / "b.bmp").write_bytes(b"not an image")
    got = images.image_dims(spark, f"file://{tmp_path}").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.img_w, r.img_h, r.channels) for r in got] == [("a.bmp", 3, 2, 3)]


def test_label_lines_by_split(spark, tmp_path):
    lines = spark.createDataFrame([("train", "0 1\n1 2"), ("val", "")], "split string, text string")
    images.write_label_lines(lines, f"file://{tmp_path}/labels")
    back = spark.read.text(f"file://{tmp_path}/labels")
    assert sorted((r.split, r.value) for r in back.collect()) == [("train", "0 1"), ("train", "1 2"), ("val", "")]


class Counting(frames.TableSink):
    """A sink of its own: keeps a part of each batch."""

    def commit(self, batch, number):
        super().commit(batch.filter("id % 2 = 0"), number)


def test_sink_hook_and_replayed_batches(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(10).repartition(2).write.parquet(source)
    stream = frames.file_stream(spark, source, spark.range(1).schema, 1)
    sink = Counting(out)
    frames.drive(stream, sink, "append", f"file://{tmp_path}/log")
    assert sorted(r.id for r in sink.rows(spark, stream.schema).collect()) == [0, 2, 4, 6, 8]
    # A batch that is written again, as after a failure between sink and log, replaces itself.
    sink.commit(spark.createDataFrame(spark.read.parquet(f"{out}/batch=0").collect(), "id long"), 0)
    assert sink.rows(spark, stream.schema).count() == 5
    frames.drive(frames.file_stream(spark, source, spark.range(1).schema, 1), sink, "append", f"file://{tmp_path}/other-log")
    assert sink.rows(spark, stream.schema).count() == 5


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_folder(Session())
