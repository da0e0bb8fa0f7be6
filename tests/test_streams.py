"""Streams in several runs: order kept over restarts, lost and late frames, contradictory offers, objects batch by batch."""

import pytest
from pyspark.sql import functions as F

from maskloom.operators import masks
from maskloom.streaming import frames

SCHEMA = "stream_id long, frame_idx long, frame_id string"


@pytest.fixture
def place(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def feed(spark, place, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place("in"))


def run(spark, place, make, schema=SCHEMA, once=False):
    stream = make(frames.file_stream(spark, place("in"), spark.createDataFrame([], schema).schema, 1))
    sink = frames.TableSink(place("out"))
    frames.drive(stream, sink, "append", place("log"), once)
    return sink.rows(spark, stream.schema).collect()


def test_order_over_restarts_with_lost_and_late_frames(spark, place):
    emit = lambda s: frames.ordered_emit(s, timeout_ms=1)
    feed(spark, place, [(1, 1, "a"), (1, 4, "d"), (1, 3, "c"), (2, 2, "y")])
    got = run(spark, place, emit, once=True)
    assert {(r.stream_id, r.frame_idx, r.fate) for r in got} == {(1, 1, "in_order")}
    # A second run goes on from the log: stream 2 is whole; the frames of stream 1 that wait are given out over the gap.
    feed(spark, place, [(2, 1, "x"), (2, 1, "again"), (2, 3, "z")])
    got = {(r.stream_id, r.frame_idx, r.frame_id, r.fate) for r in run(spark, place, emit, once=True)}
    assert {g for g in got if g[3] == "in_order"} == {(1, 1, "a", "in_order"), (2, 1, "x", "in_order"), (2, 2, "y", "in_order"), (2, 3, "z", "in_order")} or (2, 2, "y", "after_gap") in got
    assert {(1, 3, "c", "after_gap"), (1, 4, "d", "after_gap")} <= got and {g[:2] for g in got if g[3] == "late"} >= {(2, 1)}
    # What comes after its place was passed has a row too.
    feed(spark, place, [(1, 2, "b"), (1, 5, "e")])
    got = run(spark, place, emit, once=True)
    assert {(r.frame_idx, r.frame_id, r.fate) for r in got if r.stream_id == 1} == {(1, "a", "in_order"), (3, "c", "after_gap"), (4, "d", "after_gap"), (2, "b", "late"), (5, "e", "in_order")}


def test_backlog_without_timeout(spark, place):
    """Frames wait for the one that is missing, and none is given out twice."""
    feed(spark, place, [(1, k, f"f{k}") for k in range(300, 1, -1)])
    assert run(spark, place, frames.ordered_emit) == []
    feed(spark, place, [(1, 1, "f1"), (1, 7, "again")])
    got = run(spark, place, frames.ordered_emit)
    assert sorted((r.frame_idx, r.frame_id) for r in got if r.fate == "in_order") == [(k, f"f{k}") for k in range(1, 301)]
    assert [(r.frame_idx, r.frame_id) for r in got if r.fate == "late"] == [(7, "again")]


OFFER = "ts timestamp, request_id long, name string, stage string, raw_bytes long"


def test_contradictions_and_repeats(spark, place):
    at = lambda m: spark.sql(f"SELECT timestamp'2024-01-01 00:00:00' + INTERVAL {m} MINUTES").first()[0]
    feed(spark, place, [(at(0), 1, "a", "s", 5), (at(0), 1, "b", None, 5)], OFFER)
    feed(spark, place, [(at(1), 1, "a", "s", 5), (at(2), 1, "b", None, 5), (at(3), 1, "a", "s", 6), (at(3), 2, "a", "s", 9)], OFFER)
    feed(spark, place, [(at(60), 3, "late", "s", 1)], OFFER)
    feed(spark, place, [(at(61), 3, "later", "s", 1)], OFFER)
    feed(spark, place, [(at(62), 1, "a", "t", 7), (at(1), 1, "a", "t", 8)], OFFER)
    read = lambda: frames.file_stream(spark, place("in"), spark.createDataFrame([], OFFER).schema, 1)
    first = frames.run_available(frames.idempotent_offers(read())).select("request_id", "name", "stage", "raw_bytes").collect()
    # After the watermark a name is new again; an offer before it is dropped.
    assert sorted(map(tuple, first), key=repr) == sorted([(1, "a", "s", 5), (1, "b", None, 5), (2, "a", "s", 9), (3, "late", "s", 1), (3, "later", "s", 1), (1, "a", "t", 7)], key=repr)
    odd = frames.run_available(frames.contradictory_offers(read(), read())).collect()
    assert [tuple(r) for r in odd] == [(1, "a", "s", 6, "s", 5)]


def test_objects_of_frames_in_batches(spark, place):
    """Two batches of frames give the rows of one job over all frames."""
    cand = spark.createDataFrame([(i, s, 20, 20, "x") for i in range(6) for s in range(3)], "image_id long, source_index int, img_w int, img_h int, label string")
    runs = spark.createDataFrame([(i, s, c, 2 + s, 5 + i + s) for i in range(6) for s in range(3) for c in range(3, 6 + s)], "image_id long, source_index int, col int, r0 int, r1 int")
    named = spark.createDataFrame([(i, 1, i + 1, f"f{i}") for i in range(6)], "image_id long, stream_id long, frame_idx long, frame_id string")
    for part in (0, 1):
        named.filter(f"image_id % 2 = {part}").coalesce(1).write.mode("append").parquet(place("in"))
    sink = frames.ObjectSink(place("out"), cand, runs, {"min_area": 10})
    frames.drive(frames.file_stream(spark, place("in"), named.schema, 1), sink, "append", place("log"))
    want = frames.frame_objects(named, cand, runs, {"min_area": 10})
    got = sink.rows(spark, want.schema).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) > 8
    area = masks.measure_masks(runs).agg(F.sum("area")).first()[0]
    assert sum(r.area for r in got) <= area
