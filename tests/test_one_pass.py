"""Queries that look at masks, pairs, offers and pictures once: how much work a plan has, and that results stay whole."""

import random

from pyspark.sql import functions as F

from maskloom.operators import artifacts, masks, objects, reports
from maskloom.plans import fixtures
from maskloom.plans.masks import LIMITS
from maskloom.sources import images
from maskloom.streaming import frames


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def passes(df):
    """How often a plan calls Python on batches, and reads line items."""
    plan = plan_of(df).split("Initial Plan")[-1]
    return plan.count("MapInArrow"), plan.count("FileScan parquet")


def test_masks_are_packed_and_measured_in_one_call(spark, sf):
    cand = fixtures.candidates(spark, sf)
    once = fixtures.measured_masks(cand)
    assert passes(once)[0] == 1
    twice = masks.measured(fixtures.packed_masks(cand, *[c for c in cand.columns if c not in masks.MASK], empty=True))
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.select(*once.columns).collect()), key=repr)
    work = {"work": fixtures.measured_with_rle, "more": ", counts array<bigint>"}
    got = {(r.image_id, r.source_index): r.counts for r in fixtures.measured_masks(cand, "img_w", "img_h", **work).collect()}
    want = {(r.image_id, r.source_index): r.counts for r in masks.runs_to_rle(fixtures.packed_masks(cand, "img_w", "img_h", empty=True)).collect()}
    assert got == want


def test_depths_of_images_beside_measures(spark, sf):
    """Pixels per depth that stand beside an image's first mask are those of its stretches; deep stacks and empty images are whole."""
    cand = fixtures.candidates(spark, sf)
    beside = fixtures.measured_masks(cand, "img_w", "img_h", work=masks.measured_with_depths, more=", depths array<struct<depth:bigint,px:bigint>>")
    got = beside.select("image_id", F.inline("depths"))
    depth = masks.depth_segments(fixtures.packed_masks(cand))
    want = depth.groupBy("image_id", "depth").agg(F.sum((F.col("r1") - F.col("r0")).cast("long")).alias("px"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = spark.createDataFrame([(1, 10, 10), (2, 4, 4)], "image_id long, img_w int, img_h int")
    deep = spark.createDataFrame([(1, 1, 5), (1, 3, 7), (1, 9, 2)], "image_id long, depth long, px long")
    rows = sorted(map(tuple, masks.overlap_histogram(deep, sizes, 4).collect()))
    assert rows == [(1, 0, 86, 14, 86, 9, 2, True), (1, 1, 5, 14, 86, 9, 2, True), (1, 2, 0, 14, 86, 9, 2, True), (1, 3, 7, 14, 86, 9, 2, True), (1, 4, 0, 14, 86, 9, 2, True), (2, 0, 16, 0, 16, 0, 0, False)]


def test_the_ledger_reads_offers_once(spark, sf):
    """A request's offers come out of the row that they are folded in, with all their columns."""
    offers = fixtures.offers(spark, sf).withColumn("more", F.col("offer_seq") * 2)
    ledger = artifacts.admit(artifacts.first_offers(offers), artifacts.Budget())
    assert passes(ledger)[1] == 1 and "Join" not in plan_of(ledger)
    rows = ledger.collect()
    assert len(rows) == artifacts.first_offers(offers).count() and all(r.more == 2 * r.offer_seq for r in rows)


def test_documents_tell_objects_in_one_pass(spark):
    objs = spark.createDataFrame([(1, 2, 0, "a", 0, 5, 1, 1, 2, 2, None, [1, 2]), (1, 1, 1, "b", 0, 9, 1, 1, 2, 2, "odd", [0, 3])], "image_id long, instance_id int, source_index int, label string, class_id int, area long, x0_incl int, y0_incl int, x1_incl int, y1_incl int, warning string, counts array<bigint>")
    docs = reports.result_documents(objs, spark.createDataFrame([(1,), (2,)], "image_id long"), 3)
    assert plan_of(docs).count("ObjectHashAggregate") + plan_of(docs).count("SortAggregate") <= 2
    a, b = sorted(docs.collect(), key=lambda r: r.image_id)
    assert (a.objects, a.labels, a.warnings, a.mask_rle) == (2, "b,a", "object 1: odd", "1=0 3,2=1 2") and a.records.startswith('[{"instance_id":1,') and a.records.count("{") == 2
    assert (b.objects, b.labels, b.warnings, b.mask_rle, b.records) == (0, "", "", "", "[]")
    apart = reports.result_documents(objs.drop("counts"), docs.select("image_id"), 3, rle=objs.select("image_id", "source_index", "counts"))
    assert sorted(map(tuple, apart.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))


def test_pairs_of_small_and_large_images(spark):
    """Images of few boxes are paired in their rows, without a join; larger ones in grids; both give all pairs that meet."""
    r = random.Random(7)
    boxes = [(i, k, x, y, x + r.randint(0, 20), y + r.randint(0, 20)) for i, n in ((1, 1), (2, 12), (3, 40)) for k in range(n) for x, y in [(r.randint(0, 60), r.randint(0, 60))]]
    df = spark.createDataFrame(boxes, "image_id long, k int, a int, b int, c int, d int")
    meet = {(p[0], p[1], q[1]) for p in boxes for q in boxes if p[0] == q[0] and p[1] < q[1] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]}
    few = masks.box_pairs(df, ("a", "b", "c", "d"), "k")
    assert "Join" not in plan_of(few)
    for pairs in (few, masks.box_pairs(df, ("a", "b", "c", "d"), "k", few=12), masks.box_pairs(df, ("a", "b", "c", "d"), "k", few=0)):
        met = pairs.filter("a <= o_c AND o_a <= c AND b <= o_d AND o_b <= d").collect()
        assert sorted((p.image_id, min(p.k, p.o_k), max(p.k, p.o_k)) for p in met) == sorted(meet)


def test_parallel_segments_do_not_divide(spark):
    rows = [(1, 0, 0, 0, 9, 0), (1, 1, 0, 0, 9, 0), (1, 2, 4, 0, 4, 5)]
    s = spark.createDataFrame([(*r, 20, 20) for r in rows], "image_id long, seg int, sx1 long, sy1 long, sx2 long, sy2 long, img_w int, img_h int")
    assert sorted((r.seg, r.other, r.x, r.y) for r in objects.segment_intersections(s).collect()) == [(0, 2, 4.0, 0.0), (1, 2, 4.0, 0.0)]


def test_frames_meet_candidates_that_are_measured_in_place(spark, sf):
    cand = fixtures.candidates(spark, sf)
    named = cand.select("image_id", F.lit(1).cast("long").alias("stream_id"), F.col("image_id").alias("frame_idx"), F.lit("f").alias("frame_id")).distinct()
    got = frames.frame_objects(named, cand, fixtures.measured_masks, LIMITS)
    want = frames.frame_objects(named, cand, fixtures.mask_runs(cand), LIMITS)
    assert "Generate" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pictures_are_written_by_many_tasks(spark, tmp_path):
    """Few bytes, many pictures: tasks follow the pictures, and one file is one image."""
    n = images.PICTURES_OF_TASK
    images.PICTURES_OF_TASK = 10
    try:
        images.write_pictures(spark.range(60).select(F.col("id").alias("image_id"), F.lit("x").alias("value")).coalesce(1), f"file://{tmp_path}/p")
    finally:
        images.PICTURES_OF_TASK = n
    files = list((tmp_path / "p").glob("image_id=*/part-*"))
    assert len(files) == 60 and len({f.name.split("-")[1] for f in files}) > 3
