"""One image, one key or one column with very much in it; spread, memory and cost stay bounded, and results equal plain versions."""

import json
import math
import os
import random
import resource

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskloom.functions import text
from maskloom.operators import artifacts, components, masks, models, objects, reports, scoring, settings

RUNS = "image_id long, source_index int, col int, r0 int, r1 int"


def test_sparse_masks_take_memory_by_runs():
    """10,000 masks of two far pixels in images of 4000 by 3000 pixels."""
    n = 10_000
    group = np.repeat(np.arange(n), 2)
    col, r0 = np.tile([0, 3999], n), np.tile([0, 2999], n)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    stats = components.chords_of(group, col, r0, r0 + 1, group, col, r0, 0.2, 1, 16)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 700
    assert set(stats["rays"]) == {2} and set(stats["greatest"]) == {1}


def test_lines_with_many_runs():
    """Combs have more runs on a line than are met one by one."""
    r = np.random.default_rng(1)
    a = r.random((40, 60)) < 0.5
    cols, r0, r1 = [], [], []
    for c in range(60):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], a[:, c].astype(np.int8), [0]])))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            cols.append(c), r0.append(s), r1.append(e)
    cols, r0, r1 = map(np.array, (cols, r0, r1))
    box = [np.array([0]), np.array([0]), np.array([59]), np.array([39])]
    px, py, ex, ey = (r.integers(0, m, 300) for m in (60, 40, 60, 40))
    zero = np.zeros(len(cols), np.int64)
    got = components.pixels_on_rays(zero, cols, r0, r1, box, np.zeros(300, np.int64), px, py, ex, ey)
    for k in range(300):
        dx, dy = ex[k] - px[k], ey[k] - py[k]
        steps = max(abs(dx), abs(dy))
        mark = lambda d, j: int(np.sign(d)) * ((2 * abs(d) * j + max(steps, 1)) // (2 * max(steps, 1)))  # noqa: B023, E731
        assert got[k] == sum(a[py[k] + mark(dy, j), px[k] + mark(dx, j)] for j in range(steps + 1))


def test_columns_beyond_the_key_are_refused():
    table = pa.table({"col": pa.array([1 << 21], pa.int32()), "r0": pa.array([0], pa.int32())})
    with pytest.raises(ValueError, match="col"):
        components._columns(table, "col", "r0")


def test_a_mask_over_many_strips(spark):
    """Strips of two columns give the parts of whole masks: spirals, combs, diagonals and noise."""
    r, rows = np.random.default_rng(8), []
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 4):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = True
        spiral[k + 4 : 41 - k, k] = True
    comb = np.zeros((30, 40), bool)
    comb[:, ::2] = True
    comb[0, 1::4] = comb[29, 3::4] = True
    shapes = [spiral, comb, np.eye(37, dtype=bool), *(r.random((25, 30)) < d for d in (0.3, 0.42, 0.55))]
    for k, a in enumerate(shapes):
        for c in range(a.shape[1]):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], a[:, c].astype(np.int8), [0]])))
            rows += [(1, k, c, int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
    df = spark.createDataFrame(rows, RUNS)
    named = components.mask_components(df).cache()
    edges = lambda **how: sorted((x.image_id, x.source_index, x.component, x.col, x.r0, x.r1) for x in components.external_boundary(named, **how).collect())
    for strip in (1, 2, 7):
        assert edges(strip=strip) == edges()
    for corners in (True, False):
        want = sorted(map(tuple, components.mask_components(df, corners=corners).collect()))
        for strip in (1, 2, 7):
            assert sorted(map(tuple, components.mask_components(df, corners=corners, strip=strip).select("image_id", "source_index", "col", "r0", "r1", "component").collect())) == want


def test_labels_against_union_find():
    """Graphs in which a root has edges to several lower roots at once."""
    r = np.random.default_rng(9)
    for n, m in [(2, 0), (5, 4), (60, 40), (60, 70), (400, 390), (400, 900)] * 5:
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u, v, strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert components.labels(n, u, v).tolist() == [find(x) for x in range(n)]


def test_groups_over_many_batches():
    """Rows of a group that spans batches are put together once, and groups are never cut."""
    keys = np.sort(np.random.default_rng(2).integers(0, 9, 500))
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size], "x": np.arange(i, min(i + size, 500))}) for i in range(0, 500, size)]
        tables = list(components.whole_groups(iter(batches), ["k"]))
        assert np.array_equal(np.concatenate([t.column("x").to_numpy() for t in tables]), np.arange(500))
        seen = [set(t.column("k").to_pylist()) for t in tables]
        assert sum(map(len, seen)) == len(set().union(*seen))


def test_a_column_with_very_many_objects(spark):
    """6,000 objects over one column: every pixel has the largest object on it."""
    r = random.Random(3)
    spans = [(k, *sorted(r.sample(range(20_000), 2)), r.choice([r.randint(1, 50), 60])) for k in range(6000)]
    runs = spark.createDataFrame([(1, k, 7, a, b) for k, a, b, _ in spans], RUNS)
    objs = spark.createDataFrame([(1, k, k + 1, area) for k, _, _, area in spans], "image_id long, source_index int, instance_id int, area long")
    got = sorted((x.r0, x.r1, x.instance_id) for x in masks.identity_map(objs, runs).collect())
    best = np.full(20_000, -1)
    for k, a, b, _area in sorted(spans, key=lambda s: (s[3], -s[0])):
        best[a:b] = k + 1
    drawn = np.full(20_000, -1)
    for a, b, owner in got:
        assert (drawn[a:b] == -1).all()
        drawn[a:b] = owner
    assert np.array_equal(drawn, best)
    assert all(x[1] != y[0] or x[2] != y[2] for x, y in zip(got, got[1:], strict=False))


def test_boxes_of_all_sizes(spark):
    """A box as large as the image makes four rows at most, and pairs are those of a plain comparison."""
    r, boxes = random.Random(4), []
    for k in range(250):
        w, h = (r.choice([1, 5, 16, 17, 70, 300, 5000, 9000]) for _ in range(2))
        x, y = r.randint(0, 9000), r.randint(0, 8192)
        boxes.append((1, k, x, y, x + w, y + h))
    df = spark.createDataFrame(boxes, "image_id long, ord int, bx0 int, by0 int, bx1 int, by1 int")
    got = {x.ord: x.overlap for x in masks.box_overlap(df).collect()}
    area = lambda a, b: max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
    assert got == {b[1]: sum(area(a, b) for a in boxes[: b[1]]) for b in boxes}
    edges = tuple(F.col(c) for c in ("bx0", "by0", "bx1", "by1"))
    cells = df.select(F.size(masks._cells(masks.level_of(edges, masks.GRID), edges, masks.GRID)).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 4


def test_ranks_of_one_key_spread(spark):
    """All rows under one key, half of them one value, some null."""
    r = random.Random(5)
    values = [None if k % 50 == 0 else 7.0 if k % 2 else r.random() * 20 for k in range(3000)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)] + [(2, 0, 1.5), (3, 0, None)], "key long, seq int, ms double").repartition(4)
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    got = {x.key: x.value for x in reports.nearest_rank(df, "key", "ms").collect()}
    assert got == {1: order[max(0, int(len(order) * 0.95 + 0.999999) - 1)], 2: 1.5, 3: None}
    s = {x.key: x for x in reports.latency_summary(df, "key", ["seq"], "ms").collect()}
    assert s[1].upper_median == order[len(order) // 2] and s[1].median == pytest.approx(float(pd.Series(values, dtype=float).median()))
    assert (s[2].median, s[3].median, s[3].upper_median) == (1.5, None, None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = df.groupBy("key", "ms").count().repartitionByRange("key", F.col("ms").asc_nulls_first())
        rows = [x["count"] for x in dealt.filter("key = 1").groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) >= 3 and max(rows) < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_prompts_in_blocks_spread(spark, monkeypatch):
    """Two blocks of prompts: candidates meet them in all tasks."""
    monkeypatch.setattr(scoring, "PROMPT_BYTES", 400)
    cands = spark.createDataFrame([(k // 10, k % 10, [float(k % 7), 1.0]) for k in range(600)], "image_id long, source_index int, embedding array<float>")
    prompts = spark.createDataFrame([(c, f"c{c}", 0, [1.0, float(c)]) for c in range(8)], "class_order int, class_id string, prompt_index int, embedding array<float>")
    scored = scoring.score_prompts(cands, prompts)
    assert scored.count() == 4800 and scored.distinct().count() == 4800
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [x["count"] for x in scoring.score_prompts(cands, prompts).groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) >= 2 and max(rows) < 4800
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_json_keys_by_the_parser(spark):
    docs = [(1, '{"a": [{"de\\u0076ice": 1}], "note": "\\"k\\": 2", "K": {"x": null}}'), (2, '{"a": '), (3, None), (4, "3"), (5, "[" * 6 + '{"k": 1}' + "]" * 6), (6, "{}"), (7, '{"K": 1, "k": 2}')]
    df = spark.createDataFrame(docs, "id long, j string")
    got = {r.id: (r.found, r.problem) for r in text.forbidden_keys(df, "id", "j", ["k", "DEVICE"]).collect()}
    assert got == {1: (["device", "k"], None), 2: ([], "invalid_json"), 3: ([], None), 4: ([], None), 5: (["k"], None), 6: ([], None), 7: (["k"], None)}
    shallow = {r.id: r.problem for r in text.forbidden_keys(df, "id", "j", ["k"], depth=3).collect()}
    assert shallow[5] == "too_deep" and shallow[1] is None


def rendered(rows, kept):
    """The response with the first `kept` optional artifacts."""
    delivered, omitted, seen = [], [], 0
    for name, stage, size, status in rows:
        facts = {"name": name, "stage": stage, "raw_bytes": size}
        optional = status == "delivered" and stage != "picture"
        seen += optional
        if status == "delivered" and (not optional or seen <= kept):
            delivered.append(facts | {"data": "A" * (4 * ((size + 2) // 3))})
        else:
            omitted.append(facts | {"reason": status if status != "delivered" else "omitted_response_limit"})
    body = {"delivered": delivered, "omitted": omitted, "delivered_count": len(delivered), "omitted_count": len(omitted), "truncated": bool(omitted)}
    return len(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode())


def test_trimming_equals_a_loop_that_renders(spark):
    r, requests = random.Random(6), {}
    for q in range(60):
        requests[q] = [(f'n{k}"é{"x" * r.randint(0, 40)}', r.choice(["label", "verify", "picture"]), r.choice([0, 1, 2, 30, 300, 2000]), r.choice(["delivered", "delivered", "omitted_total"])) for k in range(r.randint(1, 14))]
    rows = [(q, k, *x) for q, xs in requests.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "request_id long, offer_seq int, name string, stage string, raw_bytes long, status string")
    for limit in (400, 1500, 4000):
        got = {}
        for x in artifacts.trim_to_encoded_size(df, limit).collect():
            got.setdefault(x.request_id, {})[x.offer_seq] = x
        for q, xs in requests.items():
            n = sum(s == "delivered" and g != "picture" for _, g, _, s in xs)
            while n and rendered(xs, n) > limit:
                n -= 1
            size = rendered(xs, n)
            dropped = [k for k, x in got[q].items() if x.final_status == "omitted_response_limit"]
            assert (got[q][0].response_bytes, got[q][0].request_failed) == (size, size > limit)
            assert len(dropped) == sum(s == "delivered" and g != "picture" for _, g, _, s in xs) - n


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda batch: batch

    df = spark.range(40).repartition(12)
    assert models.apply_batch_model(df, load, "id long").count() == 40
    workers = open(log).read().split()
    assert len(workers) == len(set(workers)) <= 4
    many = [models.held(f"m{k}", lambda k=k: k) for k in range(models.HELD + 2)]
    assert many == list(range(models.HELD + 2)) and len(models._HELD) <= models.HELD


def test_settings_by_hand(spark):
    """The fast alternative is the defaults with its profile, whatever the request says; caps are checked in order."""
    schema = "request_id long, profile string, points_per_side int, points_per_batch int, multimask_output boolean, min_mask_region_area int, crop_n_layers int"
    df = spark.createDataFrame([(1, "quality", 128, 100, False, None, None), (2, None, 8, 65, None, None, None), (3, "balanced", None, None, None, 2_000_000, None), (4, "fast", 64, 64, True, None, 0), (5, None, 64, None, None, None, 2)], schema)
    judged = settings.admit_work(settings.estimate_work(settings.effective(df)))
    got = {r.request_id: (r.reason, r.warnings) for r in judged.collect()}
    assert got[1][0] == "points_per_side" and got[2][0] == "points_per_batch" and got[3][0] == "min_mask_region_area" and got[4] == (None, "") and got[5][0] == "estimated_prompt_count"
    first = settings.admissible_alternatives(judged.drop("reason", "warnings")).filter("request_id = 1 AND place = 1").first()
    assert (first.points_per_side, first.points_per_batch, first.multimask_output, first.crop_overlap_ratio) == (8, 8, 1, 512 / 1500)
    clamped = settings.admissible_alternatives(judged.drop("reason", "warnings")).filter("request_id = 2").orderBy("place").collect()
    assert [(r.points_per_batch, r.multimask_output) for r in clamped] == [(8, 1), (64, 0), (1, 0)]


def test_findings_are_sets(spark):
    schema = "file string, detector string, hash string"
    now, base = spark.createDataFrame([("a", "d", "1")] * 2 + [("b", "d", "2")], schema), spark.createDataFrame([("a", "d", "1"), ("c", "d", "3"), ("c", "d", "3")], schema)
    assert sorted((r.file, r.change, r.fails) for r in reports.findings_diff(now, base, strict=False).collect()) == [("b", "added", True), ("c", "removed", False)]


def test_rejects_name_their_limit(spark):
    rows = [(1, 0, 20, 20, 0, None, None, None, None), (1, 1, 20, 20, 5, 3, 3, 4, 4), (1, 2, 20, 20, 50, 0, 3, 9, 9), (1, 3, 20, 20, 50, 3, 3, 12, 3)]
    df = spark.createDataFrame(rows, "image_id long, source_index int, img_w int, img_h int, area long, x0_incl int, y0_incl int, x1_incl int, y1_incl int")
    judged = objects.filter_geometry(df, {"min_area": 10, "max_aspect_ratio": 2.5, "allow_border_touching": False})
    got = [(r.reason, r.limit_field, r.limit_value) for r in judged.orderBy("source_index").collect()]
    assert got == [("empty_mask", None, None), ("min_area", "min_area", 10.0), ("border_touching", "allow_border_touching", 0.0), ("max_aspect_ratio", "max_aspect_ratio", 2.5)]
    assert math.isclose(judged.filter("source_index = 3").first().aspect, 10.0)
