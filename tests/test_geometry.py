"""View geometry, components, boundaries and chords against pixel rasters; exporter and audits by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import components, masks, objects, reports, scoring, settings
from maskloom.operators.objects import ViewConfig


def runs_of(pixels):
    """Runs of a raster [row, col]."""
    out = []
    for col in range(pixels.shape[1]):
        rows = np.flatnonzero(np.diff(np.concatenate([[0], pixels[:, col].astype(np.int8), [0]])))
        out += [(col, int(a), int(b)) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    return out


def shapes():
    """Rasters with holes, rings in rings, diagonal touches, single pixels and noise."""
    r, out = np.random.default_rng(3), []
    ring = np.zeros((11, 12), bool)
    ring[1:10, 1:11] = True
    ring[3:8, 3:9] = False
    ring[5, 5] = True
    diagonal = np.eye(7, dtype=bool)
    gate = ring.copy()
    gate[5, 1:3] = False
    corner = ring.copy()
    corner[1, 1] = corner[2, 2] = False
    out += [ring, diagonal, gate, corner, np.ones((1, 1), bool), np.ones((3, 9), bool)]
    for density in (0.2, 0.45, 0.6, 0.8):
        out += [r.random((int(r.integers(2, 14)), int(r.integers(2, 14)))) < density for _ in range(6)]
    return [m for m in out if m.any()]


def flood(free, start, corners):
    """Pixels reached from start over free ones."""
    seen, todo = {start}, [start]
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    while todo:
        y, x = todo.pop()
        for a, b in steps:
            p = (y + a, x + b)
            if 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p] and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def parts_of(pixels):
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(pixels), strict=True)}, []
    while left:
        part = flood(pixels, min(left), True)
        out.append(part)
        left -= part
    return out


def boundary_of(part):
    ys, xs = [y for y, _ in part], [x for _, x in part]
    box = np.ones((max(ys) - min(ys) + 3, max(xs) - min(xs) + 3), bool)
    for y, x in part:
        box[y - min(ys) + 1, x - min(xs) + 1] = False
    outside = {(y + min(ys) - 1, x + min(xs) - 1) for y, x in flood(box, (0, 0), False)}
    return {(y, x) for y, x in part if any((y + a, x + b) in outside for a in (-1, 0, 1) for b in (-1, 0, 1))}


@pytest.fixture(scope="module")
def drawn(spark):
    rasters = shapes()
    rows = [(k % 5, k, *run) for k, m in enumerate(rasters) for run in runs_of(m)]
    return rasters, spark.createDataFrame(rows, "image_id long, source_index int, col int, r0 int, r1 int").repartition(3)


def pixels_of(rows):
    return {(y, r.col) for r in rows for y in range(r.r0, r.r1)}


def test_components_and_boundaries_against_flood_fill(drawn):
    rasters, runs = drawn
    parts = components.mask_components(runs)
    named, edges = parts.collect(), components.external_boundary(parts).collect()
    for k, m in enumerate(rasters):
        mine = {}
        for r in named:
            if r.source_index == k:
                mine.setdefault(r.component, []).append(r)
        want = parts_of(m)
        assert sorted(map(sorted, (pixels_of(v) for v in mine.values()))) == sorted(map(sorted, want))
        got = {}
        for r in edges:
            if r.source_index == k:
                got.setdefault(r.component, []).append(r)
        assert sorted(map(sorted, (pixels_of(v) for v in got.values()))) == sorted(sorted(boundary_of(p)) for p in want)


def test_components_across_batches(spark, drawn):
    """Masks that are cut by the borders of Arrow batches."""
    _, runs = drawn
    want = sorted(map(tuple, components.chord_stats(runs).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, components.chord_stats(runs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def distance(m, px, py):
    """Pixels of the mask on the raster line from a boundary pixel through the centroid to the edge of the mask's box."""
    ys, xs = np.nonzero(m)
    x, y = xs.sum() / len(xs), (2 * ys).sum() / (2.0 * len(ys))
    x0, x1, y0, y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
    vx, vy = x - px, y - py
    if vx == 0 and vy == 0:
        return 1
    times = [t for v, at, lo, hi in ((vx, px, x0, x1), (vy, py, y0, y1)) if v for t in [((hi if v > 0 else lo) - at) / v] if t >= 1]
    t = min(times, default=1.0)
    ex, ey = (math.floor(min(max(at + t * v, lo), hi) + 0.5) for at, v, lo, hi in ((px, vx, x0, x1), (py, vy, y0, y1)))
    n = max(abs(ex - px), abs(ey - py))
    count = 0
    for k in range(n + 1):
        step = lambda d: (1 if d > 0 else -1 if d < 0 else 0) * ((2 * abs(d) * k + max(n, 1)) // (2 * max(n, 1)))  # noqa: E731, B023
        count += bool(m[py + step(ey - py), px + step(ex - px)])
    return count


def test_chords_against_rasters(drawn):
    rasters, runs = drawn
    got = {r.source_index: r for r in components.chord_stats(runs).collect()}
    for k, m in enumerate(rasters):
        edge = set().union(*(boundary_of(p) for p in parts_of(m)))
        d = [min(max(math.ceil(distance(m, x, y) * 0.2), 1), 16) for y, x in edge]
        r = got[k]
        assert (r.rays, r.least, r.greatest) == (len(d), min(d), max(d)) and r["mean"] == pytest.approx(sum(d) / len(d))


def grown(m, radius):
    out = np.zeros_like(m)
    ys, xs = np.nonzero(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            out[y, x] = bool(((ys - y) ** 2 + (xs - x) ** 2 <= radius * radius).any())
    return out


def test_views_against_dilated_rasters(spark):
    r, rasters = np.random.default_rng(5), []
    for _ in range(40):
        m = np.zeros((24, 30), bool)
        y, x, h, w = (int(v) for v in (r.integers(0, 20), r.integers(0, 26), r.integers(1, 14), r.integers(1, 14)))
        m[y : y + h, x : x + w] = r.random(m[y : y + h, x : x + w].shape) < 0.7
        if m.any():
            rasters.append(m)
    rows = [(0, k, *run) for k, m in enumerate(rasters) for run in runs_of(m)]
    runs = spark.createDataFrame(rows, "image_id long, source_index int, col int, r0 int, r1 int")
    measured = masks.measure_masks(runs).withColumns({"img_w": F.lit(30), "img_h": F.lit(24)})
    config = ViewConfig()
    views = {v.source_index: v for v in objects.verification_views(measured, config).collect()}
    shifted = {v.source_index: v for v in objects.shift_crop(measured, config).collect()}
    seen = set()
    for k, m in enumerate(rasters):
        ys, xs = np.nonzero(m)
        x0, x1, y0, y1 = (int(v) for v in (xs.min(), xs.max(), ys.min(), ys.max()))
        w, h = x1 - x0 + 1, y1 - y0 + 1
        radius = min(max(math.ceil(config.context_fraction * max(w, h)), 0), 64)
        width = min(max(math.ceil(config.contour_fraction * max(w, h)), 1), 3)
        need = grown(grown(m, radius), width)
        nw, nh = math.ceil(2.0 * w), math.ceil(2.0 * h)
        ox, oy = math.floor((x0 + x1) / 2 - (nw - 1) / 2), math.floor((y0 + y1) / 2 - (nh - 1) / 2)
        box = [max(0, min(30, ox)), max(0, min(24, oy)), max(0, min(30, ox + nw)), max(0, min(24, oy + nh))]
        outside = need.copy()
        outside[box[1] : box[3], box[0] : box[2]] = False
        v = views[k]
        assert [v.cx0, v.cy0, v.cx1, v.cy1] == box and (v.support_radius, v.contour_width) == (radius, width)
        assert (v.status == "rejected") == bool(outside.any()) == (v.view_reason == objects.REJECTED_VIEW)
        seen.add(v.status)
        # The nearest crop of full size that holds everything needed, by trying all of them.
        nw, nh = min(nw, 30), min(nh, 24)
        ry, rx = np.nonzero(need)
        fit = lambda n, size, a, b: [o for o in range(size - n + 1) if o <= a and b < o + n]
        near = lambda n, size, a, b, mid: min(fit(n, size, a, b), key=lambda o: (abs(o - max(0, min(size, mid))), o), default=None)
        mx, my = math.floor((x0 + x1) / 2 - (nw - 1) / 2), math.floor((y0 + y1) / 2 - (nh - 1) / 2)
        sx, sy = near(nw, 30, rx.min(), rx.max(), mx), near(nh, 24, ry.min(), ry.max(), my)
        s = shifted[k]
        assert (s.crop_x, s.crop_y) == ((sx, sy) if sx is not None and sy is not None else (None, None))
        assert s.crop_shifted == (None if s.crop_x is None else (sx, sy) != (mx, my))
    assert seen == {"ready", "rejected"}
    # By hand: columns 1 and 2 with a multiplier of 1.5 give a crop of three columns that begins at 0.
    one = spark.createDataFrame([(0, 0, 1, 2, 5, 5, 2, 9, 9)], "image_id long, source_index int, x0_incl int, x1_incl int, y0_incl int, y1_incl int, area long, img_w int, img_h int")
    assert objects.verification_views(one, ViewConfig(crop_multiplier=1.5)).first().cx0 == 0


def test_exporter_by_hand(spark):
    """A mask of 2 by 2 in an image of 4 by 4, cut to the region 1,1,3,3."""
    runs = spark.createDataFrame([(7, 0, c, 1, 3) for c in (1, 2)] + [(7, 1, 0, 0, 1), (7, 2, 3, 3, 4)], "image_id long, source_index int, col int, r0 int, r1 int")
    found = spark.createDataFrame([(7, 0, 1, "cat"), (7, 1, 2, "cat"), (7, 2, 3, None)], "image_id long, source_index int, instance_id int, label string")
    images = spark.createDataFrame([(7, 4, 4), (8, 4, 4)], "image_id long, img_w int, img_h int")
    got = {r.image_id: r.text for r in objects.export_lines(found, runs, images, ["cat", "dog"], "1,1,3,3").collect()}
    assert got == {7: "0 0.166667 0.166667 0.666667 0.666667", 8: ""}
    whole = objects.export_lines(found, runs, images, []).filter("image_id = 7").first().text.split("\n")
    assert len(whole) == 3 and whole[0].startswith("0 0.375000")


def test_routing_takes_the_rank_of_the_chosen_target(spark):
    """Two targets tie: the list decides the target, and the rank is that one's."""
    scores = [("a", 0, 0.9, 1), ("b", 1, 0.5, 2), ("c", 2, 0.5, 3)]
    vector = [(0, 0, [(o, k, s, n) for k, o, s, n in scores], "a")]
    df = spark.createDataFrame(vector, "image_id long, source_index int, scores array<struct<class_order:int,class_id:string,score:double,rank:int>>, winner string")
    r = scoring.route_reasons(df, scoring.RoutePolicy(("c", "b"), ("a",), 2, 0.4, 0.5)).first()
    assert (r.target, r.target_rank, r.reason) == ("c", 3, "target_within_score_margin")
    assert r.reasons == ["target_within_score_margin", "target_exceeded_minimum_score", "explicitly_uncertain"]


def test_prompts_in_blocks(spark, monkeypatch):
    cands = spark.createDataFrame([(k, 0, [float(k), 1.0]) for k in range(5)], "image_id long, source_index int, embedding array<double>")
    prompts = spark.createDataFrame([(k, f"c{k}", 0, [1.0, float(k)]) for k in range(7)], "class_order int, class_id string, prompt_index int, embedding array<double>")
    want = sorted(map(tuple, scoring.score_prompts(cands, prompts).collect()))
    monkeypatch.setattr(scoring, "PROMPT_BLOCK", 2)
    assert sorted(map(tuple, scoring.score_prompts(cands, prompts).collect())) == want and len(want) == 35


def test_accounting_tells_a_tampered_row(spark):
    df = spark.createDataFrame([(1, 5, 3, 2), (2, 5, 3, 1)], "k int, evaluated int, retained int, rejected int")
    bad = reports.accounting_violations(df, ["k"], {"evaluated": (F.col("evaluated"), F.col("retained") + F.col("rejected"))}).collect()
    assert [tuple(r) for r in bad] == [(2, "evaluated", 5.0, 4.0)]


def test_stage_order(spark):
    rows = [(1, 1, "a", "executed"), (1, 2, "b", "skipped"), (2, 2, "a", "executed"), (2, 1, "b", "executed"), (3, 1, "a", "executed"), (4, 1, "a", "odd"), (4, 2, "b", "executed"), (5, 1, "a", "executed"), (5, 2, "b", "executed"), (5, 3, "c", "executed")]
    got = reports.stage_order_problems(spark.createDataFrame(rows, "request_id int, seq int, stage string, status string"), ["a", "b"]).collect()
    assert {r.request_id: r.problem for r in got} == {2: "wrong_order", 3: "missing_stage", 4: "unknown_status", 5: "surplus_stage"}


def test_setting_violations(spark):
    df = spark.createDataFrame([(1, {"a": "5"}), (2, {"a": "x"}), (3, {"a": "99"}), (4, {"b": "1", "old_b": "1"}), (5, {"a": "9", "old_b": "2"}), (6, {"flag": "maybe"}), (7, {})], "request_id int, settings map<string,string>")
    got = settings.setting_violations(df, {"a": ("int", 0, 10), "b": ("number", 0, 10), "flag": ("bool", 0, 1)}, (("a", "b"),), {"old_b": "b"}).collect()
    assert {r.request_id: (r.field, r.problem) for r in got} == {2: ("a", "type"), 3: ("a", "range"), 4: ("b", "conflict"), 5: ("a", "order"), 6: ("flag", "type")}
