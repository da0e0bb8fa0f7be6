"""Interval jobs against pixel arrays on random masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import components, masks, objects

H, W, N = 11, 13, 12


def pixels_of(rows, keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), np.zeros((H, W), bool))[r.r0 : r.r1, r.col] = True
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(4)
    return {(i // 4, i % 4): rng.random((H, W)) < p for i, p in enumerate(np.linspace(0.05, 0.7, N))}


@pytest.fixture(scope="module")
def runs(spark, arrays):
    rows = []
    for (image, source), a in arrays.items():
        for col in range(W):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], a[:, col].astype(int), [0]])))
            rows += [(image, source, col, int(r0), int(r1)) for r0, r1 in edges.reshape(-1, 2)]
    return spark.createDataFrame(rows, "image_id long, source_index int, col int, r0 int, r1 int")


@pytest.fixture(scope="module")
def dims(spark, arrays):
    return spark.createDataFrame([(i, s, W, H, s) for i, s in arrays], "image_id long, source_index int, img_w int, img_h int, radius int")


KEYS = ["image_id", "source_index"]


def same(df, want, keys=KEYS):
    got = pixels_of(df.collect(), keys)
    assert set(got) <= set(want)
    for k, a in want.items():
        assert np.array_equal(got.get(k, np.zeros((H, W), bool)), a), k


def test_dilate(runs, dims, arrays):
    want = {}
    for (i, s), a in arrays.items():
        out = np.zeros_like(a)
        for y, x in zip(*np.nonzero(a), strict=True):
            for dy in range(-s, s + 1):
                for dx in range(-s, s + 1):
                    if dy * dy + dx * dx <= s * s and 0 <= y + dy < H and 0 <= x + dx < W:
                        out[y + dy, x + dx] = True
        want[i, s] = out
    same(masks.dilate(runs, dims), want)


def test_union_and_difference(runs, arrays):
    other = runs.withColumn("source_index", 3 - F.col("source_index"))
    flipped = {(i, s): arrays[i, 3 - s] for i, s in arrays}
    same(masks.mask_union(runs, other), {k: arrays[k] | flipped[k] for k in arrays})
    same(masks.mask_difference(runs, other), {k: arrays[k] & ~flipped[k] for k in arrays})


def test_depth(runs, arrays):
    for r in masks.depth_segments(runs).collect():
        deep = sum(arrays[r.image_id, s][:, r.col].astype(int) for s in range(4))
        assert (deep[r.r0 : r.r1] == r.depth).all()
        assert r.r0 == 0 or deep[r.r0 - 1] != r.depth
        assert r.r1 == H or deep[r.r1] != r.depth


def test_rle_round_trip(runs, dims, arrays):
    rle = masks.runs_to_rle(runs, dims.drop("radius"))
    for r in rle.collect():
        a = arrays[r.image_id, r.source_index].T.ravel().astype(int)
        want, last, n = [], 0, 0
        for v in a:
            if v == last:
                n += 1
            else:
                want.append(n)
                last, n = v, 1
        assert list(r.counts) == [*want, n]
    same(masks.rle_to_runs(rle), arrays)


def test_identity_is_paint_order(spark, runs, arrays):
    measured = masks.measure_masks(runs).withColumn("filtered_index", F.col("source_index"))
    objs = objects.order_objects(measured)
    ids = {(r.image_id, r.source_index): r.instance_id for r in objs.collect()}
    identity = masks.identity_map(objs, runs)
    got = {}
    for r in identity.collect():
        got.setdefault(r.image_id, np.zeros((H, W), int))[r.r0 : r.r1, r.col] = r.instance_id
    for image in got:
        paint = np.zeros((H, W), int)
        for s in sorted(range(4), key=lambda s: -ids.get((image, s), 0)):
            paint[arrays[image, s]] = ids.get((image, s), 0)
        assert np.array_equal(paint, got[image])
    hidden = {(r.image_id, r.instance_id): r for r in masks.visible_pixels(identity, objs).collect()}
    assert sum(r.visible for r in hidden.values()) == sum(int((a > 0).sum()) for a in got.values())


def test_components(spark, runs, arrays):
    got = {}
    for r in components.mask_components(runs).collect():
        got.setdefault((r.image_id, r.source_index), {}).setdefault(r.component, set()).update((y, r.col) for y in range(r.r0, r.r1))
    for k, a in arrays.items():
        left, parts = set(zip(*(x.tolist() for x in np.nonzero(a)), strict=True)), []
        while left:
            part, todo = set(), [left.pop()]
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
                left -= near
                todo += near
            parts.append(frozenset(part))
        assert set(parts) == {frozenset(p) for p in got.get(k, {}).values()}


def test_golden_histogram(spark):
    """Two diagonal masks on 4 x 5: 16 pixels bare, two covered once, two twice."""
    rows = [(1, s, c, c, c + 1) for s, cs in ((0, (0, 1, 2)), (1, (1, 2, 3))) for c in cs]
    df = spark.createDataFrame(rows, "image_id long, source_index int, col int, r0 int, r1 int")
    image = spark.createDataFrame([(1, 5, 4)], "image_id long, img_w int, img_h int")
    got = {r.depth: r.px for r in masks.overlap_histogram(masks.depth_segments(df), image).collect()}
    assert got == {0: 16, 1: 2, 2: 2}


def test_reason_precedence(spark):
    rows = [(1, k, 50, 40, a, *b) for k, (a, b) in enumerate([(10, (0, 0, 4, 1)), (101, (0, 0, 9, 9)), (0, (None,) * 4), (20, (0, 0, 9, 1)), (20, (0, 0, 1, 9)), (60, (0, 0, 9, 9))])]
    df = spark.createDataFrame(rows, "image_id long, source_index int, img_w int, img_h int, area long, x0_incl int, y0_incl int, x1_incl int, y1_incl int")
    got = [r.reason for r in objects.filter_area_bbox(df, 100, 5, 5).orderBy("source_index").collect()]
    assert got == [None, "maxsize", "empty_mask", "max_w", "max_h", "max_w"]


def outer_boundary(part, shape):
    """Pixels of a part beside background that a flood from outside reaches."""
    a = np.zeros((shape[0] + 2, shape[1] + 2), bool)
    for y, x in part:
        a[y + 1, x + 1] = True
    out, todo = np.zeros_like(a), [(0, 0)]
    while todo:
        y, x = todo.pop()
        if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and not a[y, x] and not out[y, x]:
            out[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return {(y, x) for y, x in part if out[y : y + 3, x : x + 3].any()}


def test_external_boundary_and_chords(runs, arrays):
    import math

    parts = {}
    named = components.mask_components(runs).cache()
    for r in named.collect():
        parts.setdefault((r.image_id, r.source_index, r.component), set()).update((y, r.col) for y in range(r.r0, r.r1))
    boundary = components.external_boundary(named).cache()
    got = {}
    for r in boundary.collect():
        got.setdefault((r.image_id, r.source_index, r.component), set()).update((y, r.col) for y in range(r.r0, r.r1))
    want = {k: outer_boundary(p, (H, W)) for k, p in parts.items()}
    assert got == want
    stats = {(r.image_id, r.source_index): r for r in components.chord_stats(boundary, runs).collect()}
    for k, a in arrays.items():
        ys, xs = np.nonzero(a)
        if not len(ys):
            continue
        cy, cx, x0, x1, y0, y1 = ys.sum() / len(ys), xs.sum() / len(xs), xs.min(), xs.max(), ys.min(), ys.max()
        found = []
        for py, px in set().union(*(w for q, w in want.items() if q[:2] == k)):
            vx, vy = cx - px, cy - py
            reach = [((hi if v > 0 else lo) - at) / v for v, at, lo, hi in ((vx, px, x0, x1), (vy, py, y0, y1)) if v]
            t = min([r for r in reach if r >= 1], default=1.0)
            ex, ey = (math.floor(min(max(at + t * v, lo), hi) + 0.5) for v, at, lo, hi in ((vx, px, x0, x1), (vy, py, y0, y1)))
            dx, dy = (ex - px, ey - py) if vx or vy else (0, 0)
            n = max(abs(dx), abs(dy))
            mark = lambda d, j: int(np.sign(d)) * ((2 * abs(d) * j + max(n, 1)) // (2 * max(n, 1)))  # noqa: B023, E731
            hits = sum(a[py + mark(dy, j), px + mark(dx, j)] for j in range(n + 1))
            found.append(min(max(math.ceil(hits * 0.2), 1), 16))
        r = stats[k]
        assert (r.rays, r.least, r.greatest) == (len(found), min(found), max(found)) and r.mean == pytest.approx(sum(found) / len(found))
