"""Mask operators on packed masks and by sweeps, against rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import masks, sweeps
from maskloom.plans import fixtures, masks as plans

SCHEMA = "image_id long, source_index int, col int, r0 int, r1 int"


def shuffles(df):
    """Exchanges of a plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def raster(rows, shape=(40, 40)):
    out = {}
    for r in rows:
        out.setdefault((r.image_id, r.source_index), np.zeros(shape, bool))[r.col, r.r0 : r.r1] = True
    return out


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for m in range(12):
        for c in range(3, 25):
            ends = np.sort(rng.choice(np.arange(2, 30), 4, replace=False)).tolist()
            rows += [(m // 3, m % 3, c, ends[0], ends[1]), (m // 3, m % 3, c, ends[2], ends[3])] if rng.random() < 0.7 else []
    return spark.createDataFrame(rows, SCHEMA)


def moved(mask, by, down):
    return np.roll(mask, (by, down), (0, 1))


def test_set05_with_shifted_masks(spark, sf, runs):
    """no run is dealt to another task."""
    before = raster(runs.collect())
    for made, what in ((masks.union_with_shifted(runs, 2, 3), lambda m: m | moved(m, 2, 3)), (masks.difference_from_shifted(runs, 2, 3), lambda m: m & ~moved(m, 2, 3))):
        rows = made.collect()
        got = raster(rows)
        assert all(np.array_equal(got[k], what(m)) for k, m in before.items())
        keys = sorted((r.image_id, r.source_index, r.col, r.r0, r.r1) for r in rows)
        assert all(a[:3] != b[:3] or a[4] < b[3] for a, b in zip(keys, keys[1:], strict=False))  # maximal runs
    assert shuffles(plans.set05_union(spark, sf)) == shuffles(plans.set05_difference(spark, sf)) == 1


def test_prj03_remaps_where_the_masks_are(spark, sf):
    """F2."""
    assert shuffles(plans.prj03(spark, sf)) == 1


def test_geo01_makes_no_row_per_step(spark, sf, monkeypatch):
    """steps of a disk are no rows, and bounded pieces give the same."""
    assert shuffles(plans.geo01(spark, sf)) == 1 and "explode" not in plans.geo01(spark, sf)._jdf.queryExecution().toString()


def test_rle_queries_deal_candidates_only(spark, sf):
    """F7, F15."""
    assert shuffles(plans.win05(spark, sf)) == shuffles(plans.win06(spark, sf)) == 1


def test_flt06_deals_counts_not_lists(spark, sf):
    """the window over an image's masks holds numbers."""
    plan = plans.flt06(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "counts" not in plan[plan.index("Window") : plan.index("Exchange", plan.index("Window"))].split("\n", 2)[1]


def test_packed_masks_are_the_runs(spark, sf):
    cand = fixtures.candidates(spark, sf)
    a = fixtures.packed_masks(cand).select("image_id", "source_index", F.inline("runs"))
    assert a.exceptAll(fixtures.mask_runs(cand)).isEmpty() and fixtures.mask_runs(cand).exceptAll(a).isEmpty()


def test_tasks_grow_in_number(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_OF_TASK", 500)
    df = fixtures.candidates(spark, sf)
    assert df.rdd.getNumPartitions() == -(-fixtures.table(spark, sf, "lineitem").count() // 500)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_sweeps_over_batches_of_any_size(size):
    """Runs that reach over the end of a batch wait, cut."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 120
    key, r0 = np.sort(rng.integers(0, 4, n)), rng.integers(0, 40, n)
    order = np.lexsort((r0, key))
    key, r0 = key[order], r0[order].astype(np.int64)
    r1, area, owner = r0 + rng.integers(1, 12, n), rng.integers(1, 6, n), rng.permutation(n).astype(np.int64)
    table = pa.table({"key": key, "r0": r0, "r1": r1, "n": np.ones(n, np.int64), "area": area, "owner": owner})
    want = {}
    for k in range(4):
        depth, best = np.zeros(60, int), {}
        for a, b, s, o in zip(r0[key == k], r1[key == k], area[key == k], owner[key == k], strict=True):
            depth[a:b] += 1
            for y in range(a, b):
                best[y] = max(best.get(y, (0, 0)), (s, -o))
        want[k] = (depth, np.array([2 * -best[y][1] + 1 if y in best else 0 for y in range(60)]))
    for which, (how, others) in enumerate(((sweeps.counted(lambda c: c[0]), ["n"]), (sweeps.owned(), ["area", "owner"]))):
        rows = [r for t in sweeps.swept(iter(table.select(["key", "r0", "r1", *others]).to_batches(max_chunksize=size)), ["key"], others, how) for r in t.to_pylist()]
        for k in range(4):
            got, last = np.zeros(60, int), None
            for r in rows:
                if r["key"] == k:
                    got[r["r0"] : r["r1"]] += r["value"]
                    assert last != (r["r0"], r["value"])  # maximal
                    last = (r["r1"], r["value"])
            assert np.array_equal(got, want[k][which])


def test_images_are_swept_where_their_masks_are(spark, sf):
    """F10, F16, F17, F18, F19: packed masks and runs give the same, and the packed ones' pixels are not dealt."""
    cand = fixtures.candidates(spark, sf)
    a, b = masks.depth_segments(fixtures.packed_masks(cand)), masks.depth_segments(fixtures.mask_runs(cand)).select("image_id", "col", "r0", "r1", "depth")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and shuffles(a) == 1
    objects = plans.objects_of(spark, sf)
    a, b = plans.geo03(spark, sf), masks.identity_map(objects, fixtures.mask_runs(cand))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and shuffles(a) == shuffles(objects)


def test_measures_of_packed_masks(spark, sf):
    cand = fixtures.candidates(spark, sf)
    a = masks.measured(fixtures.packed_masks(cand, empty=True)).filter("area > 0")
    b = masks.measure_masks(fixtures.mask_runs(cand))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_boundaries_and_chords_where_the_masks_are(spark, sf):
    """F6, F11."""
    from maskloom.operators import components
    from maskloom.plans import streams

    runs = fixtures.mask_runs(fixtures.candidates(spark, sf).filter("image_id < 200"))
    wide = components.external_boundary(components.mask_components(runs)).groupBy("image_id", "source_index").agg(F.sum((F.col("r1") - F.col("r0")).cast("long")).alias("boundary"))
    a = streams.geo08(spark, sf).filter("image_id < 200")
    assert a.exceptAll(wide).isEmpty() and wide.exceptAll(a).isEmpty()
    assert components.chord_stats(runs).exceptAll(streams.geo09(spark, sf)).isEmpty()
    assert shuffles(streams.geo08(spark, sf)) == shuffles(streams.geo09(spark, sf)) == 1


def test_manifests_and_rules_are_compared_in_one_pass(spark, sf):
    """rows are dealt once, to tasks that grow in number, and the one count gives what both sides apart give."""
    from maskloom.operators import artifacts, settings
    from maskloom.plans import artifacts as offers, requests

    one, apart = offers.set02(spark, sf), artifacts.manifests_equal(offers.hashed_of(spark, sf), offers.other_of(spark, sf))
    assert one.collect() == apart.collect() and shuffles(one) == 2  # the offers, and the one row
    one = requests.jon08(spark, sf)
    apart = settings.missing_and_orphan_rules(requests._names(spark, sf, "l_partkey"), requests._names(spark, sf, "l_suppkey"))
    assert one.exceptAll(apart).isEmpty() and apart.exceptAll(one).isEmpty() and shuffles(one) == 1
