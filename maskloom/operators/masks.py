"""Mask geometry as interval algebra: a mask is rows (image_id, source_index, col, r0, r1), half-open in rows.

All sweeps are keyed by (image_id, ..., col), so they spread over columns of an image as well as over images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import sweeps

MASK = ["image_id", "source_index"]


def measure_masks(runs: DataFrame) -> DataFrame:
    """Area, inclusive box and centroid of each mask; sums stay whole numbers until the last division."""
    n = (F.col("r1") - F.col("r0")).cast("long")
    rows, cols = F.sum((F.col("r0") + F.col("r1") - 1) * n), F.sum(F.col("col") * n)
    return runs.groupBy(*MASK).agg(
        F.sum(n).alias("area"), F.min("col").alias("x0_incl"), F.min("r0").alias("y0_incl"), F.max("col").alias("x1_incl"), (F.max("r1") - 1).alias("y1_incl"),
        (rows.cast("double") / (F.sum(n) * 2.0)).alias("centroid_row"), (cols.cast("double") / F.sum(n)).alias("centroid_col"),
    )


def measured_batches(batches, runs: bool = False):
    """Batches of packed masks with the columns of `measure_masks`; runs: with their runs, too."""
    for batch, *flat in sweeps.mask_batches(batches):
        yield _with_measures(batch, *flat, runs)


def _with_measures(batch: pa.RecordBatch, of, col, r0, r1, runs: bool = False) -> pa.RecordBatch:
    some, first = np.unique(of, return_index=True)
    n = r1 - r0
    total = lambda x: np.add.reduceat(x, first) if len(first) else x
    area, rows, cols = total(n), total((r0 + r1 - 1) * n), total(col * n)
    edges = [np.minimum.reduceat(col, first), np.minimum.reduceat(r0, first), np.maximum.reduceat(col, first), np.maximum.reduceat(r1, first) - 1] if len(first) else [col] * 4
    whole = np.zeros(batch.num_rows, np.int64)
    whole[some] = area
    none = np.ones(batch.num_rows, bool)
    none[some] = False

    def full(x, kind):
        out = np.zeros(len(none), kind)
        out[some] = x
        return pa.array(out, mask=none)

    made = [pa.array(whole), *[full(x, np.int32) for x in edges], full(rows / (area * 2.0), np.float64), full(cols / area, np.float64)]
    kept = [k for k, name in enumerate(batch.schema.names) if runs or name != "runs"]
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *made], names=[*[batch.schema.names[k] for k in kept], *MEASURES])


def measured_with_depths(batches):
    """measured_batches of images whose masks follow one another; the first mask of an image has its pixels per depth, as `depths`."""
    find, _ = sweeps.counted(lambda counts: counts[0])
    for batch, image, of, col, r0, r1 in sweeps.image_batches(batches):
        g, _, a, b, depth = sweeps.stretches((image[of], col, r0, r1), [np.ones(len(of), np.int64)], find)
        order = np.lexsort((depth, g))
        g, depth, px = g[order], depth[order], (b - a)[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (depth[1:] != depth[:-1]))) if len(g) else g
        g, depth, px = g[first], depth[first], np.add.reduceat(px, first) if len(g) else px
        n = np.zeros(batch.num_rows + 1, np.int64)
        np.add.at(n, np.searchsorted(image, g) + 1, 1)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n).astype(np.int32)), pa.StructArray.from_arrays([pa.array(depth), pa.array(px)], ["depth", "px"]))
        made = _with_measures(batch, of, col, r0, r1)
        yield pa.RecordBatch.from_arrays([*made.columns, lists], names=[*made.schema.names, "depths"])


def measured(masks: DataFrame) -> DataFrame:
    """Packed masks without their runs, with the columns of `measure_masks`; an empty mask has area 0 and null for the rest."""
    kinds = ", ".join(f"`{c}` {sweeps.kind_of(masks, c)}" for c in masks.columns if c != "runs")
    return masks.mapInArrow(measured_batches, f"{kinds}, {MEASURE_KINDS}")


MEASURES = ("area", "x0_incl", "y0_incl", "x1_incl", "y1_incl", "centroid_row", "centroid_col")
MEASURE_KINDS = "area long, x0_incl int, y0_incl int, x1_incl int, y1_incl int, centroid_row double, centroid_col double"


def _any(counts):
    return (counts[0] > 0).astype(np.int64)


def _first_only(counts):
    return ((counts[0] > 0) & (counts[1] == 0)).astype(np.int64)


def merge_runs(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union of the intervals of each key and column; touching ones become one."""
    return sweeps.sweep(runs, [*(keys or MASK), "col"], sweeps.counted(_any), {"n": F.lit(1)}, None)


def depth_segments(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maximal row intervals of equal overlap depth per image and column; depth 0 is left out.

    Runs are dealt by column, and swept there. Packed masks, of which an image's follow one another in a task, are swept where they are.
    """
    how = sweeps.counted(lambda counts: counts[0])
    if "runs" in runs.columns:
        return sweeps.per_image(runs, [], how, "depth")
    return sweeps.sweep(runs, [*(by or ["image_id"]), "col"], how, {"n": F.lit(1)}, "depth")


def overlap_histogram(depth: DataFrame, images: DataFrame, most: int = 255) -> DataFrame:
    """Pixels per depth from 0 to min(deepest, most) of each image, with what lies deeper as overflow.

    depth: stretches, as `depth_segments` makes them, or image_id, depth and px, of each depth of an image once.
    """
    px = (F.col("r1") - F.col("r0")).cast("long")
    per = depth if "px" in depth.columns else depth.groupBy("image_id", "depth").agg(F.sum(px).alias("px"))
    # What is not deeper than `most` is so many pairs at most; they stay in their image's row.
    shallow = F.map_from_entries(F.collect_list(F.when(F.col("depth") <= most, F.struct("depth", "px"))))
    total = per.groupBy("image_id").agg(F.sum("px").alias("covered"), F.max("depth").alias("max_depth"), F.sum(F.when(F.col("depth") > most, F.col("px")).otherwise(0)).alias("overflow"), shallow.alias("shallow"))
    full = images.select("image_id", (F.col("img_w").cast("long") * F.col("img_h")).alias("pixels")).join(total.hint("merge"), "image_id", "left").na.fill(0, ["covered", "max_depth", "overflow"])
    full = full.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("max_depth"), F.lit(most)).cast("long"))))
    uncovered = F.col("pixels") - F.col("covered")
    px = F.coalesce(F.try_element_at("shallow", "depth"), F.lit(0).cast("long"))
    return full.select("image_id", "depth", F.when(F.col("depth") == 0, uncovered).otherwise(px).alias("px"), "covered", uncovered.alias("uncovered"), "max_depth", "overflow", (F.col("overflow") > 0).alias("truncated"))


def packed(runs: DataFrame) -> DataFrame:
    """A row per mask with its runs as an array of (col, r0, r1); rows of this form are left as they are.

    Operators that look at one mask at a time work on these rows where they are.
    """
    if "runs" in runs.columns:
        return runs
    return runs.groupBy(*MASK).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("col", "r0", "r1")])).alias("runs"))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge_runs(a.unionByName(b))


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of a that b lacks: one sweep over the runs of both."""
    of = lambda runs, k: runs.select(*MASK, "col", "r0", "r1", F.lit(1 - k).alias("a"), F.lit(k).alias("b"))
    return sweeps.sweep(of(a, 0).unionByName(of(b, 1)), [*MASK, "col"], sweeps.counted(_first_only), {"a": F.col("a"), "b": F.col("b")}, None)


def union_with_shifted(masks: DataFrame, by: int, down: int) -> DataFrame:
    """Union of each mask and of itself moved by columns and rows."""

    def work(_, of, col, r0, r1):
        return sweeps.united(*(np.concatenate(x) for x in ((of, of), (col, col + by), (r0, r0 + down), (r1, r1 + down))))

    return sweeps.per_mask(packed(masks), MASK, work)


def difference_from_shifted(masks: DataFrame, by: int, down: int) -> DataFrame:
    """Pixels of each mask that itself, moved by columns and rows, lacks."""

    def work(_, of, col, r0, r1):
        return sweeps.without((of, col, r0, r1), (of, col + by, r0 + down, r1 + down))

    return sweeps.per_mask(packed(masks), MASK, work)


def dilate(runs: DataFrame, dims: DataFrame | None = None, radius: str = "radius") -> DataFrame:
    """Exact Euclidean disk of whole-number radius, clipped to the image. dims: image_id, source_index, img_w, img_h, radius.

    Without dims these are columns of packed masks. A mask's runs are widened in the task that has them, step by step of columns.
    """
    size = ["img_w", "img_h", radius]
    masks = packed(runs)
    masks = masks if dims is None else masks.join(dims.select(*MASK, *size).hint("merge"), MASK)

    def work(batch, of, col, r0, r1):
        w, h, r = (x[of] for x in sweeps.numbers(batch, *size))
        made, held, n = (of[:0],) * 4, [], 0
        most = int(r.max()) if len(r) else -1
        for dx in range(-most, most + 1):
            k = np.flatnonzero((r >= abs(dx)) & (col + dx >= 0) & (col + dx < w))
            dy = np.sqrt((r[k] * r[k] - dx * dx).astype(np.float64)).astype(np.int64)
            a, b = np.maximum(r0[k] - dy, 0), np.minimum(r1[k] + dy, h[k])
            some = a < b
            held.append((of[k][some], col[k][some] + dx, a[some], b[some]))
            n += len(k)
            if n > sweeps.PIECES or dx == most:
                made, held, n = sweeps.united(*(np.concatenate(x) for x in zip(made, *held, strict=True))), [], 0
        return made

    return sweeps.per_mask(masks, MASK, work, *size)


def identity_map(objects: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Who owns each pixel: the larger object, the smaller instance_id on ties. objects: image_id, source_index, instance_id, area.

    Spark deals the runs by column and sorts them; a column is swept once, in the memory of those that overlap. Without runs the objects
    are packed masks, of which an image's follow one another in a task, and are swept where they are.
    """
    names = ["image_id", F.col("owner").cast("int").alias("instance_id"), "col", "r0", "r1"]
    if runs is None:
        return sweeps.per_image(objects, ["area", "instance_id"], sweeps.owned(), "owner", 1).select(*names)
    own = runs.join(objects.select(*MASK, "instance_id", "area").hint("merge"), MASK)
    rows = own.select(F.col("image_id").cast("long").alias("image_id"), "col", F.col("r0").cast("int").alias("r0"), F.col("r1").cast("int").alias("r1"), "area", "instance_id")
    return sweeps.sweep(rows, ["image_id", "col"], sweeps.owned(), {"area": F.col("area"), "owner": F.col("instance_id")}, "owner", 1).select(*names)


def visible_pixels(identity: DataFrame, objects: DataFrame) -> DataFrame:
    """Visible area, first visible pixel in row-major order, and whether an object is wholly hidden."""
    first = F.min(F.struct(F.col("r0").alias("row"), F.col("col").alias("col")))
    seen = identity.groupBy("image_id", "instance_id").agg(F.sum((F.col("r1") - F.col("r0")).cast("long")).alias("visible"), first.alias("first"))
    out = objects.select("image_id", "instance_id").join(seen.hint("merge"), ["image_id", "instance_id"], "left")
    return out.select("image_id", "instance_id", F.coalesce("visible", F.lit(0)).alias("visible"), F.col("first.row").alias("first_row"), F.col("first.col").alias("first_col"), F.col("visible").isNull().alias("hidden"))


def runs_to_rle(runs: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """Column-major counts starting with background, 0 if the first pixel is set; [w*h] for an empty mask. dims has one row per mask.

    Without dims img_w and img_h are columns of packed masks.
    """
    size = ["img_w", "img_h"]
    masks = packed(runs)
    masks = masks if dims is None else dims.select(*MASK, *size).join(masks.select(*MASK, "runs").hint("merge"), MASK, "left")

    rows = masks.select(*MASK, *size, "runs")
    return rows.mapInArrow(rle_batches, ", ".join(f"{k} {sweeps.kind_of(masks, k)}" for k in [*MASK, *size]) + ", counts array<bigint>")


def rle_batches(batches):
    """Batches of packed masks with img_w and img_h, with `counts` instead of their runs."""
    for batch, of, col, r0, r1 in sweeps.mask_batches(batches):
        w, h = sweeps.numbers(batch, "img_w", "img_h")
        total, base = w * h, col * h[of]
        g, _, s, e = sweeps.united(of, np.zeros(len(of), np.int64), base + r0, base + r1)
        n = np.bincount(g, minlength=len(total))
        first = np.cumsum(n) - n
        last = np.zeros(len(total), np.int64)
        last[g[np.append(first[1:], len(g))[n > 0] - 1]] = e[np.append(first[1:], len(g))[n > 0] - 1]
        before = np.append(0, e)[: len(e)]
        before[first[n > 0]] = 0
        tail = (last < total) | (n == 0)
        at = np.append(0, np.cumsum(2 * n + tail))
        counts = np.empty(at[-1], np.int64)
        place = at[g] + 2 * (np.arange(len(g)) - first[g])
        counts[place], counts[place + 1] = s - before, e - s
        counts[at[1:][tail] - 1] = (total - last)[tail]
        names = [c for c in batch.schema.names if c != "runs"]
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(counts))
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], lists], names=[*names, "counts"])


def rle_to_runs(rle: DataFrame) -> DataFrame:
    """Back to runs: odd positions are foreground; split at the edges of columns. Counts that do not fill the image are left out.

    A mask's counts are one row, so each row is worked on where it is.
    """

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).filter(pc.is_valid(batch.column(batch.schema.get_field_index("counts")))).combine_chunks()
            if not table.num_rows:
                continue
            lists = table.column("counts").combine_chunks()
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy()
            of, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            upto = np.cumsum(flat)
            sums = np.append(0, upto)[ends] - np.append(0, upto)[ends - n]
            w, h = (table.column(c).to_numpy().astype(np.int64) for c in ("img_w", "img_h"))
            good = (sums == w * h) & (np.bincount(of, flat < 0, len(n)) == 0)
            fore = np.flatnonzero(good[of] & (flat > 0) & ((np.arange(len(flat)) - (ends - n)[of]) % 2 == 1))
            of, tall = of[fore], h[of[fore]]
            e = upto[fore] - np.append(0, upto)[(ends - n)[of]]
            s = e - flat[fore]
            c0, c1 = s // tall, (e - 1) // tall + 1
            # Bounded pieces; a run over many columns makes as many rows.
            cuts = np.cumsum(c1 - c0) // sweeps.PIECES
            for part in np.unique(cuts):
                at = slice(np.searchsorted(cuts, part), np.searchsorted(cuts, part, "right"))
                i, c = sweeps.spread(c0[at], c1[at])
                base = c * tall[at][i]
                named = table.select(MASK).take(pa.array(of[at][i]))
                made = (c, np.maximum(s[at][i] - base, 0), np.minimum(e[at][i] - base, tall[at][i]))
                yield from pa.table([*named.columns, *[pa.array(x.astype(np.int32)) for x in made]], names=[*MASK, "col", "r0", "r1"]).to_batches()

    rows = rle.select(*MASK, "img_w", "img_h", "counts")
    return rows.mapInArrow(run, ", ".join(f"{k} {sweeps.kind_of(rle, k)}" for k in MASK) + ", col int, r0 int, r1 int")


def remap_masks(runs: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Masks of resized regions back on full images by inverse nearest neighbour.

    plan: image_id, roi_x, roi_y, roi_w, roi_h, res_w, res_h, one row per image; without it these are columns of packed masks. A target
    row r reads source row floor(r * (res_h / roi_h)), in doubles and in that order. What reads rows r0 to r1 is an interval: its ends
    are estimated by division and corrected by the formula itself, as a closed form alone would differ.
    """
    size = ["roi_x", "roi_y", "roi_w", "roi_h", "res_w", "res_h"]
    masks = packed(runs)
    masks = masks if plan is None else masks.join(plan.select("image_id", *size).hint("merge"), "image_id")

    def first(source, res, roi):
        """The first target whose source is not before `source`."""
        step = res.astype(np.float64) / roi
        reads = lambda i: np.minimum(np.floor(i * step).astype(np.int64), res - 1)
        guess = np.ceil(source / step).astype(np.int64)
        near = np.where((guess > 0) & (reads(guess - 1) >= source), guess - 1, np.where(reads(guess) >= source, guess, guess + 1))
        return np.where(source >= res, roi, np.minimum(near, roi))

    def work(batch, of, col, r0, r1):
        x, y, roi_w, roi_h, res_w, res_h = (v[of] for v in sweeps.numbers(batch, *size))
        a, b, c, d = first(r0, res_h, roi_h), first(r1, res_h, roi_h), first(col, res_w, roi_w), first(col + 1, res_w, roi_w)
        some = np.flatnonzero(a < b)
        i, at = sweeps.spread(c[some], d[some])
        i = some[i]
        return sweeps.united(of[i], at + x[i], a[i] + y[i], b[i] + y[i])

    return sweeps.per_mask(masks.filter("roi_w > 0 AND roi_h > 0 AND res_w > 0 AND res_h > 0"), MASK, work, *size)


def uncontained_runs(runs: DataFrame, crops: DataFrame) -> DataFrame:
    """Pixels of each mask outside its crop. crops: image_id, source_index, cx0, cy0, cx1, cy1 (end exclusive)."""
    both = runs.join(crops.select(*MASK, "cx0", "cy0", "cx1", "cy1").hint("merge"), MASK)
    inside = F.greatest(F.least("r1", "cy1") - F.greatest("r0", "cy0"), F.lit(0))
    outside = (F.col("r1") - F.col("r0")) - F.when(F.col("col").between(F.col("cx0"), F.col("cx1") - 1), inside).otherwise(0)
    return both.groupBy(*MASK).agg(F.sum(outside.cast("long")).alias("outside")).filter("outside > 0")


#: Cell sizes of the grids for pairs, by level; a box belongs to the first level whose cells are as long as its longer side.
GRID, STEP = 16, 4


def level_of(box: tuple[Column, Column, Column, Column], grid: int) -> Column:
    """Level of a box (inclusive edges): at its level it reaches four cells at most."""
    x0, y0, x1, y1 = box
    long = F.greatest(x1 - x0, y1 - y0) + 1
    # In whole numbers: an estimate by logarithm is corrected.
    guess = F.greatest(F.ceil(F.log(long / F.lit(grid)) / F.log(F.lit(float(STEP)))), F.lit(0)).cast("int")
    size = lambda k: F.lit(grid) * F.pow(F.lit(float(STEP)), k)
    return F.when((guess > 0) & (size(guess - 1) >= long), guess - 1).when(size(guess) < long, guess + 1).otherwise(guess)


def _cells(level: Column, box: tuple[Column, Column, Column, Column], grid: int) -> Column:
    size = F.lit(grid) * F.pow(F.lit(float(STEP)), level)
    x0, y0, x1, y1 = box
    cell = lambda v: F.floor(v / size).cast("long")
    columns = F.transform(F.sequence(cell(x0), cell(x1)), lambda x: F.transform(F.sequence(cell(y0), cell(y1)), lambda y: F.struct(level.alias("level"), x.alias("cell_x"), y.alias("cell_y"))))
    return F.flatten(columns)


#: An image of at most so many boxes is paired in its own row.
FEW = 64


def box_pairs(boxes: DataFrame, box: tuple[str, str, str, str], key: str, grid: int = GRID, few: int = FEW) -> DataFrame:
    """Each pair of boxes (inclusive edges, columns of `box`) of an image that meet, once: all columns, and those of the other with `o_` before their names.

    key tells boxes of an image apart. The boxes of an image with at most `few` are compared with one another where they are; those of
    larger images, if there are any, meet in grids (`grid_pairs`), dealt by cell.
    """
    large = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("image_id")
    large = staged(large, "large-images")
    some = not large.isEmpty()
    near = _close_pairs(boxes.join(large.hint("merge"), "image_id", "left_anti") if some else boxes, box, key)
    return near.unionByName(grid_pairs(boxes.join(large.hint("merge"), "image_id", "left_semi"), box, key, grid)) if some else near


def _close_pairs(boxes: DataFrame, box: tuple[str, str, str, str], key: str) -> DataFrame:
    """box_pairs of images whose boxes fit a row."""
    rest = [c for c in boxes.columns if c != "image_id"]
    x0, y0, x1, y1 = box
    per = boxes.groupBy("image_id").agg(F.collect_list(F.struct(*rest)).alias("all"))
    one = per.select("image_id", "all", F.explode("all").alias("a"))
    met = lambda b: (F.col("a")[key] < b[key]) & (b[x0] <= F.col("a")[x1]) & (F.col("a")[x0] <= b[x1]) & (b[y0] <= F.col("a")[y1]) & (F.col("a")[y0] <= b[y1])
    pairs = one.select("image_id", "a", F.explode("all").alias("b")).filter(met(F.col("b")))
    return pairs.select("image_id", *[F.col("a")[c].alias(c) for c in rest], *[F.col("b")[c].alias(f"o_{c}") for c in rest])


def grid_pairs(boxes: DataFrame, box: tuple[str, str, str, str], key: str, grid: int = GRID) -> DataFrame:
    """box_pairs by cells, for images of any number of boxes.

    Boxes live in the grid of their own level, at most four rows each, and visit the cells of the coarser levels that occur, at most
    four rows a level: a large box is not cut into small cells. A pair meets at the level of the larger box, and counts in the one
    cell that holds the later of its left and of its upper edges.
    """
    edges = tuple(F.col(c) for c in box)
    at = boxes.withColumn("own", level_of(edges, grid))
    home = at.withColumns({"cell": F.explode(_cells(F.col("own"), edges, grid))}).select("*", "cell.*").drop("cell")
    levels = [r[0] for r in at.select("own").distinct().collect()]  # a level is a power of STEP: some dozen at most
    visited = F.filter(F.array(*[F.lit(k) for k in sorted(levels)]), lambda k: k >= F.col("own"))
    guests = at.withColumn("cell", F.explode(F.flatten(F.transform(visited, lambda k: _cells(k, edges, grid))))).select("*", "cell.*").drop("cell")
    other = guests.select("image_id", "level", "cell_x", "cell_y", *[F.col(c).alias(f"o_{c}") for c in at.columns if c != "image_id"])
    met = home.join(other.hint("merge"), ["image_id", "level", "cell_x", "cell_y"])
    size = F.lit(grid) * F.pow(F.lit(float(STEP)), "level")
    a, b = box[0], box[1]
    once = (F.col("cell_x") == F.floor(F.greatest(a, f"o_{a}") / size)) & (F.col("cell_y") == F.floor(F.greatest(b, f"o_{b}") / size))
    ahead = (F.col("own") > F.col("o_own")) | ((F.col("own") == F.col("o_own")) & (F.col(key) < F.col(f"o_{key}")))
    return met.filter(ahead & once).drop("level", "cell_x", "cell_y", "own", "o_own")


def box_overlap(boxes: DataFrame, cell: int = GRID) -> DataFrame:
    """Area that each half-open box shares with the boxes before it in its image. boxes: image_id, ord, bx0, by0, bx1, by1. cell: the size of the finest grid."""
    some = boxes.select("image_id", "ord", "bx0", "by0", "bx1", "by1").filter("bx0 < bx1 AND by0 < by1").withColumns({"bx2": F.col("bx1") - 1, "by2": F.col("by1") - 1})
    both = box_pairs(some, ("bx0", "by0", "bx2", "by2"), "ord", cell)
    w = F.greatest(F.least("bx1", "o_bx1") - F.greatest("bx0", "o_bx0"), F.lit(0))
    h = F.greatest(F.least("by1", "o_by1") - F.greatest("by0", "o_by0"), F.lit(0))
    shared = both.groupBy("image_id", F.greatest("ord", "o_ord").alias("ord")).agg(F.sum((w * h).cast("long")).alias("overlap"))
    return boxes.select("image_id", "ord").join(shared.hint("merge"), ["image_id", "ord"], "left").na.fill(0, ["overlap"])
