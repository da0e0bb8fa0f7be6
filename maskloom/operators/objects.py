"""From candidates to final objects: geometry filters, numbering, class ids, label lines, view planning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import GRID, MASK, box_pairs

#: Reasons of the geometry filter in order of precedence.
GEOMETRY_REASONS = ("empty_mask", "min_area", "max_area", "min_width", "max_width", "min_height", "max_height", "min_aspect_ratio", "max_aspect_ratio", "border_touching")


def with_measures(cand: DataFrame, measures: DataFrame) -> DataFrame:
    """Candidates with their measures; empty masks keep null boxes and area 0."""
    return cand.join(measures.hint("merge"), MASK, "left").withColumn("area", F.coalesce("area", F.lit(0).cast("long")))


def drop_empty(cand: DataFrame, runs: DataFrame) -> DataFrame:
    return cand.join(runs.select(*MASK).distinct().hint("merge"), MASK, "left_semi")


def filter_area_bbox(measured: DataFrame, maxsize: int, max_w: int, max_h: int, area: str = "area") -> DataFrame:
    """Adds `reason` (null: kept): declared area first, then emptiness, then width and height; strict limits."""
    w, h = F.col("x1_incl") - F.col("x0_incl") + 1, F.col("y1_incl") - F.col("y0_incl") + 1
    reason = F.when(F.col(area) > maxsize, "maxsize").when(F.col("x0_incl").isNull(), "empty_mask").when(w > max_w, "max_w").when(h > max_h, "max_h")
    sized = reason.isNull() | reason.isin("max_w", "max_h")
    return measured.withColumns({"reason": reason, "bbox_w": F.when(sized, w).otherwise(0), "bbox_h": F.when(sized, h).otherwise(0)})


def filter_geometry(measured: DataFrame, limits: dict) -> DataFrame:
    """Adds width, height, aspect, touches_border, `reason` (null: kept), and of a reject limit_field and limit_value, the limit that it broke.

    limits: min_ and max_ of area, width, height and aspect_ratio, and allow_border_touching; one that is absent or null is off.
    An empty mask breaks no limit; allow_border_touching has the value 0.
    """
    w, h = F.col("x1_incl") - F.col("x0_incl") + 1, F.col("y1_incl") - F.col("y0_incl") + 1
    m = measured.withColumns({"width": w, "height": h, "aspect": w / h, "touches_border": (F.col("x0_incl") == 0) | (F.col("y0_incl") == 0) | (F.col("x1_incl") == F.col("img_w") - 1) | (F.col("y1_incl") == F.col("img_h") - 1)})
    broken = lambda reason, field, value: F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("field"), F.lit(value).cast("double").alias("value"))
    verdict = F.when(F.col("area") == 0, broken("empty_mask", None, None))
    for column, name in (("area", "area"), ("width", "width"), ("height", "height"), ("aspect", "aspect_ratio")):
        low, high = f"min_{name}", f"max_{name}"
        if limits.get(low) is not None:
            verdict = verdict.when(F.col(column) < limits[low], broken(low, low, limits[low]))
        if limits.get(high) is not None:
            verdict = verdict.when(F.col(column) > limits[high], broken(high, high, limits[high]))
    if limits.get("allow_border_touching") is False:
        verdict = verdict.when(F.col("touches_border"), broken("border_touching", "allow_border_touching", 0))
    judged = m.withColumn("verdict", verdict)
    return judged.withColumns({"reason": F.col("verdict.reason"), "limit_field": F.col("verdict.field"), "limit_value": F.col("verdict.value")}).drop("verdict")


def filter_diagnostics(judged: DataFrame, reasons=GEOMETRY_REASONS, more: tuple[Column, ...] = ()) -> DataFrame:
    """Counts per image of what was evaluated, kept and removed, by reason. more: further aggregates of an image's rows, in the same pass."""
    removed = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"removed_by_{r}") for r in reasons]
    return judged.groupBy("image_id").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("area") > 0).alias("non_empty"), F.count_if(F.col("reason").isNull()).alias("retained"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), *removed, *more)


def bounded_records(judged: DataFrame, n: int = 256) -> DataFrame:
    """The first n rejections per image in source order, with the limit that each broke (where the filter tells) and how many more there were."""
    rejects = judged.filter("reason IS NOT NULL")
    per = Window.partitionBy("image_id")
    rows = rejects.withColumns({"record": F.row_number().over(per.orderBy("source_index")), "truncated": F.greatest(F.count(F.lit(1)).over(per) - n, F.lit(0))})
    told = [c for c in ("limit_field", "limit_value") if c in judged.columns]
    return rows.filter(F.col("record") <= n).select(*MASK, "reason", *told, "record", "truncated")


def assign_filtered_index(kept: DataFrame) -> DataFrame:
    return kept.withColumn("filtered_index", F.row_number().over(Window.partitionBy("image_id").orderBy("source_index")) - 1)


def order_objects(kept: DataFrame, area: str = "area") -> DataFrame:
    """instance_id from 1: larger area first, then upper, then left centroid, then filtered position."""
    order = Window.partitionBy("image_id").orderBy(F.col(area).desc(), "centroid_row", "centroid_col", "filtered_index")
    return kept.withColumn("instance_id", F.row_number().over(order))


def map_class_ids(objects: DataFrame, class_labels: list[str]) -> DataFrame:
    """class_id by the first place of the trimmed label in the list; else 0 from `fallback`, with a warning for labels that are not null."""
    spark = objects.sparkSession
    places: dict[str, int] = {}
    for k, label in enumerate(class_labels):
        places.setdefault(label.strip(), k)
    known = spark.createDataFrame(list(places.items()), "__label string, __id int")
    out = objects.join(F.broadcast(known), F.trim("label") == F.col("__label"), "left")
    missing = F.col("__id").isNull()
    return out.withColumns({"class_id": F.coalesce("__id", F.lit(0)), "class_source": F.when(missing, "fallback").otherwise("label"), "warning": F.when(missing & F.col("label").isNotNull(), F.concat(F.lit("no class for label "), "label"))}).drop("__label", "__id")


def normalize_bbox(objects: DataFrame) -> DataFrame:
    """Box centre and size relative to the image; the centre is the mean of inclusive edges, without + 1."""
    return objects.withColumns({
        "cx": (F.col("x0_incl") + F.col("x1_incl")) / 2 / F.col("img_w"), "cy": (F.col("y0_incl") + F.col("y1_incl")) / 2 / F.col("img_h"),
        "nw": (F.col("x1_incl") - F.col("x0_incl") + 1) / F.col("img_w"), "nh": (F.col("y1_incl") - F.col("y0_incl") + 1) / F.col("img_h"),
    })


def six(col: str | Column) -> Column:
    """Six decimals, rounding the exact binary value half to even."""
    return F.call_function("format_number", F.col(col) if isinstance(col, str) else col, F.lit("0.000000"))


def yolo_lines(objects: DataFrame, images: DataFrame) -> DataFrame:
    """One text per image: a line per object in final order, empty without objects."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[six(c) for c in ("cx", "cy", "nw", "nh")])
    per = objects.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("instance_id", line.alias("line")))).alias("l"))
    return images.select("image_id").join(per, "image_id", "left").select("image_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))


def export_lines(objects: DataFrame, runs: DataFrame, images: DataFrame, labels: list[str], roi: str | None = None) -> DataFrame:
    """Label lines of a data set, cut to a region: one text per image, empty without objects.

    Labels outside the list are dropped (an empty list keeps all, as class 0; a repeated label has its last place). Masks are
    cut to the region and measured again inside it, and what is empty there is left out. objects: image_id, source_index,
    instance_id, label; images: image_id, img_w, img_h.
    """
    if labels:
        places = F.create_map(*[F.lit(x) for pair in {label: k for k, label in enumerate(labels)}.items() for x in pair])
        objects = objects.filter(F.col("label").isin(labels)).withColumn("class_at", F.element_at(places, F.col("label")))
    else:
        objects = objects.withColumn("class_at", F.lit(0))
    x, y, w, h = (int(v) for v in roi.split(",")) if roi else (0, 0, None, None)
    size = lambda full, at, n: (F.col(full) if n is None else F.least(F.col(full), F.lit(at + n))) - at
    region = images.select("image_id", size("img_w", x, w).alias("rw"), size("img_h", y, h).alias("rh"))
    cut = runs.join(region.hint("shuffle_hash"), "image_id")
    cut = cut.select(*MASK, "rw", "rh", (F.col("col") - x).alias("col"), F.greatest(F.col("r0") - y, F.lit(0)).alias("r0"), F.least(F.col("r1") - y, F.col("rh")).alias("r1")).filter("col >= 0 AND col < rw AND r0 < r1")
    box = cut.groupBy(*MASK).agg(F.first("rw").alias("rw"), F.first("rh").alias("rh"), F.min("col").alias("a"), F.max("col").alias("c"), F.min("r0").alias("b"), (F.max("r1") - 1).alias("d"))
    both = objects.select(*MASK, "instance_id", "class_at").join(box.hint("merge"), MASK)
    numbers = ((F.col("a") + F.col("c")) / 2 / F.col("rw"), (F.col("b") + F.col("d")) / 2 / F.col("rh"), (F.col("c") - F.col("a") + 1) / F.col("rw"), (F.col("d") - F.col("b") + 1) / F.col("rh"))
    line = F.concat_ws(" ", F.col("class_at").cast("string"), *[six(n) for n in numbers])
    per = both.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("instance_id", line.alias("line")))).alias("l"))
    return images.select("image_id").join(per.hint("merge"), "image_id", "left").select("image_id", F.coalesce(F.array_join(F.transform("l", lambda v: v["line"]), "\n"), F.lit("")).alias("text"))


def rounded(col: str, places: int) -> Column:
    """A number with fixed decimals, rounded half to even, as JSON prints it plainly."""
    return F.bround(col, places).cast(f"decimal(18,{places})")


def record_struct() -> Column:
    """The public facts of an object, keys in order; null ones are left out of JSON."""
    return F.struct(
        F.col("area").alias("area_px"), F.array(*[rounded(c, 6) for c in ("cx", "cy", "nw", "nh")]).alias("bbox_normalized"), F.array("x0_incl", "y0_incl", "x1_incl", "y1_incl").alias("bbox_xyxy"),
        F.array(rounded("centroid_row", 3), rounded("centroid_col", 3)).alias("centroid_rc"), "class_id", "filtered_index", "instance_id", "label", (F.col("source_index") + 1).alias("source_candidate_id"), F.when(F.col("warning").isNotNull(), F.array("warning")).alias("warnings"),
    )


def object_records(objects: DataFrame) -> DataFrame:
    """One JSON record per object with rounded geometry, sorted keys and no null fields."""
    return objects.select("image_id", "instance_id", F.to_json(record_struct()).alias("record"))


def keep_labels(objects: DataFrame, labels: list[str]) -> DataFrame:
    """An empty list keeps all; otherwise null labels go."""
    return objects.filter(F.col("label").isin(labels)) if labels else objects


def enforce_run_budget(rle: DataFrame, per_object: int, total: int) -> DataFrame:
    """Verdict per object: its own run count over the limit, or its image's total."""
    n = F.col("runs")
    sums = F.sum(n).over(Window.partitionBy("image_id"))
    return rle.select(*MASK, F.size("counts").cast("long").alias("runs")).select(*MASK, n, sums.alias("image_runs"), F.when(n > per_object, "object_runs").when(sums > total, "image_runs").alias("violation"))


def enforce_object_limit(objects: DataFrame, most: int = 256) -> DataFrame:
    """Images with more objects than allowed fail as a whole."""
    return objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("objects")).withColumn("failed", F.col("objects") > most)


def clip_crop_boxes(measured: DataFrame, fraction: float = 0.1, low: int = 2, high: int = 64) -> DataFrame:
    """Crop for labelling: the box grown by floor(fraction * longer side + 0.5), bounded, clamped, end exclusive."""
    w, h = F.col("x1_incl") - F.col("x0_incl") + 1, F.col("y1_incl") - F.col("y0_incl") + 1
    r = F.least(F.greatest(F.floor(F.greatest(w, h) * fraction + 0.5).cast("int"), F.lit(low)), F.lit(high))
    return measured.withColumns({"crop_radius": r, "cx0": F.greatest(F.col("x0_incl") - r, F.lit(0)), "cy0": F.greatest(F.col("y0_incl") - r, F.lit(0)), "cx1": F.least(F.col("x1_incl") + 1 + r, F.col("img_w")), "cy1": F.least(F.col("y1_incl") + 1 + r, F.col("img_h"))})


@dataclass(frozen=True)
class ViewConfig:
    """How much surrounding a verification view shows. The defaults."""

    context_fraction: float = 0.20
    min_context: int = 0
    max_context: int = 64
    crop_multiplier: float = 2.0
    sigma_fraction: float = 0.15
    contour: bool = True
    contour_fraction: float = 0.02
    min_contour: int = 1
    max_contour: int = 3


#: Fixed value: the reason of a rejected view.
REJECTED_VIEW = "crop_cannot_contain_support_and_contour"


def _clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def _view_plan(measured: DataFrame, config: ViewConfig) -> DataFrame:
    """Adds support_radius, contour_width, sigma, the required box (nx0 to ny1, inclusive) and the nominal size and origin of the crop.

    A disk reaches its radius along both axes, so the box of the dilated and outlined mask is the mask's box grown by
    radius and width, cut at the image: containment in a rectangle needs no pixels.
    """
    w, h = F.col("x1_incl") - F.col("x0_incl") + 1, F.col("y1_incl") - F.col("y0_incl") + 1
    longer = F.greatest(w, h)
    support = _clamp(F.ceil(longer * config.context_fraction).cast("int"), config.min_context, config.max_context)
    contour = _clamp(F.ceil(longer * config.contour_fraction).cast("int"), config.min_contour, config.max_contour) if config.contour else F.lit(0)
    grown = F.col("support_radius") + F.col("contour_width")
    # floor((first + last) / 2 - (n - 1) / 2), in integers: half of a sum, towards minus infinity.
    centred = lambda a, b, n: F.floor((F.col(a) + F.col(b) + 1 - F.col(n)) / 2).cast("int")
    return measured.withColumns({
        "support_radius": support, "contour_width": contour, "sigma": _clamp(longer * config.sigma_fraction, 2.0, 20.0),
        "nominal_w": F.ceil(w * config.crop_multiplier).cast("int"), "nominal_h": F.ceil(h * config.crop_multiplier).cast("int"),
    }).withColumns({
        "nx0": F.greatest(F.col("x0_incl") - grown, F.lit(0)), "ny0": F.greatest(F.col("y0_incl") - grown, F.lit(0)),
        "nx1": F.least(F.col("x1_incl") + grown, F.col("img_w") - 1), "ny1": F.least(F.col("y1_incl") + grown, F.col("img_h") - 1),
        "origin_x": centred("x0_incl", "x1_incl", "nominal_w"), "origin_y": centred("y0_incl", "y1_incl", "nominal_h"),
    })


def verification_views(measured: DataFrame, config: ViewConfig = ViewConfig()) -> DataFrame:
    """Support radius, contour width, blur width and crop (end exclusive, cut at the image) of each candidate's view.

    `status` is rejected, with `view_reason`, where the crop does not hold the whole support and contour.
    """
    v = _view_plan(measured, config)
    cut = lambda c, size: F.greatest(F.lit(0), F.least(F.col(size), c)).cast("int")
    v = v.withColumns({"cx0": cut(F.col("origin_x"), "img_w"), "cy0": cut(F.col("origin_y"), "img_h"), "cx1": cut(F.col("origin_x") + F.col("nominal_w"), "img_w"), "cy1": cut(F.col("origin_y") + F.col("nominal_h"), "img_h")})
    held = (F.col("cx0") <= F.col("nx0")) & (F.col("cy0") <= F.col("ny0")) & (F.col("nx1") < F.col("cx1")) & (F.col("ny1") < F.col("cy1"))
    status = F.when(held, "ready").otherwise("rejected")
    return v.withColumns({"status": status, "view_reason": F.when(~held, REJECTED_VIEW)}).drop("nominal_w", "nominal_h", "origin_x", "origin_y")


def drop_infeasible_views(objects: DataFrame, views: DataFrame, routed_path: bool = True) -> DataFrame:
    """Objects whose view was not rejected; on the older path, without routing and geometry filter, all stay."""
    if not routed_path:
        return objects
    return objects.join(views.filter("status = 'rejected'").select(*MASK).hint("merge"), MASK, "left_anti")


def shift_crop(measured: DataFrame, config: ViewConfig = ViewConfig()) -> DataFrame:
    """Nearest crop of nominal size, no larger than the image, that holds support and contour; null where none does.

    Adds crop_x, crop_y, crop_w, crop_h and crop_shifted, whether it is not the centred one.
    """
    v = _view_plan(measured, config)

    def axis(first: str, last: str, n: str, need0: str, need1: str, size: str) -> tuple[Column, Column]:
        centred = F.floor((F.col(first) + F.col(last) + 1 - F.col(n)) / 2).cast("int")
        lower = F.greatest(F.lit(0), F.col(need1) + 1 - F.col(n))
        upper = F.least(F.col(need0), F.col(size) - F.col(n))
        start = F.least(F.greatest(F.greatest(F.lit(0), F.least(F.col(size), centred)), lower), upper)
        return F.when(lower <= upper, start), centred

    v = v.withColumns({"crop_w": F.least("nominal_w", "img_w"), "crop_h": F.least("nominal_h", "img_h")})
    x, cx = axis("x0_incl", "x1_incl", "crop_w", "nx0", "nx1", "img_w")
    y, cy = axis("y0_incl", "y1_incl", "crop_h", "ny0", "ny1", "img_h")
    v = v.withColumns({"crop_x": F.when(y.isNotNull(), x).cast("int"), "crop_y": F.when(x.isNotNull(), y).cast("int"), "crop_shifted": (x != cx) | (y != cy)})
    return v.withColumn("crop_shifted", F.when(F.col("crop_x").isNotNull(), F.col("crop_shifted"))).drop("nominal_w", "nominal_h", "origin_x", "origin_y")


def contact_pages(cand: DataFrame, per_page: int = 12, across: int = 4, most: int = 96) -> DataFrame:
    """Page and tile of each represented candidate, and how many are left out."""
    per = Window.partitionBy("image_id")
    at = F.row_number().over(per.orderBy("source_index")) - 1
    rows = cand.withColumns({"at": at, "truncated": F.greatest(F.count(F.lit(1)).over(per) - most, F.lit(0))}).filter(F.col("at") < most)
    return rows.select(*MASK, F.expr(f"at div {per_page} + 1").cast("int").alias("page"), F.expr(f"(at % {per_page}) div {across}").cast("int").alias("tile_row"), F.expr(f"(at % {per_page}) % {across}").cast("int").alias("tile_col"), "truncated")


def segment_intersections(segments: DataFrame, cell: int = GRID) -> DataFrame:
    """Where pairs of segments of an image cross, inside both and inside the image. segments: image_id, seg, sx1, sy1, sx2, sy2, img_w, img_h.

    Only segments whose boxes meet are paired, in an image of many in grids. cell: the size of the finest grid.
    """
    line = lambda p: {"a": F.col(f"{p}sy1") - F.col(f"{p}sy2"), "b": F.col(f"{p}sx2") - F.col(f"{p}sx1")}
    ends = ("image_id", "seg", "sx1", "sy1", "sx2", "sy2", "img_w", "img_h")
    boxed = segments.select(*ends, F.least("sx1", "sx2").alias("left"), F.least("sy1", "sy2").alias("top"), F.greatest("sx1", "sx2").alias("right"), F.greatest("sy1", "sy2").alias("bottom"))
    pairs = box_pairs(boxed, ("left", "top", "right", "bottom"), "seg", cell)
    # The segment with the smaller number stands first.
    swap = F.col("seg") > F.col("o_seg")
    order = {c: F.when(swap, F.col(f"o_{c}")).otherwise(F.col(c)) for c in ends[1:6]} | {f"o_{c}": F.when(swap, F.col(c)).otherwise(F.col(f"o_{c}")) for c in ends[1:6]}
    pairs = pairs.select("image_id", "img_w", "img_h", *[v.alias(k) for k, v in order.items()])
    p, q = line(""), line("o_")
    c1, c2 = p["a"] * F.col("sx1") + p["b"] * F.col("sy1"), q["a"] * F.col("o_sx1") + q["b"] * F.col("o_sy1")
    det = (p["a"] * q["b"] - q["a"] * p["b"]).cast("double")
    det = F.when(F.abs(det) >= 1e-9, det)  # null of parallel ones: Spark may look at x and y before the filter
    x, y = (c1 * q["b"] - c2 * p["b"]) / det, (p["a"] * c2 - q["a"] * c1) / det
    # Inlined from a row of its own, so that the long terms of x and y are worked out once and not in each comparison.
    pairs = pairs.filter(det.isNotNull()).select("*", F.inline(F.array(F.struct(x.alias("x"), y.alias("y")))))
    inside = lambda v, lo, hi: (F.col(v) >= F.least(lo, hi) - 1e-9) & (F.col(v) <= F.greatest(lo, hi) + 1e-9)
    hit = inside("x", "sx1", "sx2") & inside("y", "sy1", "sy2") & inside("x", "o_sx1", "o_sx2") & inside("y", "o_sy1", "o_sy2") & (F.col("x") >= 0) & (F.col("x") < F.col("img_w")) & (F.col("y") >= 0) & (F.col("y") < F.col("img_h"))
    return pairs.filter(hit).select("image_id", "seg", F.col("o_seg").alias("other"), "x", "y")


def clamp_roi(images: DataFrame, roi: str | None) -> DataFrame:
    """Region of interest `x,y,w,h` clamped to each image; blank, none and false mean the whole image."""
    if roi is None or roi.strip().lower() in ("", "none", "false"):
        x, y, w, h = 0, 0, None, None
    else:
        parts = [int(p) for p in roi.split(",")]
        if len(parts) != 4:
            raise ValueError("a region of interest has four whole numbers")
        x, y, w, h = parts
    fit = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(v), F.col(size)))
    x1, y1 = fit(x, "img_w"), fit(y, "img_h")
    x2 = F.col("img_w") if w is None else F.least(F.col("img_w"), F.greatest(F.lit(x + w), x1))
    y2 = F.col("img_h") if h is None else F.least(F.col("img_h"), F.greatest(F.lit(y + h), y1))
    return images.withColumns({"roi_x": x1, "roi_y": y1, "roi_w": x2 - x1, "roi_h": y2 - y1})


def plan_resize(regions: DataFrame, factor: float | None) -> DataFrame:
    """Resized dimensions of each region, truncated, and the mode."""
    if factor is None or abs(factor - 1) < 1e-7:
        return regions.withColumns({"res_w": F.col("roi_w"), "res_h": F.col("roi_h"), "mode": F.lit("native")})
    return regions.withColumns({"res_w": (F.col("roi_w") * factor).cast("int"), "res_h": (F.col("roi_h") * factor).cast("int"), "mode": F.lit("downscale" if factor < 1 else "upscale")})


def admit_images(images: DataFrame, max_pixels: int, max_w: int, max_h: int, formats=("JPEG", "PNG", "WEBP")) -> DataFrame:
    """Adds `reason` (null: accepted); the first failing check counts."""
    pixels = F.col("img_w").cast("long") * F.col("img_h")
    reason = F.when(F.col("n_bytes") == 0, "invalid_image").when(~F.col("format").isin(*formats), "unsupported_format").when((F.col("img_w") < 1) | (F.col("img_h") < 1), "invalid_image").when((F.col("img_w") > max_w) | (F.col("img_h") > max_h), "image_too_large").when(pixels > max_pixels, "too_many_pixels")
    return images.withColumn("reason", reason)


def tile_grid(images: DataFrame, rows: int = 3, cols: int = 4) -> DataFrame:
    """Tiles of each image as candidate boxes, end exclusive."""
    t = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    edge = lambda k, size, n: F.expr(f"({k}) * {size} div {n}").cast("int")
    t = t.select("image_id", F.expr(f"i * {cols} + j").alias("source_index"), edge("j", "img_w", cols).alias("tx0"), edge("i", "img_h", rows).alias("ty0"), edge("j + 1", "img_w", cols).alias("tx1"), edge("i + 1", "img_h", rows).alias("ty1"))
    return t.withColumn("area", ((F.col("tx1") - F.col("tx0")).cast("long") * (F.col("ty1") - F.col("ty0"))))


def diagnostic_dims(images: DataFrame, pixels: int = 2_000_000) -> DataFrame:
    """Size of a diagnostic picture: at most so many pixels, never larger than the image."""
    n = F.col("img_w").cast("double") * F.col("img_h")
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(pixels)) / n))
    side = lambda c: F.when(n > 0, F.greatest(F.floor(F.col(c) * scale), F.lit(1))).otherwise(0).cast("int")
    return images.withColumns({"diag_w": side("img_w"), "diag_h": side("img_h")})


def model_dims(boxes: DataFrame, w: str, h: str, short: int = 256, long: int = 768) -> DataFrame:
    """Short side scaled up to `short`, long side held to `long`, half up, at least 1."""
    a, b = F.least(w, h).cast("double"), F.greatest(w, h).cast("double")
    scale = F.when(a < short, F.lit(float(short)) / a).otherwise(F.lit(1.0))
    scale = F.when(b * scale > long, F.lit(float(long)) / b).otherwise(scale)
    side = lambda c: F.greatest(F.floor(F.col(c) * scale + 0.5), F.lit(1)).cast("int")
    return boxes.withColumns({"model_w": side(w), "model_h": side(h)})


def score_text(col: str) -> Column:
    """Three decimals, or n/a."""
    c = F.col(col)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "n/a").otherwise(F.call_function("format_number", c, F.lit("0.000")))
