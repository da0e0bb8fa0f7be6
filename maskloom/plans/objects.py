"""Queries from candidates to objects, and over image dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as ops
from ..operators import objects as obj
from .base import query
from .fixtures import BASE, F1_SQL, IMAGES_SQL, candidates, duck, images, mask_runs, measured_masks
from .masks import ORDERED_SQL, judged_of, objects_of

LABELS = ["R", "A", "R"]

TYPED_SQL = """
typed AS (SELECT objs.*, CASE label WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 0 END AS class_id, CASE WHEN label IN ('R', 'A') THEN 'label' ELSE 'fallback' END AS class_source,
  CASE WHEN label IN ('R', 'A') THEN NULL ELSE 'no class for label ' || label END AS warning,
  CAST(x0_incl + x1_incl AS DOUBLE) / 2 / img_w AS cx, CAST(y0_incl + y1_incl AS DOUBLE) / 2 / img_h AS cy, CAST(x1_incl - x0_incl + 1 AS DOUBLE) / img_w AS nw, CAST(y1_incl - y0_incl + 1 AS DOUBLE) / img_h AS nh FROM objs)
"""
OBJECTS = (*BASE, ORDERED_SQL, TYPED_SQL)


def typed(objects):
    return obj.normalize_bbox(obj.map_class_ids(objects, LABELS))


def typed_of(spark, sf_dir):
    return typed(objects_of(spark, sf_dir))


@query("win01_order_objects", duck(*OBJECTS) + " SELECT image_id, instance_id, source_index, filtered_index, label, class_id, area, cx, cy, nw, nh FROM typed")
def win01(spark, sf_dir):
    return typed_of(spark, sf_dir).select("image_id", "instance_id", "source_index", "filtered_index", "label", "class_id", "area", "cx", "cy", "nw", "nh")


@query("win02_filtered_index", duck(*BASE, ORDERED_SQL) + " SELECT image_id, source_index, filtered_index FROM kept")
def win02(spark, sf_dir):
    return obj.assign_filtered_index(judged_of(spark, sf_dir).filter("reason IS NULL")).select("image_id", "source_index", "filtered_index")


@query("flt01_area_bbox", duck(*BASE) + """,
j AS (SELECT f1.*, coalesce(area, 0) AS area, x0_incl, x1_incl - x0_incl + 1 AS w, y1_incl - y0_incl + 1 AS h FROM f1 LEFT JOIN meas USING (image_id, source_index)),
r AS (SELECT *, CASE WHEN area > 200 THEN 'maxsize' WHEN x0_incl IS NULL THEN 'empty_mask' WHEN w > 18 THEN 'max_w' WHEN h > 15 THEN 'max_h' END AS reason FROM j)
SELECT image_id, source_index, reason, CASE WHEN reason IS NULL OR reason IN ('max_w', 'max_h') THEN w ELSE 0 END AS bbox_w, CASE WHEN reason IS NULL OR reason IN ('max_w', 'max_h') THEN h ELSE 0 END AS bbox_h FROM r""")
def flt01(spark, sf_dir):
    cand = candidates(spark, sf_dir)
    out = obj.filter_area_bbox(obj.with_measures(cand, ops.measure_masks(mask_runs(cand))), 200, 18, 15)
    return out.select("image_id", "source_index", "reason", "bbox_w", "bbox_h")


_BROKEN_SQL = """CASE reason WHEN 'empty_mask' THEN NULL WHEN 'border_touching' THEN 'allow_border_touching' ELSE reason END AS limit_field,
  CAST(CASE reason WHEN 'min_area' THEN 12 WHEN 'max_area' THEN 260 WHEN 'min_width' THEN 2 WHEN 'max_width' THEN 20 WHEN 'min_height' THEN 2 WHEN 'max_height' THEN 17 WHEN 'min_aspect_ratio' THEN 0.2 WHEN 'max_aspect_ratio' THEN 6 WHEN 'border_touching' THEN 0 END AS DOUBLE) AS limit_value"""


@query("flt02_geometry", duck(*BASE, ORDERED_SQL) + """ SELECT image_id, source_index, area, width, height, aspect, touches_border, reason, """ + _BROKEN_SQL + " FROM reasoned")
def flt02(spark, sf_dir):
    return judged_of(spark, sf_dir).select("image_id", "source_index", "area", "width", "height", "aspect", "touches_border", "reason", "limit_field", "limit_value")


@query("flt03_keep_labels", duck(*OBJECTS) + " SELECT image_id, instance_id, label FROM typed WHERE label IN ('A', 'N')")
def flt03(spark, sf_dir):
    return obj.keep_labels(typed_of(spark, sf_dir), ["A", "N"]).select("image_id", "instance_id", "label")


@query("flt04_drop_empty", duck(*BASE) + " SELECT image_id, source_index, label FROM f1 SEMI JOIN meas USING (image_id, source_index)")
def flt04(spark, sf_dir):
    cand = candidates(spark, sf_dir)
    return obj.drop_empty(cand, mask_runs(cand)).select("image_id", "source_index", "label")


@query("flt07_object_limit", duck(*OBJECTS) + " SELECT image_id, count(*) AS objects, count(*) > 4 AS failed FROM typed GROUP BY image_id")
def flt07(spark, sf_dir):
    return obj.enforce_object_limit(typed_of(spark, sf_dir), 4)


_REASONS = ("empty_mask", "min_area", "max_area", "min_width", "max_width", "min_height", "max_height", "min_aspect_ratio", "max_aspect_ratio", "border_touching")
_REASONS_SQL = ", ".join(f"count(*) FILTER (reason = '{r}') AS removed_by_{r}" for r in _REASONS)


@query("agg02_filter_diagnostics", duck(*BASE, ORDERED_SQL) + f" SELECT image_id, count(*) AS evaluated, count(*) FILTER (area > 0) AS non_empty, count(*) FILTER (reason IS NULL) AS retained, count(reason) AS rejected, {_REASONS_SQL} FROM reasoned GROUP BY image_id")
def agg02(spark, sf_dir):
    return obj.filter_diagnostics(judged_of(spark, sf_dir))


@query("win12_bounded_records", duck(*BASE, ORDERED_SQL) + f""",
n AS (SELECT image_id, source_index, reason, {_BROKEN_SQL}, CAST(row_number() OVER (PARTITION BY image_id ORDER BY source_index) AS INT) AS record, greatest(count(*) OVER (PARTITION BY image_id) - 3, 0) AS truncated FROM reasoned WHERE reason IS NOT NULL)
SELECT * FROM n WHERE record <= 3""")
def win12(spark, sf_dir):
    return obj.bounded_records(judged_of(spark, sf_dir), 3)


@query("jon05_class_ids", duck(*OBJECTS) + " SELECT image_id, instance_id, label, class_id, class_source, warning FROM typed")
def jon05(spark, sf_dir):
    return typed_of(spark, sf_dir).select("image_id", "instance_id", "label", "class_id", "class_source", "warning")


@query("agg17_warnings", duck(*OBJECTS) + " SELECT image_id, string_agg('object ' || instance_id || ': ' || warning, '; ' ORDER BY instance_id) AS warnings FROM typed WHERE warning IS NOT NULL GROUP BY image_id")
def agg17(spark, sf_dir):
    t = typed_of(spark, sf_dir).filter("warning IS NOT NULL")
    text = F.concat(F.lit("object "), F.col("instance_id").cast("string"), F.lit(": "), "warning").alias("t")
    return t.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("instance_id", text))).alias("w")).select("image_id", F.array_join(F.transform("w", lambda x: x["t"]), "; ").alias("warnings"))


@query("prj10_normalized_boxes", duck(*OBJECTS) + " SELECT image_id, instance_id, cx, cy, nw, nh FROM typed")
def prj10(spark, sf_dir):
    return typed_of(spark, sf_dir).select("image_id", "instance_id", "cx", "cy", "nw", "nh")


#: Public records of objects as JSON text with sorted keys.
RECORDS_SQL = """
recs AS (SELECT *, '{{"area_px":' || area || ',"bbox_normalized":[' || concat_ws(',', printf('%.6f', round_even(cx, 6)), printf('%.6f', round_even(cy, 6)), printf('%.6f', round_even(nw, 6)), printf('%.6f', round_even(nh, 6))) || '],"bbox_xyxy":[' || concat_ws(',', x0_incl, y0_incl, x1_incl, y1_incl)
  || '],"centroid_rc":[' || printf('%.3f', round_even(centroid_row, 3)) || ',' || printf('%.3f', round_even(centroid_col, 3)) || '],"class_id":' || class_id || ',"filtered_index":' || filtered_index || ',"instance_id":' || instance_id || ',"label":"' || label || '","source_candidate_id":' || (source_index + 1)
  || CASE WHEN warning IS NULL THEN '' ELSE ',"warnings":["' || warning || '"]' END || '}}' AS record FROM typed)
"""


@query("prj11_object_records", duck(*OBJECTS, RECORDS_SQL) + " SELECT image_id, instance_id, record FROM recs")
def prj11(spark, sf_dir):
    return obj.object_records(typed_of(spark, sf_dir))


_EXPORT_SQL = """
sz AS (SELECT DISTINCT image_id, least(img_w, 40) - 8 AS rw, least(img_h, 30) - 5 AS rh FROM f1),
ct AS (SELECT r.image_id, r.source_index, rw, rh, col - 8 AS c, unnest(range(r0, r1)) - 5 AS y FROM runs r JOIN sz USING (image_id)),
bx AS (SELECT image_id, source_index, rw, rh, min(c) AS a, max(c) AS c, min(y) AS b, max(y) AS d FROM ct WHERE c >= 0 AND c < rw AND y >= 0 AND y < rh GROUP BY ALL),
ln AS (SELECT image_id, string_agg(CASE label WHEN 'R' THEN 0 ELSE 1 END || ' ' || printf('%.6f', (a + c) / 2.0e0 / rw) || ' ' || printf('%.6f', (b + d) / 2.0e0 / rh) || ' ' || printf('%.6f', (c - a + 1) * 1.0e0 / rw) || ' ' || printf('%.6f', (d - b + 1) * 1.0e0 / rh), chr(10) ORDER BY instance_id) AS text
  FROM objs JOIN bx USING (image_id, source_index) WHERE label IN ('R', 'N') GROUP BY image_id)
"""


@query("snk02_exported_lines", duck(*BASE, ORDERED_SQL, _EXPORT_SQL) + " SELECT image_id, coalesce(text, '') AS text FROM sz LEFT JOIN ln USING (image_id)")
def snk02_export(spark, sf_dir):
    cand = candidates(spark, sf_dir)
    return obj.export_lines(objects_of(spark, sf_dir), mask_runs(cand), cand.select("image_id", "img_w", "img_h").distinct(), ["R", "N"], "8,5,32,25")


@query("snk02_label_lines", duck(*OBJECTS) + """,
l AS (SELECT image_id, string_agg(class_id || ' ' || printf('%.6f', cx) || ' ' || printf('%.6f', cy) || ' ' || printf('%.6f', nw) || ' ' || printf('%.6f', nh), chr(10) ORDER BY instance_id) AS text FROM typed GROUP BY image_id)
SELECT i.image_id, coalesce(text, '') AS text FROM (SELECT DISTINCT image_id FROM f1) i LEFT JOIN l USING (image_id)""")
def snk02(spark, sf_dir):
    return obj.yolo_lines(typed_of(spark, sf_dir), candidates(spark, sf_dir).select("image_id").distinct())


@query("geo04_crop_boxes", duck(*BASE) + """,
c AS (SELECT meas.*, img_w, img_h, CAST(least(greatest(CAST(floor(greatest(x1_incl - x0_incl + 1, y1_incl - y0_incl + 1) * 0.1e0 + 0.5e0) AS INT), 2), 64) AS INT) AS r FROM meas JOIN f1 USING (image_id, source_index))
SELECT image_id, source_index, r AS crop_radius, greatest(x0_incl - r, 0) AS cx0, greatest(y0_incl - r, 0) AS cy0, least(x1_incl + 1 + r, img_w) AS cx1, least(y1_incl + 1 + r, img_h) AS cy1 FROM c""")
def geo04(spark, sf_dir):
    return obj.clip_crop_boxes(measured_of(spark, sf_dir)).select("image_id", "source_index", "crop_radius", "cx0", "cy0", "cx1", "cy1")


def measured_of(spark, sf_dir):
    return measured_masks(candidates(spark, sf_dir), empty=False)


#: Support, contour, required box and crop of every mask, in floating point as the centre is defined.
VIEWS_SQL = """
vm AS (SELECT meas.*, img_w, img_h, x1_incl - x0_incl + 1 AS w, y1_incl - y0_incl + 1 AS h, greatest(x1_incl - x0_incl, y1_incl - y0_incl) + 1 AS longer FROM meas JOIN f1 USING (image_id, source_index)),
vr AS (SELECT *, CAST(least(greatest(ceil(longer * 0.2e0), 0), 64) AS INT) AS support_radius, CAST(least(greatest(ceil(longer * 0.02e0), 1), 3) AS INT) AS contour_width, least(greatest(longer * 0.15e0, 2.0e0), 20.0e0) AS sigma,
  CAST(ceil(w * 2.0e0) AS INT) AS nw, CAST(ceil(h * 2.0e0) AS INT) AS nh FROM vm),
vn AS (SELECT *, greatest(x0_incl - support_radius - contour_width, 0) AS nx0, greatest(y0_incl - support_radius - contour_width, 0) AS ny0, least(x1_incl + support_radius + contour_width, img_w - 1) AS nx1, least(y1_incl + support_radius + contour_width, img_h - 1) AS ny1,
  CAST(floor((x0_incl + x1_incl) / 2.0e0 - (nw - 1) / 2.0e0) AS INT) AS ox, CAST(floor((y0_incl + y1_incl) / 2.0e0 - (nh - 1) / 2.0e0) AS INT) AS oy FROM vr),
vc AS (SELECT *, greatest(0, least(img_w, ox)) AS cx0, greatest(0, least(img_h, oy)) AS cy0, greatest(0, least(img_w, ox + nw)) AS cx1, greatest(0, least(img_h, oy + nh)) AS cy1 FROM vn),
views AS (SELECT *, CASE WHEN cx0 <= nx0 AND cy0 <= ny0 AND nx1 < cx1 AND ny1 < cy1 THEN 'ready' ELSE 'rejected' END AS status FROM vc)
"""


def views_of(spark, sf_dir):
    return obj.verification_views(measured_of(spark, sf_dir))


@query("geo05_verification_views", duck(*BASE, VIEWS_SQL) + " SELECT image_id, source_index, support_radius, contour_width, sigma, cx0, cy0, cx1, cy1, status, CASE WHEN status = 'rejected' THEN 'crop_cannot_contain_support_and_contour' END AS view_reason FROM views")
def geo05(spark, sf_dir):
    return views_of(spark, sf_dir).select("image_id", "source_index", "support_radius", "contour_width", "sigma", "cx0", "cy0", "cx1", "cy1", "status", "view_reason")


@query("flt05_feasible_views", duck(*BASE, ORDERED_SQL, VIEWS_SQL) + " SELECT image_id, source_index, filtered_index FROM kept ANTI JOIN (SELECT image_id, source_index FROM views WHERE status = 'rejected') USING (image_id, source_index)")
def flt05(spark, sf_dir):
    kept = obj.assign_filtered_index(judged_of(spark, sf_dir).filter("reason IS NULL"))
    return obj.drop_infeasible_views(kept, views_of(spark, sf_dir)).select("image_id", "source_index", "filtered_index")


@query("geo06_shift_crop", duck(*BASE, VIEWS_SQL) + """,
sw AS (SELECT *, least(nw, img_w) AS w2, least(nh, img_h) AS h2 FROM vn),
sc AS (SELECT *, CAST(floor((x0_incl + x1_incl) / 2.0e0 - (w2 - 1) / 2.0e0) AS INT) AS ux, CAST(floor((y0_incl + y1_incl) / 2.0e0 - (h2 - 1) / 2.0e0) AS INT) AS uy,
  greatest(0, nx1 + 1 - w2) AS lx, least(nx0, img_w - w2) AS hx, greatest(0, ny1 + 1 - h2) AS ly, least(ny0, img_h - h2) AS hy FROM sw),
sp AS (SELECT *, lx <= hx AND ly <= hy AS fits, least(greatest(greatest(0, least(img_w, ux)), lx), hx) AS px, least(greatest(greatest(0, least(img_h, uy)), ly), hy) AS py FROM sc)
SELECT image_id, source_index, CASE WHEN fits THEN CAST(px AS INT) END AS crop_x, CASE WHEN fits THEN CAST(py AS INT) END AS crop_y, w2 AS crop_w, h2 AS crop_h, CASE WHEN fits THEN px <> ux OR py <> uy END AS crop_shifted FROM sp""")
def geo06(spark, sf_dir):
    return obj.shift_crop(measured_of(spark, sf_dir)).select("image_id", "source_index", "crop_x", "crop_y", "crop_w", "crop_h", "crop_shifted")


@query("scl15_model_dims", duck(*BASE) + """,
b AS (SELECT image_id, source_index, x1_incl - x0_incl + 1 AS w, y1_incl - y0_incl + 1 AS h FROM meas),
s AS (SELECT *, CASE WHEN least(w, h) < 256 THEN 256.0e0 / least(w, h) ELSE 1.0e0 END AS k FROM b),
t AS (SELECT *, CASE WHEN greatest(w, h) * k > 768 THEN 768.0e0 / greatest(w, h) ELSE k END AS z FROM s)
SELECT image_id, source_index, CAST(greatest(floor(w * z + 0.5e0), 1) AS INT) AS model_w, CAST(greatest(floor(h * z + 0.5e0), 1) AS INT) AS model_h FROM t""")
def scl15(spark, sf_dir):
    m = measured_of(spark, sf_dir).withColumns({"w": F.col("x1_incl") - F.col("x0_incl") + 1, "h": F.col("y1_incl") - F.col("y0_incl") + 1})
    return obj.model_dims(m, "w", "h").select("image_id", "source_index", "model_w", "model_h")


@query("win14_contact_pages", duck(*BASE) + """,
p AS (SELECT image_id, source_index, row_number() OVER (PARTITION BY image_id ORDER BY source_index) - 1 AS pos, greatest(count(*) OVER (PARTITION BY image_id) - 5, 0) AS truncated FROM meas)
SELECT image_id, source_index, CAST(pos // 3 + 1 AS INT) AS page, CAST((pos % 3) // 2 AS INT) AS tile_row, CAST((pos % 3) % 2 AS INT) AS tile_col, truncated FROM p WHERE pos < 5""")
def win14(spark, sf_dir):
    return obj.contact_pages(ops.measure_masks(mask_runs(candidates(spark, sf_dir))), 3, 2, 5)


@query("scl11_score_text", duck(F1_SQL) + " SELECT image_id, source_index, 'C' || lpad(CAST(source_index + 1 AS VARCHAR), 4, '0') || '  IoU ' || printf('%.3f', predicted_iou) || '  stability ' || printf('%.3f', stability_score) AS text FROM f1")
def scl11(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("image_id", "source_index", F.concat(F.lit("C"), F.lpad((F.col("source_index") + 1).cast("string"), 4, "0"), F.lit("  IoU "), obj.score_text("predicted_iou"), F.lit("  stability "), obj.score_text("stability_score")).alias("text"))


@query("jon06_intersections", duck(F1_SQL) + """,
sg AS (SELECT image_id, source_index AS seg, CAST(pk % img_w AS BIGINT) AS x1, CAST(sk % img_h AS BIGINT) AS y1, CAST((pk * 7 + q) % img_w AS BIGINT) AS x2, CAST((sk * 5 + q * 3) % img_h AS BIGINT) AS y2, img_w, img_h FROM (SELECT image_id, source_index, pk, sk, q, img_w, img_h FROM f1)),
ab AS (SELECT *, y1 - y2 AS a, x2 - x1 AS b, (y1 - y2) * x1 + (x2 - x1) * y1 AS c FROM sg),
pr AS (SELECT p.image_id, p.seg, o.seg AS other, p.img_w, p.img_h, CAST(p.c * o.b - o.c * p.b AS DOUBLE) / CAST(p.a * o.b - o.a * p.b AS DOUBLE) AS x, CAST(p.a * o.c - o.a * p.c AS DOUBLE) / CAST(p.a * o.b - o.a * p.b AS DOUBLE) AS y,
  p.x1 AS px1, p.x2 AS px2, p.y1 AS py1, p.y2 AS py2, o.x1 AS ox1, o.x2 AS ox2, o.y1 AS oy1, o.y2 AS oy2 FROM ab p JOIN ab o ON p.image_id = o.image_id AND p.seg < o.seg WHERE p.a * o.b - o.a * p.b <> 0)
SELECT image_id, seg, other, x, y FROM pr WHERE x BETWEEN least(px1, px2) - 1e-9 AND greatest(px1, px2) + 1e-9 AND y BETWEEN least(py1, py2) - 1e-9 AND greatest(py1, py2) + 1e-9
  AND x BETWEEN least(ox1, ox2) - 1e-9 AND greatest(ox1, ox2) + 1e-9 AND y BETWEEN least(oy1, oy2) - 1e-9 AND greatest(oy1, oy2) + 1e-9 AND x >= 0 AND x < img_w AND y >= 0 AND y < img_h""")
def jon06(spark, sf_dir):
    c = candidates(spark, sf_dir)
    s = c.select("image_id", F.col("source_index").alias("seg"), (F.col("pk") % F.col("img_w")).alias("sx1"), (F.col("sk") % F.col("img_h")).alias("sy1"), ((F.col("pk") * 7 + F.col("q")) % F.col("img_w")).alias("sx2"), ((F.col("sk") * 5 + F.col("q") * 3) % F.col("img_h")).alias("sy2"), "img_w", "img_h")
    return obj.segment_intersections(s, 16)


@query("src03_admit_images", duck(IMAGES_SQL) + """
SELECT image_id, CASE WHEN n_bytes = 0 THEN 'invalid_image' WHEN format NOT IN ('JPEG', 'PNG', 'WEBP') THEN 'unsupported_format' WHEN img_w < 1 OR img_h < 1 THEN 'invalid_image'
  WHEN img_w > 8192 OR img_h > 8192 THEN 'image_too_large' WHEN CAST(img_w AS BIGINT) * img_h > 400000 THEN 'too_many_pixels' END AS reason FROM images""")
def src03(spark, sf_dir):
    return obj.admit_images(images(spark, sf_dir), 400_000, 8192, 8192).select("image_id", "reason")


@query("prj01_clamp_roi", duck(IMAGES_SQL) + """
SELECT image_id, greatest(0, least(20, img_w)) AS roi_x, greatest(0, least(10, img_h)) AS roi_y,
  least(img_w, greatest(70, greatest(0, least(20, img_w)))) - greatest(0, least(20, img_w)) AS roi_w, least(img_h, greatest(40, greatest(0, least(10, img_h)))) - greatest(0, least(10, img_h)) AS roi_h FROM images""")
def prj01(spark, sf_dir):
    return obj.clamp_roi(images(spark, sf_dir), "20,10,50,30").select("image_id", "roi_x", "roi_y", "roi_w", "roi_h")


@query("prj02_plan_resize", duck(IMAGES_SQL) + " SELECT image_id, CAST(floor(img_w * 0.37e0) AS INT) AS res_w, CAST(floor(img_h * 0.37e0) AS INT) AS res_h, 'downscale' AS mode FROM images")
def prj02(spark, sf_dir):
    return obj.plan_resize(obj.clamp_roi(images(spark, sf_dir), None), 0.37).select("image_id", "res_w", "res_h", "mode")


@query("geo11_tile_grid", duck(IMAGES_SQL) + """,
t AS (SELECT image_id, img_w, img_h, i, unnest(range(0, 4)) AS j FROM (SELECT *, unnest(range(0, 3)) AS i FROM images)),
e AS (SELECT image_id, CAST(i * 4 + j AS INT) AS source_index, CAST(j * img_w // 4 AS INT) AS tx0, CAST(i * img_h // 3 AS INT) AS ty0, CAST((j + 1) * img_w // 4 AS INT) AS tx1, CAST((i + 1) * img_h // 3 AS INT) AS ty1 FROM t)
SELECT *, CAST(tx1 - tx0 AS BIGINT) * (ty1 - ty0) AS area FROM e""")
def geo11(spark, sf_dir):
    return obj.tile_grid(images(spark, sf_dir))


@query("scl14_diagnostic_dims", duck(IMAGES_SQL) + """
SELECT image_id, CASE WHEN img_w > 0 AND img_h > 0 THEN CAST(greatest(floor(img_w * least(1.0e0, sqrt(2000000.0e0 / (CAST(img_w AS DOUBLE) * img_h)))), 1) AS INT) ELSE 0 END AS diag_w,
  CASE WHEN img_w > 0 AND img_h > 0 THEN CAST(greatest(floor(img_h * least(1.0e0, sqrt(2000000.0e0 / (CAST(img_w AS DOUBLE) * img_h)))), 1) AS INT) ELSE 0 END AS diag_h FROM images""")
def scl14(spark, sf_dir):
    return obj.diagnostic_dims(images(spark, sf_dir)).select("image_id", "diag_w", "diag_h")
