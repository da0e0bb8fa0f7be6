"""Queries over frames, logs and final objects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts, masks, objects
from ..operators import reports as ops
from ..operators.settings import resolve_settings
from ..sources.shared import staged
from .artifacts import ADMIT_SQL, FIRST_SQL, HASHED_SQL, hashed_of, ledger_of
from .base import query
from .fixtures import BASE, F1_SQL, FRAMES_SQL, OFFERS_SQL, REQUESTS_SQL, candidates, duck, frames, measured_with_rle, requests, table
from .masks import DEPTH_SQL, ORDERED_SQL, RLE_SQL, judged_of, ordered
from .objects import OBJECTS, RECORDS_SQL, VIEWS_SQL, typed, typed_of
from .requests import RESOLVED_SQL
from .scoring import ROUTING, routes_of


@query("src04_frame_ids", duck(FRAMES_SQL) + " SELECT stream_id, frame_idx, printf('stream%d-%07d', stream_id, frame_idx) AS frame_id FROM frames")
def src04(spark, sf_dir):
    return ops.frame_ids(frames(spark, sf_dir)).select("stream_id", F.col("frame_idx").cast("long").alias("frame_idx"), "frame_id")


@query("snk05_sequence_names", duck(FRAMES_SQL) + """
SELECT stream_id, CAST(frame_idx AS INT) AS frame_idx, printf('%07d.jpg', n) AS name, printf('stream-%04d', n) AS stream_name FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS n FROM frames WHERE outcome <> 'timeout')""")
def snk05(spark, sf_dir):
    return ops.sequence_names(frames(spark, sf_dir), F.col("outcome") != "timeout").select("stream_id", "frame_idx", "name", "stream_name")


@query("agg09_latency_summary", duck(FRAMES_SQL) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ms) AS k, count(*) OVER (PARTITION BY stream_id) AS n FROM frames)
SELECT stream_id, arg_min(ms, frame_idx) AS first, min(ms) AS least, max(ms) AS greatest, max(ms) FILTER (k = n // 2 + 1) AS upper_median, round_even(median(ms), 6) AS median FROM r GROUP BY stream_id""")
def agg09(spark, sf_dir):
    return ops.latency_summary(frames(spark, sf_dir), "stream_id", ["frame_idx"], "ms").withColumn("median", F.bround("median", 6))


@query("agg10_nearest_rank", duck(FRAMES_SQL) + """,
r AS (SELECT stream_id, ms, row_number() OVER (PARTITION BY stream_id ORDER BY ms) AS k, count(*) OVER (PARTITION BY stream_id) AS n FROM frames)
SELECT stream_id, ms AS value FROM r WHERE k = greatest(1, CAST(floor(n * 0.95e0 + 0.999999e0) AS INT))""")
def agg10(spark, sf_dir):
    return ops.nearest_rank(frames(spark, sf_dir), "stream_id", "ms")


COUNTERS_SQL = """count(*) AS requests, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'service_busy') AS busy, count(*) FILTER (outcome = 'not_ready') AS not_ready, count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER (outcome = 'cancelled') AS cancelled, count(*) FILTER (outcome IN ('response_too_large', 'insufficient_memory', 'insufficient_shm')) AS "limit" """


@query("agg11_outcome_counters", duck(FRAMES_SQL) + f" SELECT stream_id, {COUNTERS_SQL} FROM frames GROUP BY stream_id")
def agg11(spark, sf_dir):
    return ops.outcome_counters(frames(spark, sf_dir), ["stream_id"])


@query("agg12_cumulative_histogram", duck(FRAMES_SQL) + """
SELECT outcome, count(*) FILTER (ms <= 1) AS le_1, count(*) FILTER (ms <= 2.5e0) AS le_2_5, count(*) FILTER (ms <= 10) AS le_10, count(*) FILTER (ms <= 50) AS le_50, count(ms) AS le_inf, CAST(sum(CAST(ms AS DECIMAL(20, 4))) AS DOUBLE) AS total FROM frames GROUP BY outcome""")
def agg12(spark, sf_dir):
    return ops.cumulative_histogram(frames(spark, sf_dir), ["outcome"], "ms", [1, 2.5, 10, 50])


@query("agg13_gauges", duck(FRAMES_SQL) + " SELECT stream_id, outcome, arg_max(ms, frame_idx) AS latest, max(ms) AS peak FROM frames GROUP BY ALL")
def agg13(spark, sf_dir):
    return ops.gauges(frames(spark, sf_dir), ["stream_id", "outcome"], ["frame_idx"], "ms")


@query("agg14_repeatability", duck(FRAMES_SQL) + " SELECT stream_id, props, count(*) AS runs, count(DISTINCT outcome) AS signatures, count(DISTINCT outcome) = 1 AS repeatable FROM frames GROUP BY ALL")
def agg14(spark, sf_dir):
    return ops.repeatability(frames(spark, sf_dir), ["stream_id", "props"], ["outcome"])


@query("win09_monotonic_growth", duck(FRAMES_SQL) + """,
l AS (SELECT *, frame_idx * 10 + CASE WHEN stream_id % 3 = 0 THEN floor(ms) ELSE 0 END AS v FROM frames), b AS (SELECT *, lag(v) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS p FROM l)
SELECT stream_id, bool_and(coalesce(v >= p, true)) AS never_falls, arg_max(v, frame_idx) > arg_min(v, frame_idx) AS grows FROM b GROUP BY stream_id""")
def win09(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("v", F.col("frame_idx") * 10 + F.when(F.col("stream_id") % 3 == 0, F.floor("ms")).otherwise(0))
    return ops.monotonic_growth(f, "stream_id", ["frame_idx"], "v")


@query("agg19_frame_size_conflicts", duck(FRAMES_SQL) + " SELECT stream_id, count(DISTINCT 48 + CASE WHEN stream_id % 4 = 0 THEN event_id % 3 ELSE 0 END) AS sizes FROM frames GROUP BY stream_id HAVING sizes > 1")
def agg19(spark, sf_dir):
    f = frames(spark, sf_dir).withColumns({"img_w": 48 + F.when(F.col("stream_id") % 4 == 0, F.col("event_id") % 3).otherwise(0), "img_h": F.lit(32)})
    return ops.frame_size_conflicts(f)


_STATUS_SQL = """
st AS (SELECT stream_id AS request_id, outcome AS stage, CASE WHEN min(ms) < 0.2e0 THEN 'skipped' ELSE 'executed' END AS status FROM frames GROUP BY ALL),
ex AS (SELECT request_id, unnest(['timeout', 'service_busy', 'not_ready', 'response_too_large', 'success', 'final']) AS stage FROM (SELECT DISTINCT stream_id AS request_id FROM frames))
"""


@query("jon12_unexpected_status", duck(FRAMES_SQL, _STATUS_SQL) + """
SELECT coalesce(st.request_id, ex.request_id) AS request_id, coalesce(st.stage, ex.stage) AS stage, status, CASE WHEN ex.stage IS NOT NULL THEN 'executed' END AS expected
FROM st FULL JOIN ex ON st.request_id = ex.request_id AND st.stage = ex.stage WHERE status IS DISTINCT FROM CASE WHEN ex.stage IS NOT NULL THEN 'executed' END""")
def jon12(spark, sf_dir):
    f = frames(spark, sf_dir)
    statuses = f.groupBy(F.col("stream_id").alias("request_id"), F.col("outcome").alias("stage")).agg(F.when(F.min("ms") < 0.2, "skipped").otherwise("executed").alias("status"))
    stages = F.array(*[F.lit(s) for s in ("timeout", "service_busy", "not_ready", "response_too_large", "success", "final")])
    expected = f.select(F.col("stream_id").alias("request_id")).distinct().select("request_id", F.explode(stages).alias("stage"), F.lit("executed").alias("status"))
    return ops.unexpected_stage_status(statuses, expected)


STAGE_ORDER = ["not_ready", "timeout", "service_busy", "response_too_large", "success", "insufficient_memory", "cancelled"]


@query("jon12_stage_order", duck(FRAMES_SQL) + """,
fs AS (SELECT stream_id AS request_id, outcome AS stage, min(frame_idx) AS seq, CASE WHEN min(ms) < 0.05e0 THEN 'lost' WHEN min(ms) < 0.2e0 THEN 'skipped' ELSE 'executed' END AS status FROM frames GROUP BY ALL),
ps AS (SELECT request_id, list(stage ORDER BY seq) AS s, count(*) FILTER (status = 'lost') AS bad FROM fs GROUP BY request_id),
pb AS (SELECT request_id, array_to_string(s, ',') AS stages, CASE WHEN bad > 0 THEN 'unknown_status' WHEN NOT list_has_all(s, ['not_ready', 'timeout', 'service_busy', 'response_too_large', 'success', 'insufficient_memory', 'cancelled']) THEN 'missing_stage'
  WHEN s <> ['not_ready', 'timeout', 'service_busy', 'response_too_large', 'success', 'insufficient_memory', 'cancelled'] THEN 'wrong_order' END AS problem FROM ps)
SELECT * FROM pb WHERE problem IS NOT NULL""")
def jon12_order(spark, sf_dir):
    f = frames(spark, sf_dir)
    status = F.when(F.min("ms") < 0.05, "lost").when(F.min("ms") < 0.2, "skipped").otherwise("executed").alias("status")
    statuses = f.groupBy(F.col("stream_id").alias("request_id"), F.col("outcome").alias("stage")).agg(F.min("frame_idx").alias("seq"), status)
    return ops.stage_order_problems(statuses, STAGE_ORDER)


#: The box of a mask, as it is measured.
BOX = ("x0_incl", "y0_incl", "x1_incl", "y1_incl")

_ACCOUNT_SQL = """
im AS (SELECT image_id, sum(area) AS area, count(*) AS evaluated, count(*) FILTER (area > 0) AS non_empty, count(*) FILTER (area = 0) AS empty, count(*) FILTER (reason IS NULL) AS retained, count(reason) AS rejected, any_value(CAST(img_w AS BIGINT) * img_h) AS size FROM reasoned GROUP BY image_id),
dp AS (SELECT image_id, sum((r1 - r0) * depth) AS px, sum(r1 - r0) AS covered FROM depths GROUP BY image_id),
ia AS (SELECT im.*, coalesce(px, 0) AS px, coalesce(covered, 0) AS covered FROM im LEFT JOIN dp USING (image_id)),
rq AS (SELECT request_id, count(*) AS eligible, count(*) FILTER (status <> 'page_excluded') AS selected, count(*) FILTER (status = 'delivered') AS delivered, count(*) FILTER (starts_with(status, 'omitted')) AS omitted, count(*) FILTER (status = 'page_excluded') AS excluded FROM ledger GROUP BY request_id)
"""


@query("agg18_accounting", duck(*BASE, ORDERED_SQL, DEPTH_SQL, VIEWS_SQL, OFFERS_SQL, FIRST_SQL, ADMIT_SQL, *ROUTING, _ACCOUNT_SQL).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT unnest(['rejected_is_sum_of_removed', 'evaluated', 'raw_is_visible_and_empty', 'pixels', 'covered_and_uncovered', 'histogram']) AS "check", count(*) AS checked,
  unnest([count(*) FILTER (evaluated - retained <> rejected), count(*) FILTER (evaluated <> retained + rejected), count(*) FILTER (evaluated <> non_empty + empty), count(*) FILTER (area <> px), count(*) FILTER (covered > size), count(*) FILTER (covered > size)]) AS broken FROM ia
UNION ALL SELECT unnest(['eligible', 'selected', 'truncated']), count(*), unnest([count(*) FILTER (eligible <> delivered + omitted + excluded), count(*) FILTER (selected <> delivered + omitted), 0]) FROM rq
UNION ALL SELECT unnest(['scores_in_range', 'delta_not_negative']), count(*), unnest([count(*) FILTER (NOT (top BETWEEN -1 AND 1 AND coalesce(target_score, 0) BETWEEN -1 AND 1)), count(*) FILTER (top < target_score)]) FROM capped
UNION ALL SELECT 'view_status_and_reason', count(*), 0 FROM views""")
def agg18(spark, sf_dir):
    """How often each accounting identity was looked at and broken, over images, requests, candidates and views."""
    # Masks are measured once, and images swept there: images, diagnostics, depths and views read the same stored rows.
    rows = judged_of(spark, sf_dir, "img_w", "img_h", work=masks.measured_with_depths, more=", depths array<struct<depth:bigint,px:bigint>>")
    judged, yes = staged(rows.select("image_id", "source_index", "img_w", "img_h", "area", "reason", "depths", *BOX), "judged"), F.lit(True)
    depth = judged.select("image_id", F.inline("depths"))
    sizes = (F.first("img_w").alias("img_w"), F.first("img_h").alias("img_h"), F.sum("area").alias("area"), F.count_if(F.col("area") == 0).alias("empty"))
    each = objects.filter_diagnostics(judged, more=sizes)
    images = judged.groupBy("image_id").agg(*sizes[:2])
    histogram = masks.overlap_histogram(depth, images).groupBy("image_id").agg(F.sum("px").alias("histogram"), F.max("covered").alias("covered"), F.max("uncovered").alias("uncovered"), F.max("overflow").alias("overflow"))
    deep = depth.groupBy("image_id").agg(F.sum(F.col("px") * F.col("depth")).alias("px"))
    each = each.join(histogram.hint("merge"), "image_id").join(deep.hint("merge"), "image_id", "left").na.fill(0, ["px"])
    removed, size = sum((F.col(f"removed_by_{r}") for r in objects.GEOMETRY_REASONS), F.lit(0)), F.col("img_w").cast("long") * F.col("img_h")
    parts = [ops.accounting_summary(each, ["image_id"], {
        "rejected_is_sum_of_removed": (F.col("rejected"), removed), "evaluated": (F.col("evaluated"), F.col("retained") + removed), "raw_is_visible_and_empty": (F.col("evaluated"), F.col("non_empty") + F.col("empty")),
        "pixels": (F.col("area"), F.col("px")), "covered_and_uncovered": (F.col("covered") + F.col("uncovered"), size), "histogram": (F.col("histogram") + F.col("overflow"), size),
    })]
    ledger = ledger_of(spark, sf_dir)
    requests = artifacts.ledger_summary(ledger, F.count_if(F.col("status").endswith("excluded")).alias("excluded"), F.max(F.col("status").startswith("omitted").cast("int")).alias("any_omitted"))
    parts.append(ops.accounting_summary(requests, ["request_id"], {
        "eligible": (F.col("eligible"), F.col("delivered") + F.col("omitted") + F.col("excluded")), "selected": (F.col("selected"), F.col("delivered") + F.col("omitted")), "truncated": ((F.col("omitted") > 0).cast("int"), F.col("any_omitted")),
    }))
    routes = routes_of(spark, sf_dir)
    scores = F.transform("scores", lambda x: x["score"])
    finite = F.forall(scores, lambda x: x.between(-1.0, 1.0)) & F.coalesce(F.col("target_score").between(-1.0, 1.0), yes)
    parts.append(ops.accounting_summary(routes, ["image_id"], {"scores_in_range": (finite, yes), "delta_not_negative": (F.coalesce(F.col("delta") >= 0, yes), yes)}))
    views = objects.verification_views(judged.filter("area > 0"))
    parts.append(ops.accounting_summary(views, ["image_id"], {"view_status_and_reason": (F.col("status") == "rejected", F.col("view_reason").isNotNull())}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("agg15_content_digest", duck(*OBJECTS) + """,
l AS (SELECT image_id, concat_ws('|', CAST(instance_id AS VARCHAR), CAST(source_index AS VARCHAR), coalesce(label, ''), CAST(area AS VARCHAR)) AS line FROM typed)
SELECT image_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY image_id""")
def agg15(spark, sf_dir):
    return ops.content_digest(typed_of(spark, sf_dir), ["image_id"], ["instance_id", "source_index", "label", "area"])


_RECORD_SQL = """
rec AS (SELECT image_id, '[' || string_agg('{{"instance_id":' || instance_id || ',"source_index":' || source_index || ',"label":"' || label || '","class_id":' || class_id || ',"area":' || area || ',"x0":' || x0_incl || ',"y0":' || y0_incl || ',"x1":' || x1_incl || ',"y1":' || y1_incl || '}}', ',' ORDER BY instance_id) || ']' AS records,
  count(*) AS n, string_agg(label, ',' ORDER BY instance_id) AS labels FROM typed GROUP BY image_id)
"""


def images_of(spark, sf_dir):
    return candidates(spark, sf_dir).select("image_id").distinct()


def stored_of(spark, sf_dir, rle: bool = False):
    """The judged masks, measured and stored once for documents, which look at them several times. rle: the objects have their run lengths, as `counts`."""
    how = {"work": measured_with_rle, "more": ", counts array<bigint>"} if rle else {}
    judged = judged_of(spark, sf_dir, "img_w", "img_h", "label", **how)
    counts = [F.when(F.col("reason").isNull(), F.col("counts")).alias("counts")] if rle else []
    return staged(judged.select("image_id", "source_index", "img_w", "img_h", "label", "area", "centroid_row", "centroid_col", "reason", *BOX, *counts), "judged")


@query("snk01_records", duck(*OBJECTS, _RECORD_SQL) + " SELECT i.image_id, coalesce(records, '[]') AS records FROM (SELECT DISTINCT image_id FROM f1) i LEFT JOIN rec USING (image_id)")
def snk01(spark, sf_dir):
    return ops.records(typed_of(spark, sf_dir), images_of(spark, sf_dir))


@query("snk07_documents_level0", duck(*OBJECTS, _RECORD_SQL) + " SELECT i.image_id, coalesce(n, 0) AS objects, coalesce(labels, '') AS labels FROM (SELECT DISTINCT image_id FROM f1) i LEFT JOIN rec USING (image_id)")
def snk07_0(spark, sf_dir):
    judged = stored_of(spark, sf_dir)
    return ops.result_documents(typed(ordered(judged)), judged.select("image_id").distinct(), 0)


@query("snk07_documents_level2", duck(*OBJECTS, _RECORD_SQL) + " SELECT i.image_id, coalesce(n, 0) AS objects, coalesce(labels, '') AS labels, coalesce(records, '[]') AS records FROM (SELECT DISTINCT image_id FROM f1) i LEFT JOIN rec USING (image_id)")
def snk07_2(spark, sf_dir):
    judged = stored_of(spark, sf_dir)
    return ops.result_documents(typed(ordered(judged)), judged.select("image_id").distinct(), 2)


_DOC_ARTIFACTS_SQL = "dart AS (SELECT request_id AS image_id, string_agg(name || ':' || raw_bytes || ':' || sha256, ',' ORDER BY name || ':' || raw_bytes || ':' || sha256) AS artifacts FROM hashed GROUP BY request_id)"
_COUNTS_SQL = "cnt AS (SELECT image_id, count(*) AS raw, count(*) FILTER (area > 0) AS non_empty, count(*) FILTER (reason IS NULL) AS after_geometry FROM reasoned GROUP BY image_id)"
_ALL_IMAGES_SQL = "(SELECT DISTINCT image_id FROM f1) i"


def counts_of(judged):
    return ops.stage_funnel({"raw": F.lit(True), "non_empty": F.col("area") > 0, "after_geometry": F.col("reason").isNull()}, judged)


@query("snk07_documents_level1", duck(*OBJECTS, _RECORD_SQL, OFFERS_SQL, FIRST_SQL, HASHED_SQL, _DOC_ARTIFACTS_SQL) + f" SELECT i.image_id, coalesce(n, 0) AS objects, coalesce(labels, '') AS labels, coalesce(artifacts, '') AS artifacts FROM {_ALL_IMAGES_SQL} LEFT JOIN rec USING (image_id) LEFT JOIN dart USING (image_id)")
def snk07_1(spark, sf_dir):
    judged = stored_of(spark, sf_dir)
    return ops.result_documents(typed(ordered(judged)), judged.select("image_id").distinct(), 1, hashed_of(spark, sf_dir))


@query("snk07_documents_level3", duck(*OBJECTS, _RECORD_SQL, OFFERS_SQL, FIRST_SQL, HASHED_SQL, _DOC_ARTIFACTS_SQL, RLE_SQL, _COUNTS_SQL, """
dr AS (SELECT image_id, string_agg(instance_id || '=' || array_to_string(counts, ' '), ',' ORDER BY instance_id) AS mask_rle FROM typed JOIN rle USING (image_id, source_index) GROUP BY image_id)""", """
dw AS (SELECT image_id, string_agg('object ' || instance_id || ': ' || warning, ',' ORDER BY instance_id) AS warnings FROM typed WHERE warning IS NOT NULL GROUP BY image_id)""") + f"""
SELECT i.image_id, coalesce(n, 0) AS objects, coalesce(labels, '') AS labels, coalesce(warnings, '') AS warnings, coalesce(artifacts, '') AS artifacts, coalesce(records, '[]') AS records, coalesce(mask_rle, '') AS mask_rle,
  'after_geometry=' || after_geometry || ',non_empty=' || non_empty || ',raw=' || raw AS candidate_counts FROM {_ALL_IMAGES_SQL} LEFT JOIN rec USING (image_id) LEFT JOIN dart USING (image_id) LEFT JOIN dr USING (image_id) LEFT JOIN dw USING (image_id) LEFT JOIN cnt USING (image_id)""")
def snk07_3(spark, sf_dir):
    judged = stored_of(spark, sf_dir, rle=True)
    return ops.result_documents(typed(ordered(judged)), judged.select("image_id").distinct(), 3, hashed_of(spark, sf_dir), counts=counts_of(judged))


@query("snk08_public_projection", duck(*OBJECTS, RECORDS_SQL, _COUNTS_SQL) + """,
ob AS (SELECT image_id, string_agg(record, ',' ORDER BY instance_id) AS o, coalesce(array_to_string((list('"' || warning || '"' ORDER BY instance_id) FILTER (warning IS NOT NULL))[1:2], ','), '') AS w FROM recs GROUP BY image_id)
SELECT i.image_id, '{"candidate_counts":{"after_geometry":' || after_geometry || ',"non_empty":' || non_empty || ',"raw":' || raw || '},"image":{"height":' || img_h || ',"width":' || img_w || '},"objects":[' || coalesce(o, '') || '],"warnings":[' || coalesce(w, '') || ']}' AS document
FROM (SELECT DISTINCT image_id, img_w, img_h FROM f1) i LEFT JOIN ob USING (image_id) LEFT JOIN cnt USING (image_id)""")
def snk08(spark, sf_dir):
    images = candidates(spark, sf_dir).select("image_id", "img_w", "img_h").distinct()
    return ops.public_projection(typed_of(spark, sf_dir), images, counts_of(judged_of(spark, sf_dir)), 2)


@query("snk03_label_manifest", duck(*OBJECTS) + " SELECT class_id, label, count(*) AS objects, count(DISTINCT image_id) AS images FROM typed GROUP BY ALL")
def snk03(spark, sf_dir):
    return ops.label_manifest(typed_of(spark, sf_dir))


@query("snk03_dataset_manifest", duck(F1_SQL) + " SELECT 'images/train' AS train, 'images/val' AS val, count(*) AS nc, string_agg(label, ',' ORDER BY label DESC) AS names FROM (SELECT DISTINCT label FROM f1)")
def snk03_dataset(spark, sf_dir):
    """The labels in use, last one first."""
    used = candidates(spark, sf_dir).select("label").distinct()
    rows = used.withColumn("position", F.row_number().over(Window.orderBy(F.desc("label"))))
    return ops.dataset_row(rows).withColumn("names", F.array_join("names", ","))


_TOLD_SQL = """
st AS (SELECT request_id AS image_id, string_agg(field || '=' || CAST(value AS BIGINT) || ':' || source, ',' ORDER BY field || '=' || CAST(value AS BIGINT) || ':' || source) AS settings FROM (
  SELECT e.request_id, unnest(['points_per_side', 'crop_n_layers']) AS field, unnest([e.points_per_side, e.crop_n_layers]) AS value,
    unnest([CASE WHEN r.points_per_side IS NOT NULL THEN 'explicit' WHEN profile IS NOT NULL THEN 'profile' ELSE 'default' END, CASE WHEN r.crop_n_layers IS NOT NULL THEN 'explicit' WHEN profile IS NOT NULL THEN 'profile' ELSE 'default' END]) AS source
  FROM eff e JOIN requests r USING (request_id)) GROUP BY request_id),
ev AS (SELECT event_id AS image_id, 'stage_statuses' AS k, 'label=' || event_type AS stage_statuses, 'label=' || CAST(floor(value) AS BIGINT) || ',segment=' || CAST(floor(value) AS BIGINT) * 3 AS timings_ms FROM events),
dg AS (SELECT image_id, 'rejected=' || count(reason) || ',retained=' || count(*) FILTER (reason IS NULL) AS post_filter_diagnostics FROM reasoned GROUP BY image_id)
"""


@query("snk07_documents_with_settings_and_audit", duck(*OBJECTS, _RECORD_SQL, REQUESTS_SQL, RESOLVED_SQL, _TOLD_SQL, """
dw AS (SELECT image_id, string_agg('object ' || instance_id || ': ' || warning, ',' ORDER BY instance_id) AS warnings FROM typed WHERE warning IS NOT NULL GROUP BY image_id)""") + f"""
SELECT i.image_id, coalesce(n, 0) AS objects, coalesce(labels, '') AS labels, coalesce(warnings, '') AS warnings, coalesce(records, '[]') AS records, coalesce(settings, '') AS settings, coalesce(stage_statuses, '') AS stage_statuses, coalesce(post_filter_diagnostics, '') AS post_filter_diagnostics, coalesce(timings_ms, '') AS timings_ms
FROM {_ALL_IMAGES_SQL} LEFT JOIN rec USING (image_id) LEFT JOIN dw USING (image_id) LEFT JOIN st USING (image_id) LEFT JOIN ev USING (image_id) LEFT JOIN dg USING (image_id)""")
def snk07_audit(spark, sf_dir):
    """The full tier: an image has the settings of the request and the log line of its own number, where there are such."""
    resolved = resolve_settings(requests(spark, sf_dir)).filter("field IN ('points_per_side', 'crop_n_layers')")
    settings = resolved.select(F.col("request_id").alias("image_id"), "field", F.col("value").cast("long").cast("string").alias("value"), "source")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), "event_type", F.floor("value").cast("long").alias("ms"))
    statuses = log.select("image_id", F.lit("label").alias("stage"), F.col("event_type").alias("status"))
    timings = log.select("image_id", F.inline(F.array(F.struct(F.lit("label").alias("stage"), F.col("ms").alias("ms")), F.struct(F.lit("segment").alias("stage"), (F.col("ms") * 3).alias("ms")))))
    judged = stored_of(spark, sf_dir)
    d = objects.filter_diagnostics(judged)
    diagnostics = d.select("image_id", F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("retained", "rejected")])))
    return ops.result_documents(typed(ordered(judged)), judged.select("image_id").distinct(), 3, settings=settings, statuses=statuses, diagnostics=diagnostics, timings=timings)


@query("snk04_split", duck(F1_SQL) + " SELECT image_id, CASE WHEN (image_id * 7919 + 17) % 10000 < 8000 THEN 'train' ELSE 'val' END AS split FROM (SELECT DISTINCT image_id FROM f1)")
def snk04(spark, sf_dir):
    return ops.split_train_val(images_of(spark, sf_dir), 80, 17)


@query("top03_stable_order", "SELECT page_id, url FROM pages")
def top03(spark, sf_dir):
    return ops.stable_order(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"])


@query("top04_shuffled", "SELECT o_orderkey, md5(o_orderkey || '/7') AS shuffle_key FROM orders")
def top04(spark, sf_dir):
    return ops.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("set01_findings_diff", """
WITH c AS (SELECT user_id, event_type, left(md5(props), 1) AS hash FROM events WHERE value < 20), b AS (SELECT user_id, event_type, left(md5(props), 1) AS hash FROM events WHERE value > 5)
SELECT *, 'added' AS change, true AS fails FROM (SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed', false FROM (SELECT * FROM b EXCEPT SELECT * FROM c)""")
def set01(spark, sf_dir):
    """Short hashes, so that findings repeat on both sides."""
    e = table(spark, sf_dir, "events").withColumn("hash", F.left(F.md5("props"), F.lit(1)))
    pick = lambda p: e.filter(p).select("user_id", "event_type", "hash")
    return ops.findings_diff(pick("value < 20"), pick("value > 5"), strict=False)
