"""Queries over run requests and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import settings as ops
from .base import query
from .fixtures import REQUESTS_SQL, dealt, duck, requests, table

#: Settings in order: default, then what the profiles fast, balanced and quality set.
_TABLE = {
    "points_per_side": (8, 8, 16, 32), "points_per_batch": (8, 8, 16, 32), "pred_iou_thresh": (0.5, 0.5, 0.7, 0.75), "stability_score_thresh": (0.5, 0.5, 0.8, 0.85), "stability_score_offset": (1.0, None, None, None),
    "mask_threshold": (0.0, None, None, None), "box_nms_thresh": (0.7, None, None, None), "crop_n_layers": (0, 0, 0, 1), "crop_nms_thresh": (0.7, None, None, None), "crop_overlap_ratio": (512 / 1500, None, None, None),
    "crop_n_points_downscale_factor": (1, None, None, 2), "min_mask_region_area": (0, None, None, 50), "use_m2m": (0, None, None, None), "multimask_output": (1, None, None, 1),
}
_RANGES = {
    "points_per_side": (1, 1024), "points_per_batch": (1, 1024), "pred_iou_thresh": (0, 1), "stability_score_thresh": (0, 1), "stability_score_offset": (0, 10), "mask_threshold": (-32, 32), "box_nms_thresh": (0, 1),
    "crop_n_layers": (0, 8), "crop_nms_thresh": (0, 1), "crop_overlap_ratio": (0, 1), "crop_n_points_downscale_factor": (1, 32), "min_mask_region_area": (0, 64000000),
}


def _kind(f):
    return "INT" if isinstance(_TABLE[f][0], int) else "DOUBLE"


def _profile_sql(f):
    cases = "".join(f" WHEN '{p}' THEN CAST({v!r} AS DOUBLE)" for p, v in zip(("fast", "balanced", "quality"), _TABLE[f][1:], strict=True) if v is not None)
    return f"CASE profile{cases} END" if cases else "NULL"


RESOLVED_SQL = "eff AS (SELECT request_id, " + ", ".join(f"CAST(coalesce(CAST({f} AS DOUBLE), {_profile_sql(f)}, CAST({_TABLE[f][0]!r} AS DOUBLE)) AS {_kind(f)}) AS {f}" for f in _TABLE) + " FROM requests)"


def _work_sql(source: str, out: str) -> str:
    return f"""
{out}_e AS (SELECT *, CAST(list_sum(list_transform(range(0, crop_n_layers + 1), lambda l: CAST(pow(4, l) * pow(floor(points_per_side / pow(crop_n_points_downscale_factor, l)), 2) AS BIGINT))) AS BIGINT) AS prompts,
  floor(points_per_side / pow(crop_n_points_downscale_factor, crop_n_layers)) >= 1 AS deepest_ok FROM {source}),
{out} AS (SELECT *, prompts * CASE WHEN multimask_output = 1 THEN 3 ELSE 1 END AS predictions FROM {out}_e),
{out}_r AS (SELECT *, CASE WHEN NOT deepest_ok THEN 'crop_n_points_downscale_factor' WHEN points_per_side > 64 THEN 'points_per_side' WHEN points_per_batch > 64 THEN 'points_per_batch' WHEN crop_n_layers > 2 THEN 'crop_n_layers'
  WHEN min_mask_region_area > 1000000 THEN 'min_mask_region_area' WHEN prompts > 8192 THEN 'estimated_prompt_count' WHEN predictions > 24576 THEN 'estimated_mask_prediction_count' END AS reason FROM {out}),
{out}_a AS (SELECT *, CASE WHEN reason IS NOT NULL THEN '' ELSE concat_ws('; ', CASE WHEN prompts >= 6553.6e0 THEN 'estimated_prompt_count is at least 80% of its operator cap' END, CASE WHEN predictions >= 19660.8e0 THEN 'estimated_mask_prediction_count is at least 80% of its operator cap' END) END AS warnings FROM {out}_r)
"""


_SOURCES_SQL = ", ".join(f"CASE WHEN r.{f} IS NOT NULL THEN 'explicit' WHEN {_profile_sql(f)} IS NOT NULL THEN 'profile' ELSE 'default' END" for f in _TABLE)
_NAMES_SQL = ", ".join(f"'{f}'" for f in _TABLE)


@query("prj04_resolved_settings", duck(REQUESTS_SQL, RESOLVED_SQL) + f"""
SELECT request_id, unnest([{_NAMES_SQL}]) AS field, unnest([{", ".join(f"CAST(e.{f} AS DOUBLE)" for f in _TABLE)}]) AS value, unnest([{_SOURCES_SQL}]) AS source FROM eff e JOIN requests r USING (request_id)""")
def prj04(spark, sf_dir):
    return ops.resolve_settings(requests(spark, sf_dir))


def work_of(spark, sf_dir):
    return ops.estimate_work(ops.effective(requests(spark, sf_dir)))


@query("prj05_estimated_work", duck(REQUESTS_SQL, RESOLVED_SQL, _work_sql("eff", "w")) + " SELECT request_id, prompts, predictions, deepest_ok FROM w")
def prj05(spark, sf_dir):
    return work_of(spark, sf_dir).select("request_id", "prompts", "predictions", "deepest_ok")


@query("prj06_admitted_work", duck(REQUESTS_SQL, RESOLVED_SQL, _work_sql("eff", "w")) + " SELECT request_id, reason, warnings FROM w_a")
def prj06(spark, sf_dir):
    return ops.admit_work(work_of(spark, sf_dir)).select("request_id", "reason", "warnings")


_CAPPED = {"points_per_side": 64, "points_per_batch": 64, "crop_n_layers": 2, "min_mask_region_area": 1000000}
_FAST_SQL = ", ".join(f"CAST({_TABLE[f][0] if _TABLE[f][1] is None else _TABLE[f][1]!r} AS {_kind(f)}) AS {f}" for f in _TABLE)
_CLAMPED = {f: f"least({f}, {_CAPPED[f]})" if f in _CAPPED else "0" if f == "multimask_output" else f for f in _TABLE}
_LEAST = _CLAMPED | {"points_per_side": "1", "points_per_batch": "1", "crop_n_layers": "0", "crop_n_points_downscale_factor": "1", "min_mask_region_area": "0"}
_AS_SQL = lambda values: ", ".join(f"CAST({v} AS {_kind(f)}) AS {f}" for f, v in values.items())
_VALID_SQL = " AND ".join(f"{f} BETWEEN {a} AND {b}" for f, (a, b) in _RANGES.items())


@query("prj07_alternatives", duck(REQUESTS_SQL, RESOLVED_SQL) + f""",
alt AS (SELECT * FROM (SELECT request_id, 0 AS pos, {_FAST_SQL} FROM eff UNION ALL SELECT request_id, 1, {_AS_SQL(_CLAMPED)} FROM eff UNION ALL SELECT request_id, 2, {_AS_SQL(_LEAST)} FROM eff) WHERE {_VALID_SQL}),""" + _work_sql("alt", "w") + f""",
d AS (SELECT * FROM w_a WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY request_id, {", ".join(_TABLE)} ORDER BY pos) = 1)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos) AS INT) AS place, {", ".join(_TABLE)}, prompts, predictions FROM d""")
def prj07(spark, sf_dir):
    return ops.admissible_alternatives(work_of(spark, sf_dir))


_RANGE_ROWS_SQL = " UNION ALL ".join(f"SELECT request_id, {k} AS o, '{f}' AS field, CAST({f} AS DOUBLE) AS value, {a}.0e0 AS low, {b}.0e0 AS high FROM requests" for k, (f, (a, b)) in enumerate({**_RANGES, "points_per_side": (4, 70), "stability_score_offset": (0, 4)}.items()))


@query("flt08_range_violations", duck(REQUESTS_SQL) + f""", v AS ({_RANGE_ROWS_SQL})
SELECT request_id, field, value, low, high FROM v WHERE value < low OR value > high QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY o) = 1""")
def flt08(spark, sf_dir):
    return ops.range_violations(requests(spark, sf_dir), {**ops.BOUNDS, "points_per_side": (4, 70), "stability_score_offset": (0, 4)})


_TEXT_SETTINGS_SQL = """
ts AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 13 = 0 THEN 'x' || p_size ELSE CAST(p_size * 2 AS VARCHAR(20)) END AS points_per_side, CASE WHEN p_partkey % 7 = 0 THEN 'high' ELSE p_size || 'e-1' END AS quality,
  CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'perhaps' END END AS multimask, CAST(p_size AS VARCHAR(20)) AS min_area, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 60 AS VARCHAR(20)) END AS max_area, CASE WHEN p_partkey % 9 = 0 THEN '40' END AS maxsize FROM {part})
"""
#: Kind and range of each field of the fixture.
TEXT_FIELDS = {"points_per_side": ("int", 1, 90), "quality": ("number", 0, 4), "multimask": ("bool", 0, 1), "min_area": ("int", 0, 1000), "max_area": ("int", 0, 50)}


def text_settings(spark, sf_dir):
    rows = spark.sql("WITH " + _TEXT_SETTINGS_SQL + " SELECT * FROM ts", part=table(spark, sf_dir, "part"))
    names = [*TEXT_FIELDS, "maxsize"]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    return rows.select("request_id", F.map_from_entries(entries).alias("settings"))


@query("flt08_setting_violations", duck(_TEXT_SETTINGS_SQL) + """,
m AS (SELECT *, coalesce(max_area, maxsize) AS most FROM ts),
v AS (SELECT request_id, CASE WHEN NOT regexp_full_match(points_per_side, '[+-]?[0-9]+') THEN 'points_per_side:type' WHEN TRY_CAST(points_per_side AS DOUBLE) < 1 OR TRY_CAST(points_per_side AS DOUBLE) > 90 THEN 'points_per_side:range'
  WHEN TRY_CAST(quality AS DOUBLE) IS NULL THEN 'quality:type' WHEN TRY_CAST(quality AS DOUBLE) > 4 THEN 'quality:range' WHEN multimask IS NOT NULL AND lower(multimask) NOT IN ('true', 'false') THEN 'multimask:type'
  WHEN max_area IS NOT NULL AND maxsize IS NOT NULL THEN 'max_area:conflict' WHEN TRY_CAST(most AS DOUBLE) > 50 THEN 'max_area:range' WHEN TRY_CAST(min_area AS DOUBLE) > TRY_CAST(most AS DOUBLE) THEN 'min_area:order' END AS v FROM m)
SELECT request_id, string_split(v, ':')[1] AS field, string_split(v, ':')[2] AS problem FROM v WHERE v IS NOT NULL""")
def flt08_settings(spark, sf_dir):
    return ops.setting_violations(text_settings(spark, sf_dir), TEXT_FIELDS, (("min_area", "max_area"),), {"maxsize": "max_area"})


_KEYS = "'alpha', 'images', 'video', 'mask_generator', 'palette', 'visualization', 'clip', 'clip_routing', 'preprocessing', 'Alpha', 'postsam2processing', 'blip3', 'candidate_views', 'diagnostic_artifacts', 'export_yolo_det', 'debug'"
_SETTINGS_SQL = f"sets AS (SELECT p_partkey AS request_id, list_filter([{_KEYS}], lambda x, i: (p_partkey // i) % 2 = 0) AS keys FROM {{part}})"


def settings_of(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = F.expr(f"filter(array({_KEYS}), (x, i) -> (p_partkey div (i + 1)) % 2 = 0)")
    return p.select(F.col("p_partkey").alias("request_id"), F.map_from_arrays(names, F.transform(names, lambda x: F.length(x).cast("double"))).alias("settings"))


@query("prj08_key_classes", duck(_SETTINGS_SQL) + """
SELECT request_id, array_to_string(list_sort(list_filter(keys, lambda x: x IN ('alpha', 'preprocessing', 'mask_generator', 'postsam2processing', 'clip', 'clip_routing', 'blip3', 'candidate_views', 'diagnostic_artifacts', 'visualization'))), ',') AS algorithm, array_to_string(list_sort(list_filter(keys, lambda x: x IN ('images', 'video', 'export_yolo_det'))), ',') AS batch_only,
  array_to_string(list_sort(list_filter(keys, lambda x: x IN ('palette', 'Alpha', 'debug'))), ',') AS unrecognized FROM sets""")
def prj08(spark, sf_dir):
    return ops.classify_keys(settings_of(spark, sf_dir))


@query("set03_unknown_keys", duck(_SETTINGS_SQL) + " SELECT request_id, array_to_string(list_sort(list_filter(keys, lambda x: x NOT IN ('alpha', 'images', 'video'))), ',') AS unknown FROM sets")
def set03(spark, sf_dir):
    return ops.unknown_keys(settings_of(spark, sf_dir), ("alpha", "images", "video")).withColumn("unknown", F.array_join("unknown", ","))


_RULES_SQL = """
tg AS (SELECT DISTINCT l_orderkey AS request_id, 'c' || CAST(l_partkey % 5 AS VARCHAR(8)) AS name FROM {lineitem}),
rl AS (SELECT DISTINCT l_orderkey AS request_id, 'c' || CAST(l_suppkey % 5 AS VARCHAR(8)) AS name FROM {lineitem})
"""


def _names(spark, sf_dir, col):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("c"), (F.col(col) % 5).cast("string")).alias("name")).distinct()


@query("jon08_missing_and_orphan_rules", duck(_RULES_SQL) + " SELECT request_id, name, 'missing_rule' AS problem FROM (SELECT * FROM tg EXCEPT SELECT * FROM rl) UNION ALL SELECT request_id, name, 'orphan_rule' FROM (SELECT * FROM rl EXCEPT SELECT * FROM tg)")
def jon08(spark, sf_dir):
    # Targets and rules from one pass, so that a request's names stay in one task.
    side = lambda col, wanted: F.struct(F.concat(F.lit("c"), (F.col(col) % 5).cast("string")).alias("name"), F.lit(wanted).alias("wanted"), F.lit(not wanted).alias("ruled"))
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return ops.rule_problems(lines.select(F.col("l_orderkey").alias("request_id"), F.inline(F.array(side("l_partkey", True), side("l_suppkey", False)))))


@query("set04_label_conflicts", duck(_RULES_SQL) + " SELECT * FROM tg INTERSECT SELECT * FROM rl")
def set04(spark, sf_dir):
    return ops.label_conflicts(_names(spark, sf_dir, "l_partkey"), _names(spark, sf_dir, "l_suppkey"))


@query("prj09_label_lists", "SELECT page_id, array_to_string(list_filter(list_transform(string_split(url, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS labels FROM (SELECT page_id, replace(url, '/', ' , ') AS url FROM pages)")
def prj09(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("/"), F.lit(" , ")).alias("url"))
    return p.select("page_id", F.array_join(fn.normalize_label_list("url"), "|").alias("labels"))


@query("scl12_split_prompts", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS prompts FROM conversations")
def scl12(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(fn.split_prompts("text"), "|").alias("prompts"))


_LABEL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(left(t, 1024), '[\x00-\x1F\x7F/\\]', '_', 'g'), '[^A-Za-z0-9 _.+-]', '_', 'g'), '_+', '_', 'g')"""


@query("scl05_safe_labels", f"""
WITH a AS (SELECT 'page' AS kind, page_id AS id, 0 AS turn, url AS t FROM pages UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations),
b AS (SELECT kind, id, turn, left(trim(regexp_replace({_LABEL_SQL}, ' +', ' ', 'g')), 48) AS t FROM a)
SELECT kind, id, turn, CASE WHEN t = '' THEN 'unknown' ELSE t END AS label FROM b""")
def scl05(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.lit(0).alias("turn"), F.col("url").alias("t"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("int").alias("turn"), F.col("text").alias("t"))
    return pages.unionByName(turns).select("kind", "id", "turn", fn.sanitize_any_label("t").alias("label"))


@query("scl06_bounded_warnings", r"SELECT doc_id, left(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), 256) AS warning FROM documents")
def scl06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.bound_warning("text").alias("warning"))


@query("scl07_text_hazards", r"""
SELECT page_id, CASE WHEN regexp_matches(t, '[\x00-\x1F\x7F]') THEN 'control_character' WHEN contains(t, '://') THEN 'url' WHEN contains(t, '/') THEN 'slash' WHEN contains(t, chr(92)) THEN 'backslash' WHEN starts_with(t, '~') THEN 'home' WHEN regexp_matches(t, '^[A-Za-z]:') THEN 'drive' END AS hazard
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', ':') WHEN 2 THEN replace(replace(url, '://', ':'), '/', '~') ELSE html END AS t FROM pages)""")
def scl07(spark, sf_dir):
    k = F.col("page_id") % 4
    short = F.replace("url", F.lit("://"), F.lit(":"))
    t = F.when(k == 0, F.col("url")).when(k == 1, short).when(k == 2, F.replace(short, F.lit("/"), F.lit("~"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").withColumn("t", t).select("page_id", fn.text_hazards("t").alias("hazard"))


@query("scl08_forbidden_keys", r"""
WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"Device": {"x": ' || props || '}}' WHEN 1 THEN '{"list": [[' || props || '], {"de\\u0076ice": 1}]}' WHEN 2 THEN '{"note": "\\"device\\": 1", "m": []}'
  WHEN 3 THEN '{"device": ' WHEN 4 THEN '[1, [2, [3, [4, {"K": null}]]]]' ELSE replace(props, 'k', 'm') END AS j FROM events),
t AS (SELECT e.event_id, lower(t.key) AS k FROM e, LATERAL (SELECT * FROM json_tree(CASE WHEN json_valid(e.j) THEN e.j ELSE '0' END)) t WHERE lower(t.key) IN ('k', 'device')),
f AS (SELECT event_id, string_agg(DISTINCT k, ',' ORDER BY k) AS found FROM t GROUP BY event_id)
SELECT event_id, coalesce(found, '') AS found, CASE WHEN NOT json_valid(j) THEN 'invalid_json' END AS problem FROM e LEFT JOIN f USING (event_id)""".replace("\\\\", "\\"))
def scl08(spark, sf_dir):
    """Forbidden keys at several levels, in arrays, escaped, in a text that only looks like one, and in a text that is cut off."""
    k, one = F.col("event_id") % 6, lambda *parts: F.concat(*[F.lit(p) if p != "props" else F.col(p) for p in parts])
    j = F.when(k == 0, one('{"Device": {"x": ', "props", "}}")).when(k == 1, one('{"list": [[', "props", '], {"de\\u0076ice": 1}]}')).when(k == 2, F.lit('{"note": "\\"device\\": 1", "m": []}'))
    j = j.when(k == 3, F.lit('{"device": ')).when(k == 4, F.lit('[1, [2, [3, [4, {"K": null}]]]]')).otherwise(F.replace("props", F.lit("k"), F.lit("m")))
    found = fn.forbidden_keys(table(spark, sf_dir, "events").select("event_id", j.alias("j")), "event_id", "j", ["K", "device"])
    return found.withColumn("found", F.array_join("found", ","))


@query("scl17_metric_lines", """
SELECT event_id, 'requests_total' AS name, 'outcome="' || event_type || '"' AS labels, value FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def scl17(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    good = F.concat(F.lit('requests_total{outcome="'), "event_type", F.lit('"} '), F.col("value").cast("string"))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("# "), good)).when(F.col("event_id") % 7 == 0, F.lit("requests_total{")).otherwise(good)
    return fn.parse_metric_lines(e.select("event_id", line.alias("line")))


_VIDEO_SQL = """
vid AS (SELECT o_orderkey AS stream_id, CASE o_orderkey % 5 WHEN 0 THEN '0/0' WHEN 1 THEN 'N/A' WHEN 2 THEN '30000/1001' WHEN 3 THEN CAST(o_custkey % 60 AS VARCHAR(9)) || '/1' ELSE '24' END AS avg_frame_rate,
  CASE o_orderkey % 3 WHEN 0 THEN '25/0' WHEN 1 THEN '50/2' END AS r_frame_rate, CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE CAST(o_custkey AS VARCHAR(9)) END AS nb_frames, CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE CAST(o_custkey % 90 + 1 AS VARCHAR(9)) END AS duration FROM {orders})
"""


@query("src05_video_meta", duck(_VIDEO_SQL) + """,
r AS (SELECT *, CASE WHEN contains(avg_frame_rate, '/') THEN CASE WHEN TRY_CAST(string_split(avg_frame_rate, '/')[2] AS DOUBLE) <> 0 THEN TRY_CAST(string_split(avg_frame_rate, '/')[1] AS DOUBLE) / TRY_CAST(string_split(avg_frame_rate, '/')[2] AS DOUBLE) END ELSE TRY_CAST(avg_frame_rate AS DOUBLE) END AS a,
  CASE WHEN contains(r_frame_rate, '/') THEN CASE WHEN TRY_CAST(string_split(r_frame_rate, '/')[2] AS DOUBLE) <> 0 THEN TRY_CAST(string_split(r_frame_rate, '/')[1] AS DOUBLE) / TRY_CAST(string_split(r_frame_rate, '/')[2] AS DOUBLE) END END AS b, CASE WHEN regexp_full_match(nb_frames, '[0-9]+') THEN CAST(nb_frames AS BIGINT) END AS frames FROM vid)
SELECT stream_id, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN CAST(duration AS DOUBLE) > 0 AND frames > 0 THEN frames / CAST(duration AS DOUBLE) END, 25.0e0) AS fps, frames FROM r""")
def src05(spark, sf_dir):
    v = spark.sql("WITH " + _VIDEO_SQL + " SELECT * FROM vid", orders=table(spark, sf_dir, "orders"))
    return fn.normalize_video_meta(v).select("stream_id", "fps", "frames")


_LINKED = """ [more](notes/{n}.md#top) [home](</>) ![x]( https://example.org/a ) [same](#here) [index](index.html "The index") [mail](mailto:a@b.c) <a href='my%20file.md?x=1'> [tel](tel:12+3)"""


@query("jon09_missing_links", r"""
WITH h AS (SELECT page_id, html || replace('""" + _LINKED.replace("'", "''") + r"""', '{n}', CAST(page_id % 9 AS VARCHAR)) AS html FROM pages),
raw AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '!?(?:\[[^\]]*\])\(([^)]+)\)', 1), regexp_extract_all(html, '(?:href|src)=["'']([^"'']+)["'']', 1))) AS link FROM h),
w AS (SELECT page_id, trim(regexp_extract(link, '^\s*(\S*)', 1), '<>') AS link FROM raw),
l AS (SELECT page_id, url_decode(regexp_replace(link, '[?#].*$', '')) AS target FROM w WHERE NOT (starts_with(link, 'http://') OR starts_with(link, 'https://') OR starts_with(link, 'mailto:') OR starts_with(link, '#') OR starts_with(link, 'data:'))),
k AS (SELECT DISTINCT '/' || string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS target FROM pages)
SELECT page_id, target, count(*) AS n FROM l WHERE target <> '' AND target NOT IN (SELECT target FROM k) GROUP BY ALL""")
def jon09(spark, sf_dir):
    """Pages with some Markdown behind their HTML: titles, brackets, images, escapes and targets elsewhere."""
    p = table(spark, sf_dir, "pages")
    known = p.select(F.concat(F.lit("/"), F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), -1)).alias("target"))
    return fn.missing_links(p.select("page_id", F.concat("html", F.replace(F.lit(_LINKED), F.lit("{n}"), (F.col("page_id") % 9).cast("string"))).alias("html")), known, "page_id", "html")


_FENCED = "\n```\n<h1>\n```\n~~~\n<h1> example.org\n~~~"


@query("agg21_document_checks", rf"""
WITH fenced AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html || '{_FENCED}' || html ELSE html END AS html FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) - CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS headings, array_to_string(list_filter([CASE WHEN contains(html, '<script') THEN 'script' END, CASE WHEN contains(html, 'example.org') THEN 'host' END], lambda x: x IS NOT NULL), ',') AS found FROM fenced""")
def agg21(spark, sf_dir):
    """Every third page twice, with fenced code in between whose headings do not count."""
    p = table(spark, sf_dir, "pages")
    fenced = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(_FENCED), "html")).otherwise(F.col("html"))
    return fn.document_checks(p.select("page_id", fenced.alias("html")), "page_id", "html", "<h1>", {"script": "<script", "host": r"example\.org"})


_PROMPT_ROWS_SQL = """
pr AS (SELECT conv_id AS request_id, CASE role WHEN 'user' THEN 0 ELSE 1 END AS class_order, turn, pos, w[pos] AS prompt FROM (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT *, string_split_regex(text, '[ \n]') AS w FROM conversations))),
pn AS (SELECT request_id, class_order, CAST(row_number() OVER (PARTITION BY request_id, class_order ORDER BY turn, pos, prompt) - 1 AS INT) AS prompt_index, prompt FROM pr)
"""


def prompt_rows(spark, sf_dir):
    """Every word of a conversation as a prompt of its speaker's class."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("class_order"), "turn", F.posexplode(F.split("text", "[ \n]")).alias("pos", "prompt"))
    n = F.row_number().over(Window.partitionBy("request_id", "class_order").orderBy("turn", "pos", "prompt")) - 1
    return c.select("request_id", "class_order", n.alias("prompt_index"), "prompt")


@query("win13_duplicate_prompts", "WITH " + _PROMPT_ROWS_SQL + ", f AS (SELECT *, min(prompt_index) OVER (PARTITION BY request_id, class_order, prompt) AS first_index FROM pn) SELECT request_id, class_order, prompt_index, first_index FROM f WHERE first_index < prompt_index")
def win13(spark, sf_dir):
    return fn.duplicate_prompts(prompt_rows(spark, sf_dir)).select("request_id", "class_order", "prompt_index", "first_index")


@query("agg20_prompt_violations", "WITH " + _PROMPT_ROWS_SQL + """,
f AS (SELECT *, min(prompt_index) OVER (PARTITION BY request_id, class_order, prompt) AS first_index, count(*) OVER (PARTITION BY request_id, class_order) AS n_class, count(*) OVER (PARTITION BY request_id) AS n FROM pn),
v AS (SELECT request_id, class_order, CASE WHEN n_class > 400 THEN 'too_many_prompts' WHEN prompt = '' THEN 'empty_prompt' WHEN length(prompt) > 14 THEN 'prompt_too_long' WHEN first_index < prompt_index THEN 'duplicate_prompt' WHEN n > 700 THEN 'too_many_total' END AS violation,
  CASE WHEN n_class > 400 THEN 0 ELSE prompt_index + 1 END AS b FROM f)
SELECT request_id, violation, CAST(CASE WHEN violation = 'too_many_total' THEN 0 ELSE class_order END AS INT) AS class_order FROM v WHERE violation IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY violation = 'too_many_total', class_order, b) = 1""")
def agg20(spark, sf_dir):
    return fn.prompt_violations(prompt_rows(spark, sf_dir), 32, 400, 700, 14)
