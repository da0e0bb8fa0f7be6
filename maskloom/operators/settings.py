"""Run requests: resolving settings, estimating and admitting work, alternatives, range checks, key classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The settings in order, with their defaults; a true or false setting is 1 or 0.
DEFAULTS = {
    "points_per_side": 8,
    "points_per_batch": 8,
    "pred_iou_thresh": 0.5,
    "stability_score_thresh": 0.5,
    "stability_score_offset": 1.0,
    "mask_threshold": 0.0,
    "box_nms_thresh": 0.7,
    "crop_n_layers": 0,
    "crop_nms_thresh": 0.7,
    "crop_overlap_ratio": 512 / 1500,
    "crop_n_points_downscale_factor": 1,
    "min_mask_region_area": 0,
    "use_m2m": 0,
    "multimask_output": 1,
}
FIELDS = tuple(DEFAULTS)

#: What a profile sets.
PROFILES = {
    "fast": {"points_per_side": 8, "points_per_batch": 8, "pred_iou_thresh": 0.5, "stability_score_thresh": 0.5, "crop_n_layers": 0},
    "balanced": {"points_per_side": 16, "points_per_batch": 16, "pred_iou_thresh": 0.7, "stability_score_thresh": 0.8, "crop_n_layers": 0},
    "quality": {
        "points_per_side": 32, "points_per_batch": 32, "pred_iou_thresh": 0.75, "stability_score_thresh": 0.85, "crop_n_layers": 1,
        "crop_n_points_downscale_factor": 2, "min_mask_region_area": 50, "multimask_output": 1,
    },
}

#: Caps of the work a request may ask for, in the order in which they are checked.
CAPS = {"points_per_side": 64, "points_per_batch": 64, "crop_n_layers": 2, "min_mask_region_area": 1_000_000, "estimated_prompt_count": 8192, "estimated_mask_prediction_count": 24576}
FIELD_CAPS = ("points_per_side", "points_per_batch", "crop_n_layers", "min_mask_region_area")
WORK_CAPS = {"estimated_prompt_count": "prompts", "estimated_mask_prediction_count": "predictions"}

#: What each setting may be at all.
BOUNDS = {
    "points_per_side": (1, 1024),
    "points_per_batch": (1, 1024),
    "pred_iou_thresh": (0.0, 1.0),
    "stability_score_thresh": (0.0, 1.0),
    "stability_score_offset": (0.0, 10.0),
    "mask_threshold": (-32.0, 32.0),
    "box_nms_thresh": (0.0, 1.0),
    "crop_n_layers": (0, 8),
    "crop_nms_thresh": (0.0, 1.0),
    "crop_overlap_ratio": (0.0, 1.0),
    "crop_n_points_downscale_factor": (1, 32),
    "min_mask_region_area": (0, 64_000_000),
}


def resolve_settings(requests: DataFrame) -> DataFrame:
    """Each field from the request, else its profile, else the default, with where it came from. A field that requests lack as a column is never explicit."""
    given = {c.lower() for c in requests.columns}
    explicit = {f: F.col(f).cast("double") if f in given else F.lit(None).cast("double") for f in FIELDS}

    def of(f: str) -> Column:
        by_profile = F.lit(None).cast("double")
        for p, fields in PROFILES.items():
            by_profile = F.when(F.col("profile") == p, F.lit(float(fields[f]))).otherwise(by_profile) if f in fields else by_profile
        source = F.when(explicit[f].isNotNull(), "explicit").when(by_profile.isNotNull(), "profile").otherwise("default")
        return F.struct(F.lit(f).alias("field"), F.coalesce(explicit[f], by_profile, F.lit(float(DEFAULTS[f]))).alias("value"), source.alias("source"))

    return requests.select("request_id", F.inline(F.array(*[of(f) for f in FIELDS])))


def typed(f: str, value: Column) -> Column:
    return value.cast("int") if isinstance(DEFAULTS[f], int) else value


def effective(requests: DataFrame) -> DataFrame:
    """The resolved settings of each request in one row."""
    r = resolve_settings(requests)
    return r.groupBy("request_id").agg(*[typed(f, F.max(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in FIELDS])


def prompts_of(points: Column, layers: Column, factor: Column) -> Column:
    """Sum over layers of 4**l * int(points / factor**l)**2."""

    def layer(a, k):
        side = F.floor(points / F.pow(factor, k))
        return a + (F.pow(F.lit(4.0), k) * side * side).cast("long")

    return F.aggregate(F.sequence(F.lit(0), layers), F.lit(0).cast("long"), layer)


def estimate_work(settings: DataFrame) -> DataFrame:
    """Prompts and predictions, and whether the deepest layer keeps a point."""
    n = prompts_of(F.col("points_per_side"), F.col("crop_n_layers"), F.col("crop_n_points_downscale_factor"))
    deepest = F.floor(F.col("points_per_side") / F.pow("crop_n_points_downscale_factor", "crop_n_layers"))
    s = settings.withColumn("prompts", n)
    return s.withColumns({"predictions": F.col("prompts") * F.when(F.col("multimask_output") == 1, 3).otherwise(1), "deepest_ok": deepest >= 1})


def admit_work(estimated: DataFrame, caps: dict = CAPS) -> DataFrame:
    """`reason`: the first violated cap (reaching one is allowed), of the fields first; `warnings` of admitted requests from four fifths of a work cap on."""
    reason = F.when(~F.col("deepest_ok"), "crop_n_points_downscale_factor")
    for field in FIELD_CAPS:
        reason = reason.when(F.col(field) > caps[field], field)
    for cap, count in WORK_CAPS.items():
        reason = reason.when(F.col(count) > caps[cap], cap)
    near = F.array_compact(F.array(*[F.when(F.col(n) * 100 >= caps[c] * 80, f"{c} is at least 80% of its operator cap") for c, n in WORK_CAPS.items()]))
    judged = estimated.withColumn("reason", reason)
    return judged.withColumn("warnings", F.when(F.col("reason").isNull(), F.array_join(near, "; ")).otherwise(""))


def admissible_alternatives(estimated: DataFrame, caps: dict = CAPS) -> DataFrame:
    """Up to three other settings that would be admitted: defaults with the fast profile, the request clamped to the caps with one mask per point, and of that the least work."""
    least = {"points_per_side": 1, "points_per_batch": 1, "crop_n_layers": 0, "crop_n_points_downscale_factor": 1, "multimask_output": 0, "min_mask_region_area": 0}
    plain = lambda f, v: F.lit(v).cast("int" if isinstance(DEFAULTS[f], int) else "double")
    fast = {f: plain(f, v) for f, v in {**DEFAULTS, **PROFILES["fast"]}.items()}
    clamped = {f: F.least(F.col(f), F.lit(caps[f])) if f in FIELD_CAPS else F.col(f) for f in FIELDS} | {"multimask_output": F.lit(0)}
    minimum = clamped | {f: plain(f, v) for f, v in least.items()}
    option = lambda values: F.struct(*[values[f].alias(f) for f in FIELDS])
    each = estimated.select("request_id", F.posexplode(F.array(option(fast), option(clamped), option(minimum))).alias("pos", "o")).select("request_id", "pos", "o.*")
    valid = F.lit(True)
    for f, (low, high) in BOUNDS.items():
        valid = valid & F.col(f).between(low, high)
    good = admit_work(estimate_work(each.filter(valid)), caps).filter("reason IS NULL")
    same = Window.partitionBy("request_id", *FIELDS).orderBy("pos")
    distinct = good.withColumn("n", F.row_number().over(same)).filter("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("pos"))
    return distinct.withColumn("place", place).select("request_id", "place", *FIELDS, "prompts", "predictions")


def range_violations(requests: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """The first field, in order, whose explicit value is out of range."""
    spark = requests.sparkSession
    b = spark.createDataFrame([(f, k, float(lo), float(hi)) for k, (f, (lo, hi)) in enumerate(bounds.items())], "field string, field_order int, low double, high double")
    long = requests.select("request_id", *[F.col(f).cast("double").alias(f) for f in bounds]).unpivot("request_id", list(bounds), "field", "value")
    bad = long.join(F.broadcast(b), "field").filter("value < low OR value > high")
    return bad.groupBy("request_id").agg(F.min_by(F.struct("field", "value", "low", "high"), "field_order").alias("v")).select("request_id", "v.*")


def setting_violations(requests: DataFrame, fields: dict[str, tuple[str, float, float]], pairs: tuple[tuple[str, str], ...] = (), aliases: dict[str, str] | None = None, col: str = "settings") -> DataFrame:
    """The first violation of each request in field order, then pair by pair: request_id, field, problem.

    fields: name to (int, number or bool; low, high); pairs: (least, most) fields; aliases: old spelling to field. Of a field both
    spellings together are a `conflict`, then comes its `type`, then its `range`; a pair is in wrong `order` if least > most.
    settings is a map of texts.
    """
    old = {new: was for was, new in (aliases or {}).items()}
    given = lambda k: F.map_contains_key(F.col(col), F.lit(k))
    at = lambda k: F.try_element_at(F.col(col), F.lit(k))
    value = {k: F.coalesce(at(k), at(old[k])) if k in old else at(k) for k in fields}
    found = lambda k, problem, when: F.when(when, F.struct(F.lit(k).alias("field"), F.lit(problem).alias("problem")))
    checks = []
    for k, (kind, low, high) in fields.items():
        v = value[k]
        well = {"int": v.rlike("^[+-]?[0-9]+$"), "number": v.try_cast("double").isNotNull() & ~F.isnan(v.try_cast("double")), "bool": F.lower(v).isin("true", "false")}[kind]
        if k in old:
            checks.append(found(k, "conflict", given(k) & given(old[k])))
        checks.append(found(k, "type", v.isNotNull() & ~well))
        if kind != "bool":
            checks.append(found(k, "range", (v.try_cast("double") < low) | (v.try_cast("double") > high)))
    checks += [found(a, "order", value[a].try_cast("double") > value[b].try_cast("double")) for a, b in pairs]
    return requests.select("request_id", F.coalesce(*checks).alias("v")).filter("v IS NOT NULL").select("request_id", "v.field", "v.problem")


#: Top-level settings by who reads them.
ALGORITHM_KEYS = ("alpha", "preprocessing", "mask_generator", "postsam2processing", "clip", "clip_routing", "blip3", "candidate_views", "diagnostic_artifacts", "visualization")
BATCH_KEYS = ("images", "video", "export_yolo_det")


def classify_keys(settings: DataFrame, col: str = "settings") -> DataFrame:
    """Sorted top-level keys of each request's settings map, by class."""
    keys = F.map_keys(F.col(col))
    known = lambda names: F.array(*[F.lit(n) for n in names])
    rest = F.array_except(keys, known(ALGORITHM_KEYS + BATCH_KEYS))
    pick = lambda c: F.array_join(F.array_sort(c), ",")
    return settings.select("request_id", pick(F.array_intersect(keys, known(ALGORITHM_KEYS))).alias("algorithm"), pick(F.array_intersect(keys, known(BATCH_KEYS))).alias("batch_only"), pick(rest).alias("unrecognized"))


def unknown_keys(settings: DataFrame, allowed: tuple[str, ...], col: str = "settings") -> DataFrame:
    return settings.select("request_id", F.array_sort(F.array_except(F.map_keys(F.col(col)), F.array(*[F.lit(a) for a in allowed]))).alias("unknown"))


def missing_and_orphan_rules(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Targets without a rule and rules without a target, per request. Both: request_id, name."""
    sides = targets.select("request_id", "name", F.lit(True).alias("wanted"), F.lit(False).alias("ruled")).unionByName(rules.select("request_id", "name", F.lit(False).alias("wanted"), F.lit(True).alias("ruled")))
    return rule_problems(sides)


def rule_problems(sides: DataFrame) -> DataFrame:
    """missing_and_orphan_rules of one table: request_id, name, and whether the row is of a target (wanted) or of a rule (ruled)."""
    per = sides.groupBy("request_id", "name").agg(F.max("wanted").alias("wanted"), F.max("ruled").alias("ruled")).filter("wanted <> ruled")
    return per.select("request_id", "name", F.when(F.col("wanted"), "missing_rule").otherwise("orphan_rule").alias("problem"))


def label_conflicts(targets: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Labels that are target and uncertain in one request."""
    return targets.select("request_id", "name").intersect(uncertain.select("request_id", "name"))
