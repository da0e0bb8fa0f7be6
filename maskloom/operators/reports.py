"""Reports over frames, timings, request logs and objects: counters, quantiles, audits, documents, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from pyspark.sql.types import ArrayType

from .objects import record_struct


def frame_ids(frames: DataFrame) -> DataFrame:
    """`stem-0000001` and so on, counted per stream."""
    return frames.withColumn("frame_id", F.format_string("%s-%07d", F.concat(F.lit("stream"), F.col("stream_id").cast("string")), "frame_idx"))


def sequence_names(frames: DataFrame, present: Column) -> DataFrame:
    """File names per stream; frames that are missing do not advance the count."""
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_idx"))
    return frames.filter(present).withColumn("n", n).withColumns({"name": F.format_string("%07d.jpg", "n"), "stream_name": F.format_string("stream-%04d", "n")}).drop("n")


def ranked_values(timings: DataFrame, key: str, value: str) -> DataFrame:
    """Each distinct value of a key (null first) with `count`, and `before`, the rows of the key that stand before it in order.

    Keys and values are range-partitioned, so a key's values spread over tasks whatever share of all rows it has; counts of a
    task's part of a key are added up first, and a row's place in its part then.
    """
    counts = timings.groupBy(key, value).agg(F.count(F.lit(1)).alias("count"))
    dealt = counts.repartitionByRange(F.col(key), F.col(value).asc_nulls_first()).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "ranked")
    parts = dealt.groupBy(key, "part").agg(F.sum("count").alias("rows"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col(key).alias("start_key"), F.col("part").alias("start_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(key, "part").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    both = placed.join(starts.hint("merge"), F.col(key).eqNullSafe(F.col("start_key")) & (F.col("part") == F.col("start_part")))
    return both.select(key, value, "count", (F.col("start") + F.col("inside")).alias("before"))


def value_at(value: str, rank: Column) -> Column:
    """The value of ranked_values that holds a rank, counted from 1; one per key."""
    return F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("count")), F.col(value)))


def latency_summary(timings: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First, least, greatest, upper and true median of each key. Nulls stand first among the ranks, but have no part in the true median."""
    sums = timings.groupBy(key).agg(
        F.min_by(value, F.struct(*order)).alias("first"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(F.lit(1)).alias("n"), F.count(value).alias("known")
    )
    ranked = ranked_values(timings, key, value).withColumnRenamed(key, "ranked_key")
    both = ranked.join(sums.hint("merge"), F.col("ranked_key").eqNullSafe(F.col(key)))
    unknown = F.col("n") - F.col("known")
    half = lambda k: value_at(value, unknown + F.expr(f"(known + {k}) div 2"))
    return both.groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("first", "least", "greatest")], value_at(value, F.expr("n div 2 + 1")).alias("upper_median"), (half(1) * 0.5 + half(2) * 0.5).alias("median")
    )


def nearest_rank(timings: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """The value at rank max(1, int(share * n + 0.999999)) of each key."""
    sums = timings.groupBy(F.col(key).alias("sum_key")).agg(F.count(F.lit(1)).alias("n"))
    both = ranked_values(timings, key, value).join(sums.hint("merge"), F.col(key).eqNullSafe(F.col("sum_key")))
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * share + 0.999999).cast("long"))
    return both.groupBy(key).agg(value_at(value, rank).alias("value"))


#: Outcomes by the group that reports add up.
OUTCOME_GROUPS = {"busy": ("service_busy",), "not_ready": ("not_ready",), "timeout": ("timeout",), "cancelled": ("cancelled",), "limit": ("response_too_large", "insufficient_memory", "insufficient_shm")}


def counter_columns() -> list[Column]:
    groups = [F.count_if(F.col("outcome").isin(*v)).alias(k) for k, v in OUTCOME_GROUPS.items()]
    return [F.count(F.lit(1)).alias("requests"), F.count_if(F.col("outcome") == "success").alias("success"), *groups]


def histogram_columns(value: str, bounds: list[float]) -> list[Column]:
    names = [f"le_{b:g}".replace(".", "_") for b in bounds]
    counts = [F.count_if(F.col(value) <= b).alias(n) for n, b in zip(names, bounds, strict=True)]
    return [*counts, F.count(value).alias("le_inf"), F.bround(F.sum(F.col(value).cast("decimal(20,4)")), 4).cast("double").alias("total")]


def gauge_columns(order: list[str], value: str) -> list[Column]:
    return [F.max_by(value, F.struct(*order)).alias("latest"), F.max(value).alias("peak")]


def outcome_counters(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(*counter_columns())


def cumulative_histogram(log: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Counts of values up to each bound, and all of them, in one pass."""
    return log.groupBy(*keys).agg(*histogram_columns(value, bounds))


def gauges(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return log.groupBy(*keys).agg(*gauge_columns(order, value))


def repeatability(runs: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(*signature).alias("signatures")).withColumn("repeatable", F.col("signatures") == 1)


def monotonic_growth(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Whether a series never falls, and ends above its start."""
    rows = log.withColumn("before", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    rises = F.bool_and(F.coalesce(F.col(value) >= F.col("before"), F.lit(True)))
    return rows.groupBy(key).agg(rises.alias("never_falls"), (F.max_by(value, F.struct(*order)) > F.min_by(value, F.struct(*order))).alias("grows"))


def frame_size_conflicts(frames: DataFrame) -> DataFrame:
    """Streams whose frames differ in size."""
    return frames.groupBy("stream_id").agg(F.countDistinct("img_w", "img_h").alias("sizes")).filter("sizes > 1")


def unexpected_stage_status(statuses: DataFrame, expected: DataFrame) -> DataFrame:
    """Stages whose status is not the expected one, missing and surplus stages included. Both: request_id, stage, status."""
    e = expected.select("request_id", "stage", F.col("status").alias("expected"))
    both = statuses.join(e.hint("merge"), ["request_id", "stage"], "full")
    return both.filter(~F.col("status").eqNullSafe(F.col("expected"))).select("request_id", "stage", "status", "expected")


#: What a stage's status can be.
STATUSES = ("executed", "skipped", "not_configured")


def stage_order_problems(statuses: DataFrame, order: list[str]) -> DataFrame:
    """Requests whose stages are not the full list in its order, or have a status that is none. statuses: request_id, seq, stage, status."""
    per = statuses.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stage"))).alias("s"), F.count_if(~F.col("status").isin(*STATUSES)).alias("unknown"))
    stages, full = F.transform("s", lambda x: x["stage"]), F.array(*[F.lit(x) for x in order])
    problem = F.when(F.col("unknown") > 0, "unknown_status").when(F.size(F.array_except(full, stages)) > 0, "missing_stage").when(F.size(F.array_except(stages, full)) > 0, "surplus_stage").when(stages != full, "wrong_order")
    return per.select("request_id", F.array_join(stages, ",").alias("stages"), problem.alias("problem")).filter("problem IS NOT NULL")


def stage_funnel(parts: dict[str, Column], rows: DataFrame) -> DataFrame:
    """image_id, stage, n: how many rows of each image meet each stage's condition."""
    n = rows.groupBy("image_id").agg(*[F.count_if(c).alias(k) for k, c in parts.items()])
    return n.unpivot("image_id", list(parts), "stage", "n")


def accounting_violations(checks: DataFrame, keys: list[str], identities: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per identity that does not hold."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), a.cast("double").alias("lhs"), b.cast("double").alias("rhs")) for n, (a, b) in identities.items()])
    return checks.select(*keys, F.inline(rows)).filter(~F.col("lhs").eqNullSafe(F.col("rhs")))


def accounting_summary(checks: DataFrame, keys: list[str], identities: dict[str, tuple[Column, Column]]) -> DataFrame:
    """How often each identity was looked at and broken."""
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(a == b, F.lit(False)).alias("holds")) for n, (a, b) in identities.items()])
    return checks.select(*keys, F.inline(rows)).groupBy("check").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("holds")).alias("broken"))


def content_digest(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Digest of a group's rows in a fixed order and form."""
    line = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def record_json() -> Column:
    return F.to_json(F.struct("instance_id", "source_index", "label", "class_id", "area", F.col("x0_incl").alias("x0"), F.col("y0_incl").alias("y0"), F.col("x1_incl").alias("x1"), F.col("y1_incl").alias("y1")))


def records(objects: DataFrame, images: DataFrame) -> DataFrame:
    """One JSON list of records per image in final order."""
    per = objects.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("instance_id", record_json().alias("r")))).alias("l"))
    return images.select("image_id").join(per.hint("merge"), "image_id", "left").select("image_id", F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("l", lambda x: x["r"]), ","), F.lit("")), F.lit("]")).alias("records"))


def result_documents(objects: DataFrame, images: DataFrame, level: int, artifacts: DataFrame | None = None, rle: DataFrame | None = None, counts: DataFrame | None = None,
                     settings: DataFrame | None = None, statuses: DataFrame | None = None, diagnostics: DataFrame | None = None, timings: DataFrame | None = None) -> DataFrame:
    """Documents by tier. A tier is a choice of columns: what it leaves out is never computed.

    0: labels and the effective settings (settings: image_id, field, value as text, source); 1: and descriptors of the artifacts (image_id, name, raw_bytes, sha256); 2: and object records; 3: and the objects'
    run lengths (rle: the mask keys, counts; or a column `counts` of the objects), the funnel (counts: image_id, stage, n), warnings, the statuses of the stages (statuses:
    image_id, stage, status), the filter's counters (diagnostics: image_id, counter, n) and the time that stages took (timings: image_id, stage, ms).
    """
    told = {
        "settings": (0, settings, lambda: F.concat("field", F.lit("="), "value", F.lit(":"), "source")), "stage_statuses": (3, statuses, lambda: F.concat("stage", F.lit("="), "status")),
        "post_filter_diagnostics": (3, diagnostics, lambda: F.concat("counter", F.lit("="), F.col("n").cast("string"))), "timings_ms": (3, timings, lambda: F.concat("stage", F.lit("="), F.col("ms").cast("string"))),
    }
    lines = F.array_sort(F.collect_list(F.struct("instance_id", F.col("label").alias("label"))))
    warnings = F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("instance_id", F.concat(F.lit("object "), F.col("instance_id").cast("string"), F.lit(": "), "warning").alias("w")))))
    text = lambda: F.concat(F.col("instance_id").cast("string"), F.lit("="), F.array_join(F.transform("counts", lambda x: x.cast("string")), " "))
    # What an object tells goes to its image at once: one pass over the objects.
    listed = {"l": lines}
    if level >= 2:
        listed["o"] = F.array_sort(F.collect_list(F.struct("instance_id", record_json().alias("r"))))
    if level >= 3:
        listed["w"] = warnings
        if rle is None and "counts" in objects.columns:
            listed["c"] = F.array_sort(F.collect_list(F.struct("instance_id", text().alias("t"))))
    per = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in listed.items()])
    joined = lambda c, field: F.coalesce(F.array_join(F.transform(c, lambda x: x[field]), ","), F.lit(""))
    told_of = {"l": joined("l", "label").alias("labels"), "w": joined("w", "w").alias("warnings"), "o": F.concat(F.lit("["), joined("o", "r"), F.lit("]")).alias("records"), "c": joined("c", "t").alias("mask_rle")}
    base = images.select("image_id").join(per.hint("merge"), "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("objects"), *[told_of[k] for k in listed])
    if level >= 1 and artifacts is not None:
        described = F.concat_ws(":", "name", F.col("raw_bytes").cast("string"), "sha256")
        per = artifacts.groupBy(F.col("request_id").alias("image_id")).agg(F.array_join(F.array_sort(F.collect_list(described)), ",").alias("artifacts"))
        base = base.join(per.hint("merge"), "image_id", "left").na.fill("", ["artifacts"])
    if level >= 3 and rle is not None:
        own = objects.select("image_id", "source_index", "instance_id").join(rle.select("image_id", "source_index", "counts").hint("merge"), ["image_id", "source_index"])
        per = own.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("instance_id", text().alias("t")))).alias("r")).select("image_id", joined("r", "t").alias("mask_rle"))
        base = base.join(per.hint("merge"), "image_id", "left").na.fill("", ["mask_rle"])
    if level >= 3 and counts is not None:
        per = counts.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("stage", F.lit("="), F.col("n").cast("string")))), ",").alias("candidate_counts"))
        base = base.join(per.hint("merge"), "image_id", "left").na.fill("", ["candidate_counts"])
    for name, (least, rows, text) in told.items():
        if level >= least and rows is not None:
            per = rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(text())), ",").alias(name))
            base = base.join(per.hint("merge"), "image_id", "left").na.fill("", [name])
    return base


def public_projection(objects: DataFrame, images: DataFrame, counts: DataFrame, warnings: int = 32, characters: int = 256) -> DataFrame:
    """One compact JSON text per image, keys sorted: counts by stage, size, object records without masks, bounded warnings.

    images: image_id, img_w, img_h; counts: image_id, stage, n. Numbers that are not finite have no place in it: they become null and
    so are left out.
    """
    w = F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("instance_id", F.substring(F.regexp_replace("warning", r"[\x00-\x1F]", " "), 1, characters).alias("w")))))
    per = objects.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("instance_id", record_struct().alias("r")))).alias("o"), w.alias("w"))
    stages = counts.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("candidate_counts"))
    all_of = images.join(per.hint("merge"), "image_id", "left").join(stages.hint("merge"), "image_id", "left")
    none = F.array().cast(ArrayType(objects.select(record_struct().alias("r")).schema["r"].dataType))
    warned = F.coalesce(F.transform(F.slice("w", 1, warnings), lambda x: x["w"]), F.array().cast("array<string>"))
    document = F.struct("candidate_counts", F.struct(F.col("img_h").alias("height"), F.col("img_w").alias("width")).alias("image"), F.coalesce(F.transform("o", lambda x: x["r"]), none).alias("objects"), warned.alias("warnings"))
    return all_of.select("image_id", F.to_json(document).alias("document"))


def dataset_manifest(labels: list[str]) -> dict:
    """What a data set's description file says."""
    return {"train": "images/train", "val": "images/val", "nc": len(labels), "names": list(labels)}


def dataset_row(labels: DataFrame) -> DataFrame:
    """The description of a data set as one row: train, val, nc, names. labels: position, label; the class list, which is short, in order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"])
    fixed = dataset_manifest([])
    return labels.agg(F.lit(fixed["train"]).alias("train"), F.lit(fixed["val"]).alias("val"), F.count(F.lit(1)).alias("nc"), names.alias("names"))


def label_manifest(objects: DataFrame) -> DataFrame:
    """Class ids in use with their labels and counts, in order."""
    return objects.groupBy("class_id", "label").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("image_id").alias("images"))


def split_train_val(images: DataFrame, train_percent: int, seed: int, key: str = "image_id") -> DataFrame:
    """A split by the image id alone: the same in every run and on every machine."""
    h = F.pmod(F.col(key) * 7919 + seed, F.lit(10_000))
    return images.withColumn("split", F.when(h < train_percent * 100, "train").otherwise("val"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Random but repeatable order; the sort is by range partitions."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary"))).orderBy("shuffle_key", key)


def stable_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)


def findings_diff(current: DataFrame, baseline: DataFrame, strict: bool = True) -> DataFrame:
    """Findings added to and removed from a baseline, as sets: how often one stands on either side does not matter. Only added ones fail unless strict."""
    added = current.subtract(baseline).withColumn("change", F.lit("added"))
    removed = baseline.subtract(current).withColumn("change", F.lit("removed"))
    return added.unionByName(removed).withColumn("fails", (F.col("change") == "added") | F.lit(strict))
