"""Text functions: tokens, labels, hazards, keys, links, metric lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc_token(values: pd.Series) -> pd.Series:
    """Compatibility form, case-folded, without outer spaces and final punctuation. Spark has no built-in for the first two."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold().rstrip(".!?,;:").strip())


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: White space of ASCII, and the rest of it that has no compatibility form.
_SPACE = r"[\x09-\x0D\x1C-\x20]"
_WIDE_SPACE = "[\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def plain_token(c: Column) -> Column:
    """The token of a text of ASCII."""
    return strip(F.regexp_replace(strip(F.lower(c)), r"[.!?,;:]+$", ""))


def nfkc_token(col: str) -> Column:
    """Built-ins for ASCII. Python is given the other texts only, and null in the place of these."""
    c = F.col(col)
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc_token(F.when(wide, c))).otherwise(plain_token(c))


def sanitize_label(col: str | Column, most: int = 48) -> Column:
    """A name that is safe to show: controls, slashes and unsafe characters become an underscore, other white space a space; runs of either are one, and it is never empty."""
    c = F.substring(F.col(col) if isinstance(col, str) else col, 1, 1024)
    c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F\x7F/\\]", "_"), _WIDE_SPACE, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9 _.+-]", "_"), "_+", "_")
    c = F.substring(F.regexp_replace(F.trim(F.regexp_replace(c, " +", " ")), "_+", "_"), 1, most)
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(c)


def sanitize_any_label(col: str) -> Column:
    """sanitize_label after compatibility normalisation of text that is not ASCII."""
    c = F.substring(F.col(col), 1, 1024)
    wide = c.rlike(r"[^\x00-\x7F]")
    return sanitize_label(F.when(wide, _nfkc(F.when(wide, c))).otherwise(c))


def bound_warning(col: str, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(F.col(col), r"[\x00-\x1F\x7F]", " "), 1, most)


def text_hazards(col: str) -> Column:
    """The first hazard of a text, null if none."""
    c = F.col(col)
    return F.when(c.rlike(r"[\x00-\x1F\x7F]"), "control_character").when(c.contains("://"), "url").when(c.contains("/"), "slash").when(c.contains("\\"), "backslash").when(c.startswith("~"), "home").when(c.rlike("^[A-Za-z]:"), "drive")


def json_keys(documents: DataFrame, key: str, col: str, depth: int = 32) -> DataFrame:
    """key, name, level: the keys of JSON texts at any level of objects and arrays, as the parser reads them (escapes resolved).

    Level by level: what an object or array holds becomes rows of the next one, so a document's width is spread over tasks. A text
    that is no JSON has the level -1, one that goes deeper than `depth` the level `depth`, both without a name. A null text has no rows.
    """
    spark, parsed = documents.sparkSession, documents.filter(F.col(col).isNotNull()).select(key, F.try_parse_json(col).alias("v"))
    none = F.lit(None).cast("string").alias("name")
    found = [parsed.filter("v IS NULL").select(key, none, F.lit(-1).alias("level"))]
    here = parsed.filter("v IS NOT NULL")
    for level in range(depth):
        inner = here.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col(key), F.col("key").alias("name"), F.col("value").alias("v"))
        inner = staged(inner, "json-level")
        found.append(inner.filter("name IS NOT NULL").select(key, "name", F.lit(level).alias("level")))
        here = inner.filter(~F.schema_of_variant("v").rlike("^(?!OBJECT|ARRAY)")).select(key, "v")
        if here.isEmpty():
            break
    else:
        found.append(here.select(key, none, F.lit(depth).alias("level")).distinct())
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def forbidden_keys(documents: DataFrame, key: str, col: str, keys: list[str], depth: int = 32) -> DataFrame:
    """One row per document: key, found (the forbidden keys in it, in lower case and order), and problem: `invalid_json`, `too_deep` or null. key tells documents apart."""
    names = json_keys(documents, key, col, depth)
    told = names.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.lower("name").isin(*[k.lower() for k in keys]), F.lower("name")))).alias("found"),
        F.max(F.when(F.col("name").isNull(), F.when(F.col("level") < 0, "invalid_json").otherwise("too_deep"))).alias("problem"),
    )
    return documents.select(key).join(told.hint("merge"), key, "left").select(key, F.coalesce("found", F.array().cast("array<string>")).alias("found"), "problem")


def normalize_label_list(col: str) -> Column:
    """Comma text to trimmed labels that are not empty, in order."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def split_prompts(col: str, canonical: bool = False) -> Column:
    """Prompts of a class: lines and commas divide, unless the text is canonical and stays whole."""
    if canonical:
        return F.filter(F.array(F.trim(F.col(col))), lambda x: x != "")
    return F.filter(F.transform(F.split(F.regexp_replace(F.col(col), "\n", ","), ","), lambda x: F.trim(x)), lambda x: x != "")


#: Links of Markdown and HTML, and how targets elsewhere begin.
MARKDOWN_LINK = r"!?(?:\[[^\]]*\])\(([^)]+)\)"
HTML_LINK = r"(?:href|src)=[\"']([^\"']+)[\"']"
EXTERNAL = ("http://", "https://", "mailto:", "#", "data:")


def links(col: str) -> Column:
    """Targets of Markdown and HTML links, without titles and angle brackets."""
    found = F.concat(F.regexp_extract_all(F.col(col), F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all(F.col(col), F.lit(HTML_LINK), F.lit(1)))
    return F.transform(found, lambda x: F.btrim(F.regexp_extract(x, r"^\s*(\S*)", 1), F.lit("<>")))


def missing_links(documents: DataFrame, known: DataFrame, key: str, col: str) -> DataFrame:
    """Local link targets, without fragment and query and percent-decoded, that are not known. known: target."""
    found = documents.select(key, F.explode(links(col)).alias("link"))
    elsewhere = F.lit(False)
    for e in EXTERNAL:
        elsewhere = elsewhere | F.col("link").startswith(e)
    bare = F.regexp_replace("link", r"[?#].*$", "")
    # A plus sign stands for itself here.
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    target = found.filter(~elsewhere).select(key, decoded.alias("target")).filter("target <> ''")
    return target.join(known.select("target").distinct().hint("merge"), "target", "left_anti").groupBy(key, "target").agg(F.count(F.lit(1)).alias("n"))


def document_checks(documents: DataFrame, key: str, col: str, heading: str, forbidden: dict[str, str]) -> DataFrame:
    """Top headings outside fenced code, and the named patterns that occur though they must not."""
    c = F.regexp_replace(F.col(col), r"(?s)```.*?```|~~~.*?~~~", "")
    found = F.array_compact(F.array(*[F.when(F.col(col).rlike(p), n) for n, p in forbidden.items()]))
    return documents.select(key, F.size(F.regexp_extract_all(c, F.lit(heading), F.lit(0))).alias("headings"), F.array_join(found, ",").alias("found"))


def parse_metric_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """Text exposition lines to name, labels and value; comments and lines that do not parse are left out."""
    p = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)$"
    rows = lines.filter(~F.col(col).startswith("#") & F.col(col).rlike(p))
    part = lambda k: F.regexp_extract(F.col(col), p, k)
    others = [c for c in lines.columns if c != col]
    return rows.select(*others, part(1).alias("name"), part(2).alias("labels"), part(3).try_cast("double").alias("value")).filter("value IS NOT NULL")


def normalize_video_meta(meta: DataFrame) -> DataFrame:
    """fps from the average rate, else the real rate, else frames over duration, else 25; zero denominators count as missing."""

    def rate(c: str) -> Column:
        a, b = F.get(F.split(c, "/"), F.lit(0)).try_cast("double"), F.get(F.split(c, "/"), F.lit(1)).try_cast("double")
        r = F.when(F.col(c).contains("/"), F.when(b != 0, a / b)).otherwise(F.col(c).try_cast("double"))
        return F.when(r > 0, r)

    frames = F.when(F.col("nb_frames").rlike("^[0-9]+$"), F.col("nb_frames").try_cast("long"))
    seconds = F.col("duration").try_cast("double")
    counted = F.when((seconds > 0) & (frames > 0), frames / seconds)
    return meta.withColumns({"fps": F.coalesce(rate("avg_frame_rate"), rate("r_frame_rate"), counted, F.lit(25.0)), "frames": frames})


def duplicate_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts equal to an earlier one of their class, with its index. prompts: request_id, class_order, prompt_index, prompt."""
    first = F.min("prompt_index").over(Window.partitionBy("request_id", "class_order", "prompt"))
    return prompts.withColumn("first_index", first).filter("first_index < prompt_index")


def prompt_violations(prompts: DataFrame, classes: int = 32, per_class: int = 64, total: int = 256, characters: int = 512) -> DataFrame:
    """The first violation of each request in scan order: too many classes, then per class its size, then prompt by prompt, then the total."""
    text = prompts.withColumn("prompt", F.trim("prompt"))
    request, cls = Window.partitionBy("request_id"), Window.partitionBy("request_id", "class_order")
    first = F.min("prompt_index").over(Window.partitionBy("request_id", "class_order", "prompt"))
    p = text.withColumns({"n_classes": F.max("class_order").over(request) + 1, "n_class": F.count(F.lit(1)).over(cls), "n": F.count(F.lit(1)).over(request), "first_index": first})
    what = F.when(F.col("n_classes") > classes, F.struct(F.lit(0).alias("step"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("too_many_classes").alias("violation")))
    at = lambda step, b, name: F.struct(F.lit(step).alias("step"), F.col("class_order").cast("int").alias("a"), F.lit(b).alias("b") if isinstance(b, int) else b.cast("int").alias("b"), F.lit(name).alias("violation"))
    here = F.col("prompt_index") + 1
    what = what.when(F.col("n_class") > per_class, at(1, 0, "too_many_prompts")).when(F.col("prompt") == "", at(1, here, "empty_prompt")).when(F.length("prompt") > characters, at(1, here, "prompt_too_long"))
    what = what.when(F.col("first_index") < F.col("prompt_index"), at(1, here, "duplicate_prompt"))
    what = what.when(F.col("n") > total, F.struct(F.lit(2).alias("step"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("too_many_total").alias("violation")))
    return p.groupBy("request_id").agg(F.min(what).alias("w")).filter("w IS NOT NULL").select("request_id", "w.violation", F.col("w.a").alias("class_order"))

