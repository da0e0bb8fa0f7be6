"""Exact deduplication by skew-safe combining (DataFrame functions only).

Copies are combined in three steps, each grouping by the digest *and* the full text: inside each
input task (partial aggregation), inside salted digest groups (the salt comes from the input task, so
a text leaves a task as one row), and over the salts. A group of copies of any size therefore reaches a
task as one row per input task and salt. The verdict goes back to the rows by digest; a digest with many
rows is dealt over several tasks there.

Defined cases: null text counts as empty; rows with a null doc_id belong to their group but are kept
only if no row of the group has an id; rows that repeat both doc_id and text count in group_size and
share the verdict; texts are compared whole, however long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, spread_join, staged, text_or_empty


def normalised(name: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; only the runs that differ from one are rewritten."""
    return F.regexp_replace(text_or_empty(name), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, salts: int = 64, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    digest may be any function of the text; texts that share a digest are told apart by content.
    """
    rows = docs.select("doc_id", normalised().alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = rows.groupBy("digest", "norm", salt.alias("salt")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    # One text per digest: the digest stands for the content from here on. Otherwise the content decides again.
    by_digest = staged(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size")), "exact-groups")
    single = by_digest.filter("texts = 1").select("digest", "keep_id", "group_size", F.col("group_size").alias("rows"))
    out = spread_join(rows.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256")), single, "digest", "rows", F.xxhash64("doc_id", F.spark_partition_id()))
    clashing = by_digest.filter("texts > 1").select("digest")
    if not clashing.isEmpty():
        both = rows.join(clashing.hint("merge"), "digest").withColumn("text_sha256", F.sha2("norm", 256))
        out = out.unionByName(both.join(groups.join(clashing.hint("merge"), "digest").hint("merge"), ["digest", "norm"]).drop("norm"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The rows that `exact_groups` keeps, with all their columns. Rows equal in doc_id (null or not) and normalised text share the verdict."""
    mine, its, named = (fresh_name(docs, c) for c in ("__digest", "__kept_digest", "__kept_id"))
    kept = exact_groups(docs, salts).filter("kept").select(F.col("doc_id").alias(named), F.col("text_sha256").alias(its))
    rows = docs.withColumn(mine, F.sha2(normalised(), 256))
    same = (F.col(mine) == F.col(its)) & rows["doc_id"].eqNullSafe(F.col(named))
    return rows.join(staged(kept.distinct(), "exact-kept").hint("merge"), same, "left_semi").drop(mine)
