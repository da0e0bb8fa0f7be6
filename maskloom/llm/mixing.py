"""Mixing sources to target weights under a time-varying curriculum.

Sources, ordered by code point with null last, weigh 3, 1, 2, repeating. They share `budget` times all
words; a source stops at `max_epochs` times its own words and the excess is shared out by weight among
the others until none is above: with x = max_epochs * size / weight, that is one level L with target
min(weight * L, max_epochs * size), found by one pass over the sources in order of x.

Inside a source, documents stand in hash order, and running totals of their words (bucket totals
first, then inside a bucket, so no task sees a whole source) place them on the source's demand line,
which is walked once per epoch. A pass over a document is taken if its middle is within the target.
Each source's weight over training time is piecewise linear; its integral is the cumulative demand,
and inverting that turns the document's place on the demand line into a training position in [0, 1).
Range-sorting by position gives the curriculum.

Defined cases: null text has no words; a document without words takes nothing; null is a source of its
own; rows that repeat a doc_id are ordered by size and each is placed; rows without doc_id are placed by a hash of their text; words are counted in whole texts, however
long; an empty table gives an empty result; other columns pass through `curriculum`. One row per source is ranked in
one task: a million sources take some hundred megabytes there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_raw_words, staged

#: Rows of a bucket of a source, at most about.
BUCKET_ROWS = 20_000

#: Weights by order of the source, repeating.
WEIGHTS = (3, 1, 2)

#: Weight schedules by order of the source, repeating: (time, relative weight) knots, linear between them.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, budget=(3, 2), max_epochs: int = 2, weights=WEIGHTS) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds source_ order, weight and target. Works on one row per source."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.col("source_order"), F.lit(len(weights))))
    s = sizes.withColumn("source_order", order).withColumn("weight", weight)
    fills = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") * F.lit(1.0) / F.col("weight"), "source_order")
    before, onward = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs, "rest": F.sum("weight").over(onward)})
    # The level, were all sources before this one full: an exact numerator and denominator, divided once.
    num, den = F.col("total") * budget[0] - F.col("capped") * budget[1], F.col("rest") * budget[1]
    full = F.col("weight") * num >= F.col("source_size") * max_epochs * den
    s = s.withColumns({"num": num, "den": den, "full": full})
    level = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") * F.lit(1.0) / F.col("weight")).alias("x"), "source_order", "num", "den"))).over(everything)
    s = s.withColumn("level", level)
    target = F.when(F.col("full"), (F.col("source_size") * max_epochs).cast("double")).otherwise((F.col("weight") * F.col("level.num")).cast("double") / F.col("level.den").cast("double"))
    return s.select(*sizes.columns, "source_order", "weight", target.alias("target"))


def position_of(demand: Column, order: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source with this schedule has consumed the share `demand` (0 to 1) of its target."""

    def inverse(knots) -> Column:
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
        out, done = F.lit(0.0), 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            # Inside the segment: w0 u + slope u^2 / 2 = what remains; the stable form of the quadratic's root.
            rest, slope = F.greatest(demand * area - done, F.lit(0.0)), (w1 - w0) / (t1 - t0)
            root = rest * 2 / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))))
            out = F.when(demand * area >= done, F.least(root + t0, F.lit(t1))).otherwise(out)
            done += (t1 - t0) * (w0 + w1) / 2
        return out

    at = F.pmod(order, F.lit(len(schedules)))
    out = inverse(schedules[-1])
    for k in reversed(range(len(schedules) - 1)):
        out = F.when(at == k, inverse(schedules[k])).otherwise(out)
    return out


def mix(docs: DataFrame, budget=(3, 2), max_epochs: int = 2, weights=WEIGHTS, schedules=SCHEDULES, prefix: int | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, positions (one per copy).

    prefix: hex digits of the hash that make a bucket, by default as many as keep a bucket of the largest possible
    source at some BUCKET_ROWS rows. carry: adds the whole input row as a struct, `row`.
    """
    if prefix is None:
        rows, prefix = docs.count(), 2
        while rows > BUCKET_ROWS << (4 * prefix):
            prefix += 1
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", *row, n_raw_words().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), "text"), F.lit("")).cast("binary")).alias("place"))
    # A key without null, so that the sort by bucket and the join below share one partitioning.
    rows = rows.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")), "bucket": F.substring("place", 1, prefix)})
    totals = rows.groupBy("key", "bucket").agg(F.min("source").alias("source"), F.sum("size").alias("bucket_size"))
    order = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)).alias("start"))
    sizes = totals.groupBy("key").agg(F.min("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, budget, max_epochs, weights)
    plan = starts.join(targets.drop("source").hint("shuffle_hash"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.join(plan.hint("shuffle_hash"), ["key", "bucket"])
    first = F.col("start") + F.col("offset")
    passes = F.filter(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda k: (F.col("size") > 0) & (k * F.col("source_size") + first + F.col("size") / 2 <= F.col("target")))
    both = both.withColumn("passes", passes).withColumn("copies", F.size("passes"))
    demand = F.transform("passes", lambda k: (k * F.col("source_size") + first) / F.col("target"))
    both = both.withColumn("positions", F.transform(demand, lambda d: position_of(d, F.col("source_order"), schedules)))
    return both.select("doc_id", "source", *["row"] * carry, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document, as mix gives them, range-sorted by first training position; documents that take no part stand last."""
    first = F.get("positions", F.lit(0))
    # The sort looks at its input twice; it is written once.
    return staged(mix(docs, **options).withColumn("position", first), "mix").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each taken copy as a row with all columns of docs, range-sorted by training position.

    Written out, the order of files and of rows in them is the order of training.
    """
    out = mix(docs, carry=True, **options).select("row", F.posexplode("positions").alias("epoch", "position"))
    return out.orderBy("position", "row.doc_id", "epoch").select("row.*")
