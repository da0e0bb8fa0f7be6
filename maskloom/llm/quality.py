"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two generative models over hashed n-grams are counted: `raw` over all documents, `target` over those that
are labelled good (quality 1 and not toxic). Features are word uni- and bigrams, and uni-, bi- and
trigrams of word shapes (case, digits, punctuation, length, repetition of words just seen), each hashed
into `BINS` bins of its own. A document's log importance weight is the sum over its n-grams of
log p_target - log p_raw. Adding Gumbel noise (from a hash of the doc_id, so reruns agree) and keeping
the k largest sums draws k documents without replacement in proportion to their weights.

k is by default the share of labelled documents with quality 1 of all documents, whatever the number of labels;
`margin` adds standard errors of that share.
The k-th largest key is found exactly, by rounds that count the keys of a shrinking bracket in bins; no task
ranks more than the few thousand keys of the last bracket.

Defined cases: null or wordless texts have weight 0; documents without a label count in `raw` only;
labels that repeat a doc_id count with their worst verdict; without any label everything is kept; equal keys
are ranked by doc_id; rows that repeat doc_id and text share the verdict; texts are read whole, however long; an empty table gives an empty result; other columns pass through `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import U64, chunks, grams, mix, words
from .common import sized_join, staged, text_or_empty, without_rows

BINS = 1 << 15
VIEWS = 5

_UPPER, _LOWER, _DIGIT = np.zeros(256, np.int32), np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_LOWER[128:256] = 1
_DIGIT[48:58] = 1


def shapes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A small code per word: case, digits, punctuation, length, and whether one of the four words before it in its text is the same."""
    total = np.zeros(len(buf) + 1, np.int32)
    count = []
    for table in (_UPPER, _LOWER, _DIGIT):
        np.cumsum(table[buf], out=total[1:])
        count.append(total[e] - total[s])
    upper, lower, digit = count
    n = (e - s).astype(np.int32)
    other = n - upper - lower - digit
    code = np.minimum(upper, 2) * 3 + np.minimum(lower, 2)
    code = code * 2 + (digit > 0)
    code = code * 4 + np.minimum(other, 3)
    code = code * 5 + np.searchsorted([3, 6, 10, 16], n, "right")
    again = np.zeros(len(h), np.int32)
    for back in range(1, min(5, len(h))):
        again[back:] |= ((h[back:] == h[:-back]) & (row[back:] == row[:-back])) << (back > 1)
    return (code * 4 + again).astype(U64)


def features(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view: the bin of every n-gram, and the row of the chunk that it is in."""
    s, e, h, first = words(buf, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shape = mix(shapes(buf, s, e, h, row) + U64(1))
    out = []
    for view, (x, k) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3))):
        g, last = grams(x, k), row[k - 1 :]
        inside = row[: len(g)] == last
        out.append(((g[inside] % U64(BINS)).astype(np.int64) + view * BINS, last[inside]))
    return out


def _counts(batches):
    raw, target = np.zeros(BINS * VIEWS, np.int64), np.zeros(BINS * VIEWS, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for first, _, buf, offs in chunks(batch.column("text")):
            for bins, row in features(buf, offs):
                raw += np.bincount(bins, minlength=len(raw))
                target += np.bincount(bins[good[first + row]], minlength=len(raw))
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bin", "raw", "target"])


def _weigh(ratio):
    def run(batches):
        table = ratio.value
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for first, end, buf, offs in chunks(batch.column("text")):
                for bins, row in features(buf, offs):
                    weight[first:end] += np.bincount(row, table[bins], end - first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(weight)], ["doc_id", "key", "log_weight"])

    return run


def log_ratio(docs: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw per bin; docs: text, good. The driver sees BINS x VIEWS sums."""
    counted = docs.mapInArrow(_counts, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BINS * VIEWS), np.zeros(BINS * VIEWS)
    raw[counted["bin"]], target[counted["bin"]] = counted["raw"], counted["target"]
    out = []
    for view in range(VIEWS):
        r, t = (x[view * BINS : (view + 1) * BINS] + smoothing for x in (raw, target))
        out.append(np.log(t / t.sum()) - np.log(r / r.sum()))
    return np.concatenate(out)


def kth_largest(df: DataFrame, column: str, k: int, few: int = 4096) -> tuple[object, int]:
    """The k-th largest value of a column without nulls, and how many rows are larger; 1 <= k <= rows.

    Each round counts the rows of a bracket in a thousand bins and goes on with the bin that holds the k-th;
    a bracket of few rows, or of one value, is settled. The driver sees the bins, and `few` values at most.
    """
    bins, above, inside = 1024, 0, df.select(F.col(column).alias("x"))
    lo, hi, n = inside.agg(F.min("x"), F.max("x"), F.count("x")).first()
    while lo < hi and n > few:
        place = F.least(F.floor((F.col("x") - lo) / (F.lit(hi) - lo) * bins).cast("int"), F.lit(bins - 1))
        counted = inside.filter(F.col("x").between(lo, hi)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(counted, key=lambda r: -r["lo"]):
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    if lo == hi:
        return lo, above
    values = sorted((r["x"] for r in inside.filter(F.col("x").between(lo, hi)).collect()), reverse=True)
    value = values[k - above - 1]
    return value, above + values.index(value)


def descending(ids: str) -> Column:
    """Larger for smaller ids, and largest for null."""
    return F.when(F.col(ids).isNull(), F.lit(str(1 << 63)).cast("decimal(20)")).otherwise(-F.col(ids).cast("decimal(20)"))


def top_k(df: DataFrame, column: str, k: int, ties: str = "doc_id") -> DataFrame:
    """Adds `selected`: whether the row is among the k largest by column, equal ones by the smallest `ties` (null first).

    Rows equal in both share the verdict, so repeated rows at the k-th place all stay. df should be staged.
    """
    n = df.count()
    if k >= n:
        return df.withColumn("selected", F.lit(True))
    if k <= 0:
        return df.withColumn("selected", F.lit(False))
    value, above = kth_largest(df, column, k)
    place = descending(ties)
    tied = df.filter(F.col(column) == value).select(place.alias("place"))
    if tied.count() <= k - above:
        return df.withColumn("selected", F.col(column) >= value)
    last, _ = kth_largest(tied, "place", k - above)
    return df.withColumn("selected", (F.col(column) > value) | ((F.col(column) == value) & (place >= F.lit(last))))


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, margin: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """One row per document: doc_id, key (of the row), log_weight, gumbel_key, selected."""
    verdicts = staged(labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")), "verdicts")
    good = verdicts.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id", F.lit(True).alias("good"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), text_or_empty().alias("text"))
    n_good = good.count()
    marked = sized_join(rows, good, ["doc_id"], "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(marked) if n_good else np.zeros(BINS * VIEWS))
    weighed = rows.mapInArrow(_weigh(ratio), "doc_id long, key long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("key", F.lit(8)), 11) + 0.5) / F.lit(float(1 << 53))
    weighed = staged(weighed.withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(uniform))), "weights")
    if k is None:
        share, m = verdicts.agg(F.avg(F.col("quality").cast("double")), F.count("quality")).first()
        k = weighed.count() if not m else int(np.ceil(weighed.count() * min(1.0, share + margin * (share * (1 - share) / m) ** 0.5)))
    return top_k(weighed, "gumbel_key", k)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the sample keeps, with all columns. Rows equal in doc_id and text share the verdict."""
    return without_rows(docs, importance_sample(docs, labels, **options).filter("NOT selected").select("doc_id", "key"), "rejected")
