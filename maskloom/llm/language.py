"""Language identification by prediction by partial matching (PPM).

Each language gets a tree of byte contexts of orders 0 to 3 with escape probabilities by method C: in a
context seen n times with d distinct successors a byte seen c times costs log2((n + d) / c) bits; an
unseen one costs log2((n + d) / d) bits of escape plus its cost in the next shorter context, down to
one in 256. The statistics are frozen after training, so a text's code length in a language is a sum
over its bytes, and every context's cost is worked out once per batch at most. The language with the
shortest code wins; its score is its posterior under equal priors.

Training reads a bounded sample per language (`per_language` documents of at most `sample_bytes` bytes
together, by hash of the doc_id) of the documents that are not held out and have a doc_id and a text. A text
longer than a sixteenth of `sample_bytes` gives that much, in pieces that a hash picks from the whole text, so every language with
such a text has a sample, however long one text is. All languages together have `total_bytes`: with many of them each gets less.
Counting runs in Spark, and the model, which goes to the driver and to each task, has an entry per sampled byte at most. Scoring reads every whole text.

Defined cases: null texts and texts without a letter give `und` with score 0; if nothing can be learned, so does every text;
ties go to the language whose name sorts first; every text is scored whole, however long; null doc_ids are not held out; repeated rows are each
scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import chunks
from .common import sized_join, staged, text_or_empty

ORDER = 3

#: Stands before each text, so that its first bytes have contexts too.
PAD = "\n" * ORDER

SLOTS_BITS = 21

#: Texts that the sample of a language can hold at least, as far as its bytes go.
STRETCHES = 16

#: Pieces of the bytes that one text gives at most, if it is longer.
PIECES = 16

#: Slices of a language in which its sample is sought first.
SLICES = 64


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def byte_keys(buf: np.ndarray) -> np.ndarray:
    """The four bytes that end at each byte from the fourth on, as one number."""
    b = buf.astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


def _inner(offs: np.ndarray, n: int) -> np.ndarray:
    """Which of the n - 3 keys end inside a text, not across the border of two."""
    ok = np.ones(max(n - ORDER, 0), bool)
    for k in range(ORDER):
        at = offs[1:-1] - ORDER + k
        ok[at[at < len(ok)]] = False
    return ok


def _count(batches):
    for batch in batches:
        for first, _, buf, offs in chunks(batch.column("text")):
            keys, counts = np.unique(byte_keys(buf)[_inner(offs, len(buf))], return_counts=True)
            lang = batch.column("lang")[first].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "key", "n"])


def training_counts(docs: DataFrame, per_language: int, sample_bytes: int) -> DataFrame:
    """lang, key (three bytes of context and their successor), n over the sample."""
    known = docs.filter(~held_out() & (F.octet_length("text") > 0) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    quota = max(sample_bytes // STRETCHES, 1)
    keys = known.select("doc_id", "lang", F.least(F.octet_length("text"), F.lit(quota)).alias("bytes"), F.xxhash64("doc_id").alias("place"))
    # First within slices of a language, so that no task ranks a whole language: the second window sees at most
    # SLICES * per_language rows (id and length) of one.
    part = Window.partitionBy("lang", F.pmod("place", F.lit(SLICES))).orderBy("place", "doc_id")
    keys = keys.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= per_language)
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    ids = keys.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    ids = ids.withColumn("sum", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ids = ids.withColumn("take", F.least("bytes", sample_bytes - F.col("sum") + F.col("bytes")).cast("int")).filter("take > 0")
    ids = staged(ids.groupBy("doc_id", "lang").agg(F.max("take").alias("take")), "sample")
    # One language in a batch: counted text by text within a sorted partition.
    sample = sized_join(known.select("doc_id", "lang", F.col("text").cast("binary").alias("text")), ids, ["doc_id", "lang"], "inner")
    return counted_stretches(sample, quota)


def counted_stretches(sample: DataFrame, quota: int) -> DataFrame:
    """lang, key, n over `take` bytes of each text (binary): whole texts, and of longer ones pieces that a hash picks from the whole text.

    A piece is counted with the bytes before it as its first contexts, so a text's pieces say what the whole text would.
    """
    size = max(quota // PIECES, 1)
    n = F.greatest(F.ceil(F.octet_length("text") / size).cast("int"), F.lit(1))
    order = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64("doc_id", i).alias("place"), i.alias("i")))
    partly = sample.filter(F.col("take") < F.octet_length("text"))
    picked = partly.select("doc_id", "lang", "text", "take", F.posexplode(F.slice(F.sort_array(order), F.lit(1), F.ceil(F.col("take") / size).cast("int"))).alias("k", "piece"))
    start = F.col("piece.i") * size
    much = F.least(F.lit(size), F.col("take") - F.col("k") * size)
    before = F.when(start >= ORDER, F.substring("text", start - ORDER + 1, F.lit(ORDER))).otherwise(F.concat(F.substring(F.lit(PAD).cast("binary"), start + 1, F.lit(ORDER)), F.substring("text", F.lit(1), start)))
    pieces = picked.select("doc_id", "lang", F.concat(before, F.substring("text", start + 1, much)).alias("text"))
    whole = sample.filter(F.col("take") >= F.octet_length("text")).select("doc_id", "lang", F.concat(F.lit(PAD).cast("binary"), F.col("text")).alias("text"))
    sample = whole.unionByName(pieces)
    return sample.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part")).applyInArrow(_count_group, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _count_group(group: pa.Table) -> pa.Table:
    rows = list(_count(group.combine_chunks().to_batches()))
    return pa.Table.from_batches(rows, pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())]))


class ContextTree:
    """Frozen statistics of one language, by order: sorted contexts and successors with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []
        for k in range(ORDER + 1):
            part, at = np.unique(keys & np.uint32((1 << (8 * (k + 1))) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(part))
            contexts, at = np.unique(part >> np.uint32(8), return_inverse=True)
            self.orders.append((part, n, contexts, np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each key after the bytes before it."""
        p = np.full(len(keys), 1 / 256)
        for k, (parts, n, contexts, total, distinct) in enumerate(self.orders):
            part = keys & np.uint32((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(parts, part), len(parts) - 1)
            here = np.where(parts[at] == part, n[at], 0.0)
            ctx = part >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            known = contexts[at] == ctx
            whole = total[at] + distinct[at]
            p = np.where(known, np.where(here > 0, here, distinct[at] * p) / whole, p)
        return -np.log2(p)


class CodeLengths:
    """Bits of all languages per key: a hashed table of the keys met in training, the trees for the rest."""

    def __init__(self, trees: list[ContextTree], keys: np.ndarray):
        self.trees, self.keys = trees, keys
        self.table = [np.append(t.bits(keys), 0).astype(np.float32) for t in trees]
        self.slots = np.zeros(1 << SLOTS_BITS, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS_BITS)

    def sums(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text of a chunk (rows) in each language (columns)."""
        keys, inner = byte_keys(buf), _inner(offs, len(buf))
        if not len(keys):  # one empty text alone
            return np.zeros((len(offs) - 1, len(self.trees)))
        at = self.slots[self.slot(keys)]
        missed = np.flatnonzero((self.keys[at] != keys) & inner)
        at[~inner] = len(self.keys)
        rare, back = np.unique(keys[missed], return_inverse=True)
        begin = np.minimum(offs[:-1], len(keys) - 1)
        out = np.empty((len(offs) - 1, len(self.trees)))
        for k, tree in enumerate(self.trees):
            bits = self.table[k][at].astype(np.float64)
            bits[missed] = tree.bits(rare)[back]
            out[:, k] = np.add.reduceat(bits, begin)
        return out


def _score(model, languages):
    def run(batches):
        lengths = CodeLengths(*model.value)
        for batch in batches:
            best, score = [np.zeros(0, int)], [np.zeros(0)]
            for _, _, buf, offs in chunks(batch.column("text")):
                bits = lengths.sums(buf, offs)
                bits -= bits.min(axis=1, keepdims=True)
                best.append(bits.argmin(axis=1))
                score.append(1 / np.exp2(-np.minimum(bits, 1000)).sum(axis=1))
            names = pa.array(languages, pa.string()).take(pa.array(np.concatenate(best)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("letters"), names, pa.array(np.concatenate(score))], ["doc_id", "held_out", "letters", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_language: int = 2000, sample_bytes: int = 16 << 20, total_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", "lang", "text")
    n_languages = rows.filter("lang IS NOT NULL").select("lang").distinct().count()
    # Bounded by the sample: at most one row per byte of it.
    counts = training_counts(rows, per_language, min(sample_bytes, max(total_bytes // max(n_languages, 1), 1))).toPandas()
    languages = sorted(counts["lang"].unique())
    flags = [held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")]
    if not languages:
        return rows.select("doc_id", flags[0], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    trees = []
    for name in languages:
        c = counts[counts["lang"] == name]
        trees.append(ContextTree(c["key"].to_numpy().astype(np.uint32), c["n"].to_numpy().astype(float)))
    keys = np.unique(counts["key"].to_numpy().astype(np.uint32))
    model = docs.sparkSession.sparkContext.broadcast((trees, keys))
    scored = rows.select("doc_id", *flags, F.concat(F.lit(PAD), text_or_empty()).alias("text")).mapInArrow(_score(model, languages), "doc_id long, held_out boolean, letters boolean, lang_pred string, score double")
    return scored.select("doc_id", "held_out", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
