"""Near-duplicates by MinHash: universal hash minima, banding, signature verification, full sets, components.

1. Each document's set of distinct word shingles (64-bit hashes) gives `bands x rows` minima of
   a*x + b modulo 2**64. Documents with equal sets are one class, carried on by its smallest doc_id.
2. Classes that agree in all rows of a band share a bucket. With 24 bands of 4 rows a pair at
   similarity 0.8 shares none with probability (1 - 0.8**4)**24, about 3 in a million.
3. Every member of a bucket is paired with the bucket's least member only. Pairs whose signatures agree
   too rarely are dropped, the rest are confirmed on their full shingle sets, and components follow.
   A leader of many members is sent once to each task that its members are dealt to.
4. Buckets that still hold several components are searched completely, across components only. Where few members
   are outside the largest component, these are compared with all others, block by block, in place.
5. Members of buckets with over a thousand outside it are banded again by a second family of 72 bands of 8 rows, which
   misses a pair at 0.8 with probability 1.8 in a million and parts all that is merely alike; steps 3 and 4 follow on the
   new buckets, where blocks of those outside the largest component meet each other as well.

So no link is lost to the leaders, no pairs are emitted, and nothing is capped: at most one link per member and
component leaves a task. The signature check loses a pair at similarity 0.8 with probability 1.1e-7.

Links: 100 * intersection >= 80 * union, with integers, on full sets.

Defined cases: null or wordless texts have an empty set, are their own component and link with nothing;
texts of fewer words than a shingle have one; texts are read whole, however long; rows that share a doc_id are one node, so their links
join; rows with a null doc_id link with nothing and are kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .batches import U64, chunks, grams, mix, words
from .common import is_small, sized_join, spread_join, staged, text_or_empty
from .graph import components

SHINGLE, BANDS, ROWS = 4, 24, 4

#: A second family of minima for the members of large buckets, with longer keys.
LONG_BANDS, LONG_ROWS = 72, 8

#: Members of a side of a cell of a bucket, about, and blocks outside its largest component that are compared as they are.
BLOCK, DIRECT = 256, 4

#: Bytes of text whose words are held as arrays at once, and rows whose sets are.
PIECE, SETS = 1 << 18, 1024

_MINIMA = BANDS * ROWS + LONG_BANDS * LONG_ROWS
_A = mix(np.arange(1, _MINIMA + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_B = mix(np.arange(1, _MINIMA + 1, dtype=U64) * U64(0xA24BAED4963EE407))


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first, end, buf, offs in chunks(column, PIECE):
        _, _, h, start = words(buf, offs, folded=True)
        g = grams(h, k)
        for row in range(end - first):
            a, b = start[row], start[row + 1]
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                yield mix(grams(h[a:b], b - a) + U64(b - a))
            else:
                yield h[:0]


def signature(shingles: np.ndarray, first: int = 0, n: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of n universal hashes, from hash `first` on, over a set: its upper 32 bits."""
    a, b, least = _A[first : first + n, None], _B[first : first + n, None], np.full(n, ~U64(0), U64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[None, at : at + 4096] * a + b).min(axis=1))
    return (least >> U64(32)).astype(np.uint32)


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            yield _signed(batch, k)

    return run


def _signed(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    n, sets, sigs = [], [], []
    for s in shingle_sets(batch.column("text"), k):
        n.append(len(s))
        sets.append(set_name(s))
        sigs.append(signature(s).tobytes() if len(s) else b"")
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_id", "sig"])


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        key = band_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1))
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], ["bucket", "node"])


def least_agreement(percent: int) -> int:
    """Minima that a pair at the threshold shares but for about one case in nine million at 0.8: five and a half deviations below the mean."""
    p, n = percent / 100, BANDS * ROWS
    return int(p * n - 5.5 * (p * (1 - p) * n) ** 0.5)


def _agreeing(percent: int):
    least = least_agreement(percent)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                keep = pa.array((a == b).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def _confirm(percent: int, k: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, last = [], (None, None)
            left, right = shingle_sets(batch.column("text_a"), k), batch.column("text_b")
            for row, x in enumerate(left):
                text = right[row].as_buffer()
                if last[0] is None or not last[0].equals(text):  # runs of the same leader are common
                    last = (text, next(shingle_sets(right.slice(row, 1), k)))
                y = last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["u", "v"])

    return run


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket of each band of each signature (rows of uint32 minima)."""
    sig = sig.reshape(len(sig), bands, rows).astype(U64)
    key = np.zeros((len(sig), bands), U64) + np.arange(bands, dtype=U64)
    for r in range(rows):
        key = mix(key * U64(0x9FB21C651E98DF25) + sig[:, :, r])
    return key.view(np.int64)


def _long_bands(k: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = [signature(s, BANDS * ROWS, LONG_BANDS * LONG_ROWS) for s in shingle_sets(batch.column("text"), k)]
            key = band_keys(np.stack(sigs), LONG_BANDS, LONG_ROWS)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), LONG_BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node)], ["bucket", "node"])

    return run


def _across(percent: int, short: bool = True):
    """Links across components in one cell of a bucket: at most one per member and component, none between rows joined already.

    Rows of block i are compared with those of other blocks and, if i = j, with each other: by signature first, then by the sets' 64-bit hashes, as in the confirmation on full sets afterwards, so what joins components here is not
    refused there. With short buckets a pair is judged in the first one that it shares only.
    """
    least = least_agreement(percent)

    def run(cell: pa.Table) -> pa.Table:
        column = lambda c: cell.column(c).combine_chunks()
        sig = np.frombuffer(b"".join(column("sig").to_pylist()), np.uint32).reshape(cell.num_rows, -1)
        sets = [np.frombuffer(x, U64) for x in column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        node, comp, block = (column(c).to_numpy().copy() for c in ("node", "comp", "block"))
        bucket, i, j = (cell.column(c)[0].as_py() for c in ("bucket", "i", "j"))
        keys, out_a, out_b = band_keys(sig), [], []
        for r in np.flatnonzero(block == i):
            c = np.flatnonzero((comp != comp[r]) & ((block != i) | ((i == j) & (node > node[r]))))
            # Sets within reach of the threshold differ in size by so much at most.
            c = c[(100 * sizes[c] >= percent * sizes[r]) & (percent * sizes[c] <= 100 * sizes[r])]
            c = c[(sig[c] == sig[r]).sum(axis=1) >= least]
            if short and len(c):
                c = c[keys[r][(keys[c] == keys[r]).argmax(axis=1)] == bucket]
            if not len(c):
                continue
            x, ends = sets[r], np.cumsum(sizes[c])
            y = np.concatenate([sets[k] for k in c])
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = np.diff(np.concatenate([[0], np.cumsum(x[at] == y)[ends - 1]]))
            for k in c[100 * both >= percent * (len(x) + sizes[c] - both)].tolist():
                if comp[k] != comp[r]:
                    out_a.append(max(node[k], node[r]))
                    out_b.append(min(node[k], node[r]))
                    comp[comp == comp[k]] = comp[r]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _hashes(k: int):
    """The sets of texts, with what names them: a doc_id can have several texts."""

    def run(batches):
        for batch in (b.slice(lo, SETS) for b in batches for lo in range(0, b.num_rows, SETS)):
            sets = list(shingle_sets(batch.column("text"), k))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(set_name, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set_id", "hashes"])

    return run


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the documents that are nodes; all documents where the nodes are too many to be sent round."""
    nodes = staged(nodes.distinct(), "nodes")
    texts = docs.select(F.col("doc_id").alias("node"), text_or_empty().alias("text"))
    return texts.join(F.broadcast(nodes), "node", "left_semi") if is_small(nodes) else texts


def beside(pairs: DataFrame, held: DataFrame, name: str) -> DataFrame:
    """pairs (a, b) with name_a and name_b, what held (node, name) has of both. pairs should be staged.

    A leader b of many pairs is sent once to each of the tasks that its pairs are dealt to.
    """
    of = lambda c: held.select(F.col("node").alias(c), F.col(name).alias(f"{name}_{c}")).hint("merge")
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(of("a"), "a")
    if (counts.agg(F.max("n")).first()[0] or 0) <= common.HOT:
        both = both.join(of("b"), "b")
    else:
        counts = staged(counts, "leader-counts")
        both = spread_join(both, counts.join(of("b"), "b"), "b", "n", "a", counts=counts, most=common.HOT)
    return both.select("a", "b", f"{name}_a", f"{name}_b")


def confirmed_links(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, as links (u, v), staged. pairs should be staged."""
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs)
    return staged(beside(pairs, texts, "text").mapInArrow(_confirm(percent, k), "u long, v long"), "links")


def with_components(buckets: DataFrame, stars: DataFrame) -> DataFrame:
    """bucket, node and comp, the component of the node."""
    return buckets.join(stars.withColumnRenamed("u", "node").hint("merge"), "node", "left").select("bucket", "node", F.coalesce("v", "node").alias("comp"))


def leader_links(named: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Confirmed links of the members of a bucket with its least member, where their components differ. named: bucket, node, comp."""
    leaders = named.groupBy("bucket").agg(F.min(F.struct("node", "comp")).alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = spread_join(named, staged(leaders, "leaders"), "bucket", "n", "node").filter("comp <> leader.comp").select(F.col("node").alias("a"), F.col("leader.node").alias("b"))
    likely = beside(staged(pairs.distinct(), "pairs"), classes, "sig").mapInArrow(_agreeing(percent), "a long, b long")
    return confirmed_links(staged(likely, "likely-pairs"), docs, percent, k)


def mixed_rows(named: DataFrame) -> DataFrame:
    """Members of buckets that hold several components. rest: blocks of those outside the largest component; top: blocks of it; largest: whether a row is in it."""
    per = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    per = per.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = staged(per.select("bucket", "n", F.col("most.comp").alias("main"), blocks(F.col("n") - F.col("most.m")).alias("rest"), blocks(F.col("most.m")).alias("top")), "mixed")
    return staged(spread_join(named, mixed, "bucket", "n", "node").withColumn("largest", F.col("comp") == F.col("main")).drop("main"), "open")


def links_across(rows: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, k: int, short: bool) -> DataFrame:
    """Confirmed links across components of mixed buckets. Every pair outside the largest component, and every one with it, meets in a cell.

    Blocks of the rest are numbered from 0, those of the largest component go on from there; cell (i, j) holds block i
    of the rest and block j. So a row of the largest component is sent `rest` times.
    """
    block = F.pmod(F.xxhash64("node"), F.when(F.col("largest"), F.col("top")).otherwise(F.col("rest"))).cast("int")
    one = (F.col("rest") == 1) & (F.col("top") == 1)
    cell = lambda i, j, own: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), own.cast("int").alias("block"))
    # Two small sides share the cell (0, 0).
    of_top = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: cell(i, F.when(one, 0).otherwise(F.col("rest") + block), F.when(one, -1).otherwise(F.col("rest") + block)))
    as_first = F.transform(F.sequence(block, F.when(one, 0).otherwise(F.col("rest") + F.col("top") - 1)), lambda j: cell(block, j, block))
    as_second = F.when(block > 0, F.transform(F.sequence(F.lit(0), block - 1), lambda i: cell(i, block, block))).otherwise(F.array().cast("array<struct<i:int,j:int,block:int>>"))
    cells = F.when(F.col("largest"), of_top).otherwise(F.concat(as_first, as_second))
    # Of the texts of a doc_id each meets the signature of its own set.
    hashes = texts_of(rows.select("node"), docs).mapInArrow(_hashes(k), "node long, set_id binary, hashes binary").groupBy("node", "set_id").agg(F.first("hashes").alias("hashes"))
    held = classes.select("node", "set_id", "sig").join(hashes.hint("merge"), ["node", "set_id"])
    dealt = rows.distinct().join(held.hint("merge"), "node").select("bucket", "node", "comp", "sig", "hashes", F.inline(cells))
    found = dealt.groupBy("bucket", "i", "j").applyInArrow(_across(percent, short), "a long, b long").distinct()
    return confirmed_links(staged(found, "pairs-across"), docs, percent, k)


def joined(stars: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more links."""
    return stars if more.isEmpty() else components(stars.unionByName(more))


def with_long_bands(large: DataFrame, stars: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """The components after the members of large mixed buckets have met again, in buckets of long bands. large: node."""
    texts = texts_of(large.select("node"), docs)
    long_buckets = staged(texts.mapInArrow(_long_bands(k), "bucket long, node long").distinct(), "long-buckets")
    stars = joined(stars, leader_links(with_components(long_buckets, stars), classes, docs, percent, k))
    return joined(stars, links_across(mixed_rows(with_components(long_buckets, stars)), classes, docs, percent, k, False))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, direct: float | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    direct: blocks of rows outside a mixed bucket's largest component up to which all its pairs are compared (DIRECT by default);
    beyond it they meet in long bands. With math.inf every bucket is searched completely, at a cost that grows with
    the square of those rows.
    """
    direct = DIRECT if direct is None else direct
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    signed = staged(rows.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, set_id binary, sig binary"), "signatures")
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(linkable.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "classes")
    buckets = staged(classes.select("node", "sig").mapInArrow(_bands, "bucket long, node long"), "buckets")

    # Nodes of one doc_id with several sets are joined by the id itself; copies of a set by their class.
    links = leader_links(buckets.withColumn("comp", F.col("node")), classes, rows, percent, shingle)
    stars = components(links)
    open_rows = mixed_rows(with_components(buckets, stars))
    if not open_rows.isEmpty():
        stars = joined(stars, links_across(open_rows.filter(F.col("rest") <= direct), classes, rows, percent, shingle, True))
    large = open_rows.filter(F.col("rest") > direct)
    if not large.isEmpty():
        stars = with_long_bands(large, stars, classes, rows, percent, shingle)

    member = spread_join(linkable.select("doc_id", "set_id"), classes.select("set_id", "node", "n"), "set_id", "n", "doc_id").select("doc_id", "node")
    member = member.join(stars.withColumnRenamed("u", "node").hint("merge"), "node", "left").select("doc_id", F.coalesce("v", "node").alias("c"))
    member = member.groupBy("doc_id").agg(F.min("c").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(member.hint("merge"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, with all columns; rows of one doc_id stay or go together."""
    gone = staged(near_duplicates(docs, percent, shingle).filter("NOT kept").select("doc_id").distinct(), "near-copies")
    return sized_join(docs, gone, ["doc_id"], "left_anti")
