"""Substring deduplication over a De Bruijn graph of tokens.

Edges are the windows of `WINDOW` words, from the node of their first words to that of their last. An
edge met before (smaller doc_id, or the same document further left) is a repeat, and its words go.

1. Paths inside partitions. The least 8-word gram of a window names the partition that its edge belongs
   to, wherever it stands. Consecutive edges of one partition are one path piece with a content hash; a
   piece without a second occurrence of its gram is not repeated, and its edges never move one by one.
   Within an input batch, occurrences of a piece after the first are settled at once.
2. Where all occurrences of a gram carry the same words the piece does not branch, and every occurrence
   but the first repeats it. Where they differ, the first occurrence of each variant is cut into its
   single edges, which are matched one by one. Pieces of a gram that is common everywhere are cut at once: a first
   pass counts grams, and a partition is named by the whole window then, so no common gram makes a task of its own.
3. Compaction. A repeated piece whose predecessor ends where it begins, in the document and in the
   source of the repeat alike, continues that path: joins of pieces with their predecessors find the heads,
   and pieces are compacted into long spans from head to head.
4. Verification. Every span and the span at its source coordinates are read from the texts and their
   words compared by a 128-bit digest; only equal ones count.

Defined cases: null text has no words; texts under 20 words keep all; rows of one doc_id are one document, in
the order of a hash of their texts; rows that repeat doc_id and text are the same place, so both keep what the first
keeps; rows with a null doc_id neither repeat nor are repeated; texts are read whole, however long; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import U64, chunks, flat, grams, mix, powers, words
from .common import sized_join, spread_join, staged, text_or_empty
from .suffixes import keyed, of_keys, sliding_min

WINDOW, GRAM = 20, 8

#: Open pieces of a gram from which on they are cut into edges at once.
CROWD = 20_000

PIECES = "settled boolean, part long, content long, key long, doc_id long, s int, n int, okey long, os int, crowded boolean"
EDGES = "settled boolean, part long, content long, key long, doc_id long, s int, okey long, os int"


def pieces_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, first word, number of edges, gram, content hash of each path piece. h: word hashes; first: word offsets of the rows."""
    count = len(h) - WINDOW + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    g = grams(h, GRAM)
    low = U64((1 << 24) - 1)
    # Place in the low bits: of equal grams the leftmost is taken, so no edge occurs twice in a piece.
    least = sliding_min((g & ~low) | (np.arange(len(g), dtype=U64) & low), WINDOW - GRAM + 1)
    starts = np.arange(count)
    place = starts + ((least.astype(np.int64) - starts) & int(low))
    row = np.searchsorted(first, starts, "right") - 1
    inside = starts + WINDOW <= first[row + 1]
    change = np.ones(count, bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    s = np.flatnonzero(change)
    e = np.append(s[1:], count)
    s, e = s[inside[s]], e[inside[s]]
    return row[s], s - first[row[s]], e - s, mix(g[place[s]]), span_hashes(h, s, e + WINDOW - 1)


def span_hashes(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the words s to e of each span, end exclusive."""
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(len(h), True), out=total[1:])
    return mix((total[e] - total[s]) * powers(len(h) + 1, False)[s] + (e - s).astype(U64))


def settle(groups: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether an earlier row of the batch has the same group, and the first row of the group."""
    at = np.lexsort([*order[::-1], *groups])
    begin = np.ones(len(at), bool)
    begin[1:] = np.any([g[at][1:] != g[at][:-1] for g in groups], axis=0)
    first = np.empty(len(at), np.int64)
    first[at] = at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
    return first != np.arange(len(at)), first


def found_pieces(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """row, first word, number of edges, gram and content of the pieces of a batch, whether each repeats an earlier one of it, and that one."""
    key, ids = (batch.column(c).to_numpy() for c in ("key", "doc_id"))
    found = []
    for at, _, buf, offs in chunks(batch.column("text")):
        _, _, h, first = words(buf, offs)
        row, s, n, gram, content = pieces_of(h, first)
        found.append((at + row, s, n, gram, content))
    if not found:
        found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))]
    row, s, n, gram, content = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, s, n, gram, content, *settle([content, gram], [ids[row], key[row], s])


def _gram_counts(batches):
    """Grams of several pieces that a batch does not settle; a gram that is common everywhere is common in the batches."""
    for batch in batches:
        *_, gram, _, settled, _ = found_pieces(batch)
        grams_, n = np.unique(gram[~settled], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams_[n > 3].view(np.int64)), pa.array(n[n > 3].astype(np.int64))], ["part", "n"])


def _pieces(crowded: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _dealt(batch, crowded)

    return run


def _dealt(batch: pa.RecordBatch, crowded: np.ndarray) -> pa.RecordBatch:
    key, ids = (batch.column(c).to_numpy() for c in ("key", "doc_id"))
    row, s, n, gram, content, settled, first = found_pieces(batch)
    k, d = key[row], ids[row]
    open_ = ~settled & np.isin(gram.view(np.int64), crowded)
    # What is settled needs no partition of its own, nor what is cut into edges anyway.
    part = np.where(settled | open_, mix(k.view(U64) + s.astype(U64)), gram).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(settled), pa.array(part), pa.array(content.view(np.int64)), pa.array(k), pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(k[first]), pa.array(s[first].astype(np.int32)), pa.array(open_)], ["settled", "part", "content", "key", "doc_id", "s", "n", "okey", "os", "crowded"])


def _edges(batches):
    for batch in batches:
        key, ids = (batch.column(c).to_numpy() for c in ("key", "doc_id"))
        out = []
        row = 0
        for at, _, buf, offs in chunks(batch.column("text")):
            _, _, h, first = words(buf, offs)
            again = mix(h ^ U64(0xA5A5A5A55A5A5A5A))
            for r in range(len(offs) - 1):
                row = at + r
                p = batch.column("pieces")[row].as_py()
                s = np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in p])
                w = s + first[r]
                out.append((np.full(len(s), row), s, span_hashes(h, w, w + WINDOW), span_hashes(again, w, w + WINDOW)))
        if not out:
            continue
        row, s, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        k, d = key[row], ids[row]
        settled, first = settle([b, a], [d, k, s])
        part = np.where(settled, mix(k.view(U64) + s.astype(U64)), a).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(settled), pa.array(part), pa.array(b.view(np.int64)), pa.array(k), pa.array(d), pa.array(s.astype(np.int32)), pa.array(k[first]), pa.array(s[first].astype(np.int32))], ["settled", "part", "content", "key", "doc_id", "s", "okey", "os"])


def _word_digests(batches):
    for batch in batches:
        out_key, out_s, out_n, out = [], [], [], []
        for at, _, buf, offs in chunks(batch.column("text")):
            ws, we, _, first = words(buf, offs)
            for r in range(len(offs) - 1):
                key = batch.column("key")[at + r].as_py()
                mine = [buf[a:b].tobytes() for a, b in zip(ws[first[r] : first[r + 1]].tolist(), we[first[r] : first[r + 1]].tolist(), strict=True)]
                for x in batch.column("places")[at + r].as_py():
                    out_key.append(key)
                    out_s.append(x["s"])
                    out_n.append(x["n"])
                    out.append(hashlib.blake2b(b" ".join(mine[x["s"] : x["s"] + x["n"] + WINDOW - 1]), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_s, pa.int32()), pa.array(out_n, pa.int32()), pa.array(out, pa.binary())], ["key", "s", "n", "digest"])


def _cut(batches):
    for batch in batches:
        out = []
        for at, _, buf, offs in chunks(batch.column("text")):
            ws, we, _, first = words(buf, offs)
            for r in range(len(offs) - 1):
                a, b = ws[first[r] : first[r + 1]], we[first[r] : first[r + 1]]
                edge = np.zeros(len(a) + 1, np.int64)
                for x in batch.column("spans")[at + r].as_py():
                    edge[x["s"]] += 1
                    edge[x["s"] + x["n"] + WINDOW - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(buf[i:j].tobytes() for i, j in zip(a[~gone].tolist(), b[~gone].tolist(), strict=True))
                out.append((len(a), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        n, removed, digest = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _whole(batches):
    for batch in batches:
        n, digest = [], []
        buf, offs = flat(batch.column("text"))
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            w = buf[a:b].tobytes().split()
            n.append(len(w))
            digest.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted keys, joined with what is wanted of them. Only those texts are moved, if the keys are few enough to be sent round."""
    wanted = staged(wanted, "wanted")
    return of_keys(rows, wanted.select("key")).join(wanted.hint("shuffle_hash"), "key")


def matched(entries: DataFrame) -> DataFrame:
    """Every entry that is not alone in its partition, with its rank among equal contents, the first of them, and whether contents differ."""
    dealt = entries.repartition("part")
    group, same = Window.partitionBy("part"), Window.partitionBy("part", "content").orderBy("doc_id", "key", "s")
    first = same.rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumns({"rank": F.row_number().over(same), "fkey": F.first("key").over(first), "fs": F.first("s").over(first), "varied": F.min("content").over(group) < F.max("content").over(group)})
    # The same place can be listed by several rows: it does not repeat itself.
    again = F.col("settled") | ((F.col("rank") > 1) & ~((F.col("fkey") == F.col("key")) & (F.col("fs") == F.col("s"))))
    ranked = ranked if "crowded" in ranked.columns else ranked.withColumn("crowded", F.lit(False))
    return ranked.withColumns({"again": again, "okey": F.when(F.col("settled"), F.col("okey")).otherwise(F.col("fkey")), "os": F.when(F.col("settled"), F.col("os")).otherwise(F.col("fs"))}).filter("again OR varied OR crowded")


def crowded_grams(rows: DataFrame) -> np.ndarray:
    """Grams with so many open pieces that one partition should not hold them: some thousands at most, whatever the input."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counts = rows.mapInArrow(_gram_counts, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") > max(CROWD, size // 20_000))
    return np.array(sorted(r["part"] for r in counts.select("part").collect()), np.int64)


def repeated_paths(rows: DataFrame) -> DataFrame:
    """key, s, n, okey, os: verified long spans (n edges from word s) and their source coordinates. rows: doc_id, text, key."""
    long_enough = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WINDOW - 1))
    found = matched(long_enough.mapInArrow(_pieces(crowded_grams(long_enough)), PIECES))
    found = staged(found.select("key", "s", "n", "okey", "os", "again"), "pieces")
    branching = found.filter("NOT again").groupBy("key").agg(F.collect_set(F.struct("s", "n")).alias("pieces"))
    edges = _with_texts(rows, branching).select("key", "doc_id", "text", "pieces").mapInArrow(_edges, EDGES)
    single = matched(edges).filter("again").select("key", "s", F.lit(1).alias("n"), "okey", "os")
    pieces = staged(found.filter("again").select("key", "s", "n", "okey", "os").unionByName(single).distinct().withColumn("lag", F.col("s") - F.col("os")), "repeats")

    before = pieces.select("key", "okey", "lag", (F.col("s") + F.col("n")).alias("s"), F.lit(False).alias("head")).distinct()
    heads = pieces.join(before.hint("merge"), ["key", "okey", "lag", "s"], "left").withColumn("head", F.coalesce("head", F.lit(True)).cast("int"))
    path = F.sum("head").over(Window.partitionBy("key", "okey", "lag").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    spans = heads.withColumn("path", path).groupBy("key", "okey", "lag", "path").agg(F.min("s").alias("s"), (F.max(F.col("s") + F.col("n")) - F.min("s")).cast("int").alias("n"))
    spans = staged(spans.select("key", "s", "n", "okey", (F.col("s") - F.col("lag")).cast("int").alias("os")), "spans")

    places = spans.select("key", "s", "n").unionByName(spans.select(F.col("okey").alias("key"), F.col("os").alias("s"), "n"))
    wanted = places.groupBy("key").agg(F.collect_set(F.struct("s", "n")).alias("places"))
    digests = staged(_with_texts(rows.filter("doc_id IS NOT NULL"), wanted).select("key", "text", "places").mapInArrow(_word_digests, "key long, s int, n int, digest binary").distinct(), "digests")
    source = digests.select(F.col("key").alias("okey"), F.col("s").alias("os"), "n", F.col("digest").alias("source_digest"))
    both = spans.join(digests.hint("merge"), ["key", "s", "n"]).join(source.hint("merge"), ["okey", "os", "n"])
    return both.filter("digest = source_digest").select("key", "s", "n", "okey", "os")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    rows = keyed(docs)
    spans = staged(repeated_paths(rows).groupBy("key").agg(F.collect_set(F.struct("s", "n")).alias("spans")), "verified")
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    # A key names doc_id and text, and rows without doc_id have no spans.
    clean = sized_join(rows, spans.select("key"), ["key"], "left_anti").select("doc_id", text_or_empty().alias("text")).mapInArrow(_whole, result)
    return clean.unionByName(of_keys(rows, spans.select("key")).join(spans.hint("shuffle_hash"), "key").select("doc_id", "text", "spans").mapInArrow(_cut, result))
