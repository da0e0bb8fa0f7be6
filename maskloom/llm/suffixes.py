"""Byte-level deduplication by bucket-pointer refinement of a sampled suffix order.

A suffix matters only down to `WINDOW` bytes here. Sorting every suffix of the corpus would move each
byte many times, so buckets are refined where they can still split, and only there:

1. Blocks. The documents are packed, some megabytes a block, and written once; blocks stay where they are from then on.
   What is asked of the parts about a block's entries is answered by a few bits an entry, in the order in which they were
   asked, so neither texts nor names of documents or places are shuffled.
2. Initial buckets. The q-grams of a window are hashed and the least one is the window's bucket, so
   equal windows share a bucket wherever they stand. Consecutive windows of one bucket are one entry.
   The distinct buckets of each block go to their parts, which tell the blocks what buckets others have too.
   A bucket of one document is sorted already, and most are: its entries are never sent.
3. The entries of the other buckets go to the bucket's part: bucket, a digest of the bytes that the windows cover
   (BLAKE2, 120 bits: equal digests stand for equal bytes) and doc_id; but for those whose bytes a smaller doc_id of the
   same block has too, which are settled at once. Entries of a bucket with equal bytes are settled by the
   smallest doc_id among them. Only buckets with different bytes need refinement.
4. Refinement. The bytes of those entries (first copies only) are sorted in their part by bucket
   pointers: buckets of 8 bytes, then pairs of bucket numbers at offsets 0 and 8, 0 and 16, and
   0 and 18, each pass reusing the numbers of the pass before. Equal numbers at depth 50 are equal
   windows, by their bytes alone; the smallest doc_id of each keeps it. A bucket with thousands of different
   contents is not one part: its windows are dealt one by one, by their own digests, so that equal ones meet.

The number of parts grows with the bytes of the table, so a part holds about as much whatever the input.

Bytes of every covered window are removed; they are judged on the input. All buckets, all windows and
all documents take part. A frequent passage reaches a partition once per block, not once per copy.

Defined cases: null text is empty; texts under 50 bytes keep all; only strictly smaller doc_ids cover, so
repeats inside a document or among rows of one doc_id stay; rows with a null doc_id neither cover nor
lose anything; texts are read whole, one longer than a block makes a longer block; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import U64, chunks, flat, mix
from .common import is_small, placed, staged, text_or_empty

WINDOW, Q = 50, 16

#: Bytes of text whose entries make a part, about; a task works on its parts one after the other. Bytes of text of a block, about.
PART, PIECE = 8 << 20, 8 << 20

#: Bytes of text that are hashed at once, about.
AT_ONCE = 1 << 18

#: Least number of parts per shuffle partition, and most bytes of text per shuffle partition.
PARTS, TASK = 8, 256 << 20

#: Most buckets that Spark lets a table have.
PLACES = 100_000

#: Contents of a bucket from which on its windows are dealt one by one.
CROWD = 4096

#: An entry's digest is two numbers, of 8 and 7 bytes.
DIGEST = 15

#: A stretch of windows in a block: first start and number of starts.
SPAN = np.dtype([("s", "<u4"), ("n", "<u4")])

#: A bucket is its part and 32 bits; buckets that share both are refined more than they need be, and no more.
LOW = U64(0xFFFFFFFF)

#: What is known of an entry; one that nothing is known of has a bucket, or a content, of its own.
COVERED, UNSETTLED, CROWDED = 1, 2, 3

#: Answers that are not of a part: which entries of a block were sent, which were settled at home, and spans that refinement found.
SENT, SETTLED, REFINED = -1, -2, -3

BUCKETS = "part int, block long, bucket binary"
ENTRIES = "part int, block long, kind int, bucket binary, content binary, rest binary, ids binary"
CONTENTS = "part int, block long, ids binary, s binary, n binary, data binary"
ANSWERS = "block long, part int, answer binary"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of an array of numbers, byte by byte, so that equal high bytes stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int, dtype) -> np.ndarray:
    out = np.zeros((len(data) // width, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(dtype)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on."""
    n, k, out = len(x) - w + 1, 1, x
    while 2 * k <= w:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[:n], out[w - k : w - k + n]) if k < w else out[:n]


def digests(raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2 digests of the bytes of each entry: equal ones are equal bytes."""
    both = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), e.tolist(), strict=True)])
    both = np.frombuffer(both, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1] & U64((1 << 8 * (DIGEST - 8)) - 1)


def entries_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, start, number of windows and bucket of each entry of a chunk, in order."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(U64)
    eight = np.ndarray((n - 7,), "<u8", buf.tobytes(), 0, (1,))
    g = eight[: n - Q + 1] * U64(0x9E3779B97F4A7C15)
    g ^= g >> U64(32)
    g += eight[8 : 8 + len(g)]
    g *= U64(0xBF58476D1CE4E5B9)
    g ^= g >> U64(29)
    g *= U64(0x94D049BB133111EB)
    least = sliding_min(g, WINDOW - Q + 1)
    inside = np.zeros(n + 1, np.int8)  # +1 where windows of a document begin, -1 after the last one
    ends = offs[1:] - WINDOW + 1
    ok = ends > offs[:-1]
    np.add.at(inside, offs[:-1][ok], 1)
    np.add.at(inside, ends[ok], -1)
    inside = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
    change = np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])])
    s = np.flatnonzero(change)
    e = np.append(s[1:], len(least))
    keep = inside[s]
    s, e = s[keep], e[keep]
    return np.searchsorted(offs, s, "right") - 1, s, e - s, mix(least[s])


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PIECE bytes of text, so that arrays stay small whatever the batches are."""
    _, offs = flat(batch.column("text"))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + PIECE, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _blocks(batches):
    """Rows of about PIECE bytes of text, each a table of its own: documents by doc_id, those without one last."""
    first, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for piece in (x for b in batches for x in pieces(b)):
        more = int(flat(piece.column("text"))[1][-1])
        if held and size + more > PIECE:
            yield _block(first + n, held)
            n, held, size = n + 1, [], 0
        held.append(piece)
        size += more
    if held:
        yield _block(first + n, held)


def _block(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    docs = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(docs.to_batches()[0])
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()])], ["block", "docs"])


class Block:
    """A block's documents and entries, and what has been answered about them."""

    def __init__(self, number: int, data: bytes, parts: int):
        docs = pa.ipc.open_stream(data).read_next_batch()
        self.number, self.parts, self.doc_id = number, parts, docs.column("doc_id")
        self.buf, self.offs = flat(docs.column("text"))
        named = docs.slice(0, len(docs) - self.doc_id.null_count)  # rows without doc_id neither cover nor lose anything
        ids = named.column("doc_id").to_numpy()
        found = [(first + r, int(self.offs[first]) + s, *x) for first, _, buf, offs in chunks(named.column("text"), AT_ONCE) for r, s, *x in [entries_of(buf, offs)]]
        row, self.at, self.n, self.bucket = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)]
        self.doc = ids[row]
        self.part = ((self.bucket >> U64(40)) % U64(parts)).astype(np.min_scalar_type(parts))

    def buckets(self) -> np.ndarray:
        """The bucket of each entry, as its part and 32 bits."""
        return (self.part.astype(U64) << U64(32)) | (self.bucket & LOW)

    def by_part(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These entries by part, and where each part begins."""
        of = of[np.argsort(self.part[of], kind="stable")]
        return of, np.searchsorted(self.part[of], np.arange(self.parts + 1))

    def states(self, answers: dict[int, bytes]) -> np.ndarray:
        """What is known of each entry after the second round."""
        sent, settled = (bits(answers[k], len(self.at)) for k in (SENT, SETTLED))
        out = np.zeros(len(self.at), np.uint8)
        out[settled] = COVERED
        of, cut = self.by_part(np.flatnonzero(sent & ~settled))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            m = int(cut[p + 1] - cut[p])
            half = (m + 7) // 8
            out[of[cut[p] : cut[p + 1]]] = bits(answers[p][:half], m) + 2 * bits(answers[p][half:], m).astype(np.uint8)
        return out


def bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def blocks_of(batches, parts: int) -> Iterator[tuple[Block, list[tuple[int, bytes]]]]:
    """Block after block, with what the table that was joined to it says."""
    for batch in batches:
        for k in range(batch.num_rows):
            answers = batch.column("answers")[k].as_py() if "answers" in batch.schema.names else []
            yield Block(batch.column("block")[k].as_py(), batch.column("docs")[k].as_py(), parts), [(x["part"], x["answer"]) for x in answers or []]


def rows_of(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """A batch of these rows, if there are any."""
    fields = [f.split() for f in schema.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, KINDS[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


def groups(batches) -> Iterator[list[dict]]:
    """Rows of one part after the other; the batches are sorted by part."""
    for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), itemgetter("part")):
        yield list(rows)


def _buckets(parts: int):
    """The distinct buckets of each block, dealt to their parts."""

    def run(batches):
        for block, _ in blocks_of(batches, parts):
            of = np.sort(block.buckets())
            of = of[np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]]
            cut = np.searchsorted(of, np.arange(parts + 1).astype(U64) << U64(32))
            low = (of & LOW).astype(np.uint32)
            yield from rows_of([(p, block.number, planes(np.diff(low[cut[p] : cut[p + 1]], prepend=np.uint32(0)), 4)) for p in np.flatnonzero(np.diff(cut)).tolist()], BUCKETS)

    return run


def _shared(batches):
    """Which buckets of a block another block has too."""
    for rows in groups(batches):
        each = [np.cumsum(unplanes(r["bucket"], 4, np.uint32), dtype=np.uint32) for r in rows]
        _, which, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in each])
        flags = np.split(counts[which] > 1, ends[:-1])
        yield from rows_of([(r["block"], r["part"], packed(x)) for r, x in zip(rows, flags, strict=True)], ANSWERS)


def _entries(parts: int):
    """The entries of buckets in which documents meet, dealt to the parts of the buckets; and which entries these are."""

    def run(batches):
        for block, answers in blocks_of(batches, parts):
            of = block.buckets()
            order = np.argsort(of, kind="stable")  # within a bucket by doc_id
            of = of[order]
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
            end = np.append(begin[1:], len(of))[: len(begin)]
            meet = block.doc[order[begin]] < block.doc[order[end - 1]]
            cut = np.searchsorted(of[begin], np.arange(parts + 1).astype(U64) << U64(32))
            for p, answer in answers:
                meet[cut[p] : cut[p + 1]] |= bits(answer, int(cut[p + 1] - cut[p]))
            sent = np.empty(len(of), bool)
            sent[order] = np.repeat(meet, end - begin)
            at = np.flatnonzero(sent)
            content, rest = digests(block.buf.tobytes(), block.at[at], block.at[at] + block.n[at] + WINDOW - 1)
            # Settle here what a smaller doc_id of this block has too.
            doc = block.doc[at]
            order = np.lexsort((rest, content))  # equal ones stay in order of doc_id
            c, d = content[order], rest[order]
            begin = np.ones(len(c), bool)
            begin[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
            least = doc[order][np.maximum.accumulate(np.where(begin, np.arange(len(c)), 0))]
            settled = np.zeros(len(at), bool)
            settled[order] = doc[order] > least
            everywhere = np.zeros(len(block.at), bool)
            everywhere[at[settled]] = True
            out = [(block.number % parts, block.number, k, packed(x), b"", b"", b"") for k, x in ((SENT, sent), (SETTLED, everywhere))]
            first = np.zeros(len(block.at), np.int64)
            first[at] = np.arange(len(at))
            of, cut = block.by_part(at[~settled])
            for p in np.flatnonzero(np.diff(cut)).tolist():
                x = of[cut[p] : cut[p + 1]]
                y = first[x]
                out.append((p, block.number, p, planes((block.bucket[x] & LOW).astype(np.uint32), 4), planes(content[y], 8), planes(rest[y], DIGEST - 8), planes(np.diff(block.doc[x], prepend=0), 8)))
            yield from rows_of(out, ENTRIES)

    return run


def _settle(batches):
    """Entries of whole buckets: which of them a smaller doc_id covers, and which need refinement."""
    for rows in groups(batches):
        yield from rows_of([(r["block"], r["kind"], r["bucket"]) for r in rows if r["kind"] < 0], ANSWERS)
        yield from _settle_part([r for r in rows if r["kind"] >= 0])


def _settle_part(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    each = [np.cumsum(unplanes(r["ids"], 8, np.int64)) for r in rows]
    doc, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
    bucket, content, rest = (np.concatenate([unplanes(r[c], width, t) for r in rows]) for c, width, t in (("bucket", 4, np.uint32), ("content", 8, U64), ("rest", DIGEST - 8, U64)))
    order = np.lexsort((doc, rest, content, bucket))
    b, c, d, ids = (x[order] for x in (bucket, content, rest, doc))
    new_bucket = np.concatenate([[True], b[1:] != b[:-1]])
    new_content = new_bucket | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
    covered = ids > ids[np.maximum.accumulate(np.where(new_content, np.arange(len(ids)), 0))]
    starts = np.flatnonzero(new_bucket)
    sizes = np.diff(np.append(starts, len(ids)))
    # Buckets with one entry, or of one document, are sorted already.
    variants = np.where(np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts), np.add.reduceat(new_content.astype(np.int64), starts), 1)
    variants = np.repeat(variants, sizes)
    state = np.empty(len(ids), np.uint8)
    state[order] = np.where(covered, COVERED, np.where(variants > CROWD, CROWDED, np.where(variants > 1, UNSETTLED, 0)))
    yield from rows_of([(r["block"], r["kind"], packed(x & 1) + packed(x >> 1)) for r, x in zip(rows, np.split(state, ends[:-1]), strict=True)], ANSWERS)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the runs of n, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _contents(parts: int):
    """The bytes of unsettled entries, dealt to the parts of their buckets; of crowded buckets, window by window to the parts of the windows."""

    def run(batches):
        for block, answers in blocks_of(batches, parts):
            state = block.states(dict(answers))
            few, many = np.flatnonzero(state == UNSETTLED), np.flatnonzero(state == CROWDED)
            part = (mix(block.bucket[few]) % U64(parts)).astype(np.int64)
            windows = spread(block.at[many], block.n[many])
            raw = block.buf.tobytes() if len(many) else b""
            dealt = np.array([int.from_bytes(hashlib.blake2b(raw[at : at + WINDOW], digest_size=8).digest(), "little") % parts for at in windows.tolist()], np.int64)
            part, at = np.concatenate([part, dealt]), np.concatenate([block.at[few], windows])
            n, doc = np.concatenate([block.n[few], np.ones(len(windows), np.int64)]), np.concatenate([block.doc[few], np.repeat(block.doc[many], block.n[many])])
            order = np.lexsort((at, part))
            part, at, n, doc = (x[order] for x in (part, at, n, doc))
            cut = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(cut)).tolist():
                x = slice(cut[p], cut[p + 1])
                out.append((p, block.number, planes(np.diff(doc[x], prepend=0), 8), planes(np.diff(at[x], prepend=0).astype(np.uint32), 4), planes(n[x].astype(np.uint32), 4), block.buf[spread(at[x], n[x] + WINDOW - 1)].tobytes()))
            yield from rows_of(out, CONTENTS)

    return run


def bucket_pointers(data: np.ndarray) -> np.ndarray:
    """A number per position such that two are equal just if the WINDOW bytes from there on are; the last WINDOW - 1 positions have none."""
    n = len(data)
    if n >= 1 << 32:  # two numbers share 64 bits
        raise ValueError(f"a part of {n} bytes")
    raw = data.tobytes()

    def renumber(keys):
        return np.unique(keys, return_inverse=True)[1].astype(U64)

    number = renumber(np.ndarray((n - 7,), "<u8", raw, 0, (1,)))
    for depth, step in ((8, 8), (16, 16), (32, WINDOW - 32)):
        m = n - depth - step + 1
        number = renumber((number[:m] << U64(32)) | number[step : step + m])
    return number


def _refine(batches):
    for rows in groups(batches):
        yield from _refine_part(rows)


def _refine_part(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
    s, n = (np.concatenate([f(unplanes(r[c], 4, np.uint32)) for r in rows]).astype(np.int64) for c, f in (("s", lambda x: np.cumsum(x, dtype=np.uint32)), ("n", lambda x: x)))
    each = [np.cumsum(unplanes(r["ids"], 8, np.int64)) for r in rows]
    doc, of = np.concatenate(each), np.repeat(np.arange(len(rows)), [len(x) for x in each])
    begin = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
    which = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    number = bucket_pointers(data)[begin[which] + inner].astype(np.int64)
    least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc[which])
    hit = doc[which] > least[number]
    which, start = which[hit], s[which[hit]] + inner[hit]
    if not len(which):
        return
    at = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)]))
    spans = np.empty(len(at), SPAN)
    spans["s"], spans["n"] = start[at], np.diff(np.append(at, len(which)))
    cut = np.searchsorted(of[which[at]], np.arange(len(rows) + 1))
    yield from rows_of([(r["block"], REFINED, spans[a:b].tobytes()) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True) if a < b], ANSWERS)


def _cut(parts: int):
    def run(batches):
        for block, answers in blocks_of(batches, parts):
            covered = block.states(dict(x for x in answers if x[0] != REFINED)) == COVERED
            spans = np.frombuffer(b"".join(x for k, x in answers if k == REFINED), SPAN)
            s, n = np.concatenate([block.at[covered], spans["s"].astype(np.int64)]), np.concatenate([block.n[covered], spans["n"].astype(np.int64)])
            order = np.argsort(s)
            s, e = s[order], s[order] + n[order] + WINDOW - 1
            row, reach = np.searchsorted(block.offs, s, "right") - 1, np.maximum.accumulate(e)
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] > reach[:-1])])[: len(s)])
            s, e = s[first], reach[np.append(first[1:], len(s))[: len(first)] - 1]  # removed runs, none in two documents
            at = np.searchsorted(s, block.offs)
            runs, lost = np.diff(at), np.diff(np.concatenate([[0], np.cumsum(e - s)])[at])
            edges = np.concatenate([[0], np.stack([s, e], 1).reshape(-1), [len(block.buf)]])
            stays = np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))
            size = np.diff(block.offs)
            ends = np.concatenate([[0], np.cumsum(size - lost)])
            kept = block.buf[stays].tobytes()
            texts = [kept[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [pa.array(size), pa.array(lost), pa.array(runs), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([block.doc_id, *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


#: What names a document: a hash of doc_id and text, and the doc_id.
NAMED = ["key", "doc_id"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def of_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with these keys, where they are few enough to be sent round; all rows otherwise, for a join that comes anyway."""
    return rows.join(F.broadcast(keys), keys.columns, "left_semi") if is_small(keys) else rows


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK)
    parts = tasks * max(PARTS, size // (tasks * PART))
    places = min(max(tasks, size // PIECE), PLACES)
    blocks = placed(rows.mapInArrow(_blocks, "block long, docs binary"), "block", places, "blocks")

    def dealt(asked: DataFrame, answer, name: str) -> DataFrame:
        return staged(asked.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(answer, ANSWERS), name)

    def told(answers: DataFrame) -> DataFrame:
        """Each block with its answers, which go where the block is."""
        by_block = answers.repartition(places, "block").groupBy("block").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))
        return blocks.join(by_block.hint("shuffle_hash"), "block", "left")

    shared = dealt(blocks.mapInArrow(_buckets(parts), BUCKETS), _shared, "shared")
    settled = dealt(told(shared).mapInArrow(_entries(parts), ENTRIES), _settle, "settled")
    refined = dealt(told(settled).mapInArrow(_contents(parts), CONTENTS), _refine, "refined")
    return told(settled.unionByName(refined)).mapInArrow(_cut(parts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
