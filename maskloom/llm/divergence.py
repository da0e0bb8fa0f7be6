"""How far the sources of a language differ in their words: exact divergences of all pairs of sources, and a source's own words.

Terms are counted once, inside tasks first. A language's vocabulary is cut into blocks by a hash of the term, and
each group (language and source) has, per block, an array of term ids in order and one of counts. Groups are dealt to
tiles of a few sources, the tiles of two sets of sources are co-grouped block by block, and each unordered pair of groups is merged in one
place, both ways: the terms of the shorter array gallop through the longer one, one-sided terms are priced against the other
group's share of an unseen term, and terms that neither has are counted, not listed. A pair's blocks are then added up.

Shares are p = 1 + floor(10**9 * (count + 1) / (N + V)), all in whole numbers.

Defined cases: null text, lang and source count as ''; a text without terms makes its group occur; a language without kept terms gives
its pairs the value 0 and no term rows; rows that repeat count each; equal values rank by item; a group whose language has no other source has
no pair rows; texts are read whole, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import flat
from .common import sized_join, staged

#: Runs of letters and of bytes beyond ASCII; on bytes, as all bytes of a character beyond ASCII are in the class.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Distinct terms of all groups that a task counts before it hands them on, and bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 22

#: Rows (group and term) of a block of a language's vocabulary, and sources of a tile.
BLOCK_ROWS, TILE = 1 << 17, 8

SCALE = 1_000_000_000

#: A group's places from which the terms in between start to gallop.
ANCHOR = 64


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences) and docs (documents with it), added up over many texts; a row without term for each group."""
    counts: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held = 0

    def out():
        rows = [(g[0], g[1], t, x[0], x[1]) for g, terms in counts.items() for t, x in terms.items()]
        lang, source, term, n, docs = zip(*rows, strict=True) if rows else ((),) * 5
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        data, offsets = flat(batch.column(0))
        for row, group in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if group not in counts:
                counts[group] = {b"": [0, 0]}
            terms = counts[group]
            seen = occurrences(data[offsets[row] : offsets[row + 1]])
            for term, n in seen.items():
                x = terms.get(term)
                if x is None:
                    terms[term] = [n, 1]
                    held += 1
                else:
                    x[0] += n
                    x[1] += 1
            if held >= HELD:
                yield out()
                held = 0
    yield out()


def occurrences(text: np.ndarray) -> dict[bytes, int]:
    """Terms of one text with their number. A long text is cut where no term goes on; only a term can be longer than a piece."""
    seen: dict[bytes, int] = {}
    lo = 0
    while lo < len(text):
        hi = min(lo + PIECE, len(text))
        while hi < len(text) and (text[hi] >= 128 or 65 <= text[hi] & 0xDF <= 90):
            hi += 1
        for term in TERM.findall(text[lo:hi].tobytes().translate(LOWER)):
            seen[term] = seen.get(term, 0) + 1
        lo = hi
    return seen


def kept_terms(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, lang_n) of the terms in at least least_docs documents of their language; and the groups (lang, source)."""
    text = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    made = text.mapInArrow(counted, "lang string, source string, term binary, n long, docs long")
    # A term of a group has one row per task and flush; after this, one. Terms then have one row per source.
    per_group = made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    rows = per_group.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    rows = staged(rows.filter((F.col("lang_docs") >= least_docs) | (F.octet_length("term") == 0)), "terms")
    return rows.filter("octet_length(term) > 0").drop("docs", "lang_docs"), rows.filter("octet_length(term) = 0").select("lang", "source")


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total) without leaving 64 bits: 10**9 = 31250 * 32000."""
    a = (count.astype(np.int64) + 1) * 31250
    return 1 + a // total * 32000 + a % total * 32000 // total


def divergence(p, q):
    return (p - q) * (p - q) // q


def galloped(small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in small, in large) of the ids that two sorted arrays share.

    Every ANCHOR-th id of the smaller array is looked up; those behind it go on from there in steps that double until
    they are past their id, and halve the last step.
    """
    if not len(small) or not len(large):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.repeat(np.searchsorted(large, small[::ANCHOR]), ANCHOR)[: len(small)]
    low, step = start.astype(np.int64), np.ones(len(small), np.int64)
    going = np.arange(len(small))
    while len(going):
        ahead = low[going] + step[going]
        going = going[(ahead < len(large)) & (large[np.minimum(ahead, len(large) - 1)] < small[going])]
        low[going] += step[going]
        step[going] *= 2
    high = np.minimum(low + step, len(large))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (large[np.minimum(middle, len(large) - 1)] < small)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    hit = (low < len(large)) & (large[np.minimum(low, len(large) - 1)] == small)
    return np.flatnonzero(hit), low[hit]


def priced(a: tuple, b: tuple, vocabulary: int) -> tuple[int, int]:
    """Sums of f(a's share, b's share) and of f(b's, a's) over a block's terms. a, b: sorted ids, counts, N + V of the group."""
    (ids_a, n_a, all_a), (ids_b, n_b, all_b) = a, b
    i, k = galloped(ids_a, ids_b) if len(ids_a) <= len(ids_b) else galloped(ids_b, ids_a)[::-1]
    p, q = share(n_a, all_a), share(n_b, all_b)
    zero = np.zeros(1, np.int64)
    none_a, none_b = share(zero, all_a)[0], share(zero, all_b)[0]
    only_a, only_b = np.ones(len(p), bool), np.ones(len(q), bool)
    only_a[i] = False
    only_b[k] = False
    absent = vocabulary - len(p) - len(q) + len(i)
    both = lambda f: int(f(p[i], q[k]).sum() + f(p[only_a], none_b).sum() + f(none_a, q[only_b]).sum() + absent * f(none_a, none_b))
    return both(divergence), both(lambda x, y: divergence(y, x))


def tile_pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """All unordered pairs between the groups of two tiles in one block; of one tile with itself, each pair once."""
    _, _, tile_l, tile_r = (x.as_py() for x in key)

    def groups(t: pa.Table) -> list[tuple]:
        read = lambda c: [x.values.to_numpy() for x in t.column(c)]
        return sorted(zip(t.column("source").to_pylist(), read("ids"), read("counts"), t.column("total").to_pylist(), t.column("terms").to_pylist(), strict=True), key=lambda g: g[0].encode())

    ls, rs = groups(left), groups(right)
    out = []
    for x, (a, *array_a, terms) in enumerate(ls):
        for b, *array_b, _ in rs[x + 1 :] if tile_l == tile_r else rs:
            there, back = priced(tuple(array_a), tuple(array_b), terms) if terms else (0, 0)
            out += [(a, b, there), (b, a, back)]
    source, item, value = zip(*out, strict=True) if out else ((), (), ())
    lang = key[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows hold the divergence from each other source of the language, `term`
    rows the most_terms kept terms that a source uses more than its language, by their part of the divergence from it."""
    terms, found = kept_terms(docs, least_docs)
    # One row per language, and one per group.
    v = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    rows_of = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    in_lang = Window.partitionBy("lang")
    groups = found.join(rows_of.hint("merge"), ["lang", "source"], "left").join(v.hint("merge"), "lang", "left").na.fill(0, ["total", "rows", "v", "lang_total"])
    groups = groups.withColumns({
        "tile": F.floor((F.row_number().over(in_lang.orderBy("source")) - 1) / TILE).cast("int"), "tiles": F.ceil(F.count(F.lit(1)).over(in_lang) / TILE).cast("int"),
        "blocks": F.greatest(F.ceil(F.sum("rows").over(in_lang) / BLOCK_ROWS), F.lit(1)).cast("int"), "total": F.col("total") + F.col("v"), "lang_total": F.col("lang_total") + F.col("v"),
    })
    groups = staged(groups, "divergence-groups")
    most = groups.agg(F.max("lang_total")).first()[0] or 0
    if most >= (1 << 63) // 32000:
        raise ValueError(f"shares of {most} words leave 64 bits")
    return pair_rows(terms, groups).unionByName(term_rows(terms, groups, most_terms))


def pair_rows(terms: DataFrame, groups: DataFrame) -> DataFrame:
    facts = groups.select("lang", "source", "total", "tile", "tiles", "blocks")
    rows = sized_join(terms.select("lang", "source", "term", "n"), facts, ["lang", "source"], "inner").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")))
    blocks = rows.groupBy("lang", "block").agg(F.max("id").cast("long").alias("terms"))
    arrays = rows.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    # A group without terms in a block has empty arrays there: its unseen terms are priced too.
    everywhere = groups.select("lang", "source", "total", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    full = everywhere.join(arrays.hint("merge"), ["lang", "source", "block"], "left").join(blocks.hint("merge"), ["lang", "block"], "left").na.fill(0, ["terms"])
    whole = lambda field, kind: F.coalesce(F.transform("x", lambda e: e[field].cast(kind)), F.array().cast(f"array<{kind}>"))
    full = staged(full.select("lang", "source", "block", "total", "tile", "tiles", "terms", whole("id", "int").alias("ids"), whole("n", "bigint").alias("counts")), "divergence-arrays")
    # The tiles before and at a group's own stand left of it, those at and after it right of it.
    left = full.withColumn("tile_r", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).withColumnRenamed("tile", "tile_l")
    right = full.withColumn("tile_l", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "tile_r")
    task = ["lang", "block", "tile_l", "tile_r"]
    columns = [*task, "source", "total", "terms", "ids", "counts"]
    merged = left.select(*columns).groupBy(*task).cogroup(right.select(*columns).groupBy(*task)).applyInArrow(tile_pairs, "lang string, source string, item string, value long")
    values = merged.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return values.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def exact_share(count: Column, total: Column) -> Column:
    """`share` as an expression."""
    a = (count + 1) * 31250
    return F.lit(1) + F.call_function("div", a, total) * 32000 + F.call_function("div", (a % total) * 32000, total)


def term_rows(terms: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    both = sized_join(terms, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"], "inner")
    p, q = exact_share(F.col("n"), F.col("total")), exact_share(F.col("lang_n"), F.col("lang_total"))
    ahead = both.withColumns({"p": p, "q": q}).filter("n > 0 AND p > q")
    ahead = ahead.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    # Each task drops what stands behind its own first rows before rows are moved.
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return ahead.withColumn("rank", rank).filter(F.col("rank") <= most)
