"""Benchmark decontamination with a positional inverted index (DataFrame functions only).

1. Split every document into words once and store the postings (document, position) of all benchmark terms.
   From them, count how often each term occurs over all documents.
2. The two rarest terms of each benchmark window (ties: the earlier one) are its anchors; their postings
   are intersected: every occurrence of a window holds its anchors.
3. Shift each posting by the anchor's place in its item and intersect: a (document, item, offset) stays
   a candidate if both anchors of some window of the item are posted there. For proximity it is one if
   each of the two is posted within `slop` of it. What is left is written to the shared folder.
4. At such an offset the item's remaining terms are looked up in the document, in place. A window is
   an exact phrase match if all its terms stand at their places, and a proximity match if each stands
   within `slop` words of its place.

Texts without a candidate offset never move. Joins broadcast a side only if its measured bytes are few.

Items are distinct pairs of item_id and words, each with a number of its own (`item`) that windows, postings and
candidates carry, so benchmark rows that repeat count once and texts that share an item_id stay apart.

Defined cases: null or wordless texts have no words and match nothing; items without words are ignored;
a passage of an item with a null item_id is a hit, but names no item; documents that repeat are each judged; ties between rare terms go to the earlier position; empty tables give
empty results or clean documents; texts are read whole, however long; other columns are ignored, and pass through `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, is_small, sized_join, staged, text_or_empty, without_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same words before A-Z are lowered.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(name: str = "text") -> Column:
    """A-Z in lower case. Texts of ASCII alone take the fast built-in."""
    text = text_or_empty(name)
    return F.when(text.rlike(r"[^\x00-\x7F]"), ascii_lower(text)).otherwise(F.lower(text))


def words(name: str = "text") -> Column:
    return F.regexp_extract_all(lowered(name), F.lit(WORD), F.lit(0))


def folded(terms: Column) -> Column:
    """Terms with all letters in lower case: equal terms stay equal, so candidates found by them miss nothing."""
    return F.transform(terms, lambda t: F.lower(t))


#: Tasks that a word's rows are dealt to where the vocabulary is too large to be sent round.
SALTS = 32


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key per document; equal keys of unequal documents would only add candidates."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, n (words in a window), start, terms (array) for every window of every item."""
    size = F.least(F.size("terms"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("terms") - size))
    return items.select("item", "terms", size.alias("n"), starts.alias("start")).withColumn("terms", F.slice("terms", F.col("start") + 1, F.col("n")))


def postings_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key, pos, term: every place of a benchmark term in a document, and one row without a term that has the number of words as pos.

    The only pass that splits all texts into words. Terms are in lower case of any alphabet, which is quicker and only adds
    candidates. Written out once; counts, postings of anchors and numbers of words are read from it.
    """
    words = F.regexp_extract_all(F.lower(text_or_empty()), F.lit(ANY_CASE), F.lit(0))
    tokens = rows.select("doc_id", "key", F.posexplode(F.concat(words, F.array(F.lit("")))).alias("pos", "term"))
    vocabulary = staged(items.select(F.explode(folded(F.col("terms"))).alias("term")).union(rows.sparkSession.createDataFrame([("",)], "term string")).distinct(), "vocabulary")
    if is_small(vocabulary):
        return staged(tokens.join(F.broadcast(vocabulary), "term"), "postings")
    # Frequent words, and the row of every document, are dealt over several tasks; the vocabulary is sent to each.
    dealt = tokens.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int"))
    sent = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return staged(dealt.join(sent.hint("merge"), ["term", "salt"]).drop("salt"), "postings")


def candidates(postings: DataFrame, items: DataFrame, window: int, slop: int) -> DataFrame:
    """Distinct (key, item, shift): document positions minus item positions at which the anchors of a window agree, each give or take slop."""
    items = items.withColumn("terms", folded(F.col("terms")))
    counts = staged(postings.filter("term <> ''").groupBy("term").count(), "term-counts")
    each = item_windows(items, window).select("item", "start", F.posexplode("terms").alias("at", "term"))
    each = sized_join(each, counts, ["term"], "left")
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), (F.col("start") + F.col("at")).alias("place"), "term")))
    rarest = each.groupBy("item", "start").agg(F.slice(by_rarity, 1, 2).alias("rarest")).filter("rarest[0].count > 0")
    rarest = staged(rarest, "rarest")
    anchors = staged(rarest.select("item", F.explode("rarest").alias("r")).select("item", "r.term", "r.place").distinct(), "anchors")
    needs = staged(rarest.groupBy("item").agg(F.collect_set(F.transform("rarest", lambda r: r["place"])).alias("needs")), "needs")
    posted = sized_join(postings.select("key", "pos", "term"), anchors, ["term"], "inner")
    shift = F.col("pos") - F.col("place")
    if slop:
        return near_candidates(posted.select("key", "item", "place", shift.alias("shift")), needs, slop)
    lists = posted.groupBy("key", "item", shift.alias("shift")).agg(F.collect_set("place").alias("places"))
    lists = sized_join(lists, needs, ["item"], "inner")
    return lists.filter(F.exists("needs", lambda w: F.size(F.array_intersect(w, F.col("places"))) == F.size(F.array_distinct(w)))).select("key", "item", "shift")


def near_candidates(postings: DataFrame, needs: DataFrame, slop: int) -> DataFrame:
    """Distinct (key, item, shift) within slop of both anchors of a window. postings: key, item, place, shift.

    Postings of a document and item meet in buckets of 2 * slop + 1 shifts, each told to the bucket after its own too.
    """
    own = F.floor(F.col("shift") / (2 * slop + 1))
    dealt = postings.select("key", "item", "place", "shift", F.explode(F.array(own, own + 1)).alias("bucket"))
    lists = dealt.groupBy("key", "item", "bucket").agg(F.collect_set(F.struct("place", "shift")).alias("posted"))
    lists = sized_join(lists, needs, ["item"], "inner")
    reach = lambda p: F.array_distinct(F.flatten(F.transform(F.filter("posted", lambda x: x["place"] == p), lambda x: F.sequence(x["shift"] - slop, x["shift"] + slop))))
    held = F.filter("needs", lambda w: F.forall(w, lambda p: F.exists("posted", lambda x: x["place"] == p)))
    both = F.flatten(F.transform(held, lambda w: F.array_intersect(reach(w[0]), reach(F.element_at(w, -1)))))
    return lists.select("key", "item", F.explode(F.array_distinct(both)).alias("shift")).distinct()


def standing(doc: Column, terms: Column, shift: Column, slop: int) -> Column:
    """For each term of an item, whether it stands within slop of its shifted place."""

    def there(i):
        here = shift + i
        if not slop:
            return F.coalesce(F.get(doc, here) == F.get(terms, i), F.lit(False))
        lo = F.greatest(here - slop, F.lit(0))
        return (here + slop >= 0) & F.array_contains(F.slice(doc, lo + 1, F.greatest(here + slop - lo + 1, F.lit(0))), F.get(terms, i))

    return F.transform(F.sequence(F.lit(0), F.size(terms) - 1), there)


def matches(stood: Column) -> Column:
    """Items and starts of the windows whose terms all stand, of what is found in a document."""
    starts = lambda m: F.filter(F.sequence(F.lit(0), F.size(m["flags"]) - m["n"]), lambda s: F.forall(F.slice(m["flags"], s + 1, m["n"]), lambda f: f))
    return F.filter(F.transform(stood, lambda m: F.struct(m["item_id"].alias("item_id"), m["shift"].alias("shift"), m["n"].alias("n"), starts(m).alias("starts"))), lambda m: F.size(m["starts"]) > 0)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2) -> DataFrame:
    """One row per document: doc_id, key, n_words, hits (word positions inside exact matches), items (matched exactly), near_items (matched by proximity).

    Without slop only exact matches are sought, and near_items are the same items.
    """
    rows = keyed(docs)
    items = benchmark.select("item_id", words().alias("terms")).filter(F.size("terms") > 0).distinct()
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "items")
    postings = postings_of(rows, items)
    found = candidates(postings, items, window, slop).groupBy("key", "item").agg(F.collect_set("shift").alias("shifts"))
    found = sized_join(found, items, ["item"], "inner")
    found = staged(found.groupBy("key").agg(F.collect_list(F.struct("item_id", "shifts", "terms")).alias("found")), "candidates")
    keys = found.select("key")
    few = is_small(keys)
    none = [F.array().cast("array<int>").alias("hits"), F.array().cast("array<bigint>").alias("items"), F.array().cast("array<bigint>").alias("near_items")]
    clean = sized_join(postings.filter("term = ''"), keys, ["key"], "left_anti", few)
    clean = clean.select("doc_id", "key", F.col("pos").cast("long").alias("n_words"), *none)

    held = rows.join(F.broadcast(keys), "key", "left_semi") if few else rows
    held = held.join(found.hint("shuffle_hash"), "key")
    size = lambda c: F.least(F.size(c["terms"]), F.lit(window))

    def stood(doc: Column, near: int) -> Column:
        at = lambda c: F.transform(c["shifts"], lambda x: F.struct(c["item_id"].alias("item_id"), x.alias("shift"), size(c).alias("n"), standing(doc, c["terms"], x, near).alias("flags")))
        return matches(F.flatten(F.transform("found", at)))

    # A text is split once: inside a lambda its words are a variable, not an expression that is worked out for every term.
    judged = F.transform(F.array(words()), lambda doc: F.struct(F.size(doc).cast("long").alias("n_words"), stood(doc, 0).alias("exact"), *([stood(doc, slop).alias("near")] if slop else [])))
    held = held.select("doc_id", "key", F.inline(judged))
    held = held if slop else held.withColumn("near", F.col("exact"))
    hits = F.flatten(F.transform("exact", lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(m["shift"] + s, m["shift"] + s + m["n"] - 1)))))
    ids = lambda c: F.array_distinct(F.transform(c, lambda m: m["item_id"]))
    dirty = held.select("doc_id", "key", "n_words", F.array_distinct(hits).alias("hits"), ids("exact").alias("items"), ids("near").alias("near_items"))
    return clean.unionByName(dirty)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    m = find_matches(docs, benchmark, window, slop=0)
    named = F.array_compact("items")
    names = F.array_sort(F.transform(named, lambda x: x.cast("string")))
    return m.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2) -> DataFrame:
    """One row per document: doc_id, n_items (matched exactly), near_items (names of those matched by proximity, in order, null last)."""
    m = find_matches(docs, benchmark, window, slop)
    near = F.array_sort(F.transform("near_items", lambda x: x.cast("string")))
    return m.select("doc_id", F.size(F.array_compact("items")).cast("long").alias("n_items"), near.alias("near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    judged = find_matches(docs, benchmark, window, slop=0).filter(F.size("hits") > 0)
    return without_rows(docs, judged.select("doc_id", "key"), "contaminated")
