"""What the training-data operators share: reading tables, joins by size, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..sources.shared import placed, staged

__all__ = ["RAW_WORD", "ascii_lower", "fresh_name", "is_small", "n_raw_words", "placed", "set_aside", "sized_join", "spread_join", "staged", "table", "text_or_empty", "without_rows"]

#: A word of the raw contracts: anything between ASCII white space.
RAW_WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of a side that a join may broadcast; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20

#: Bytes that a row takes in a broadcast table beside its strings and arrays, about.
ROW_BYTES = 40

#: Rows of one join key that stay together, if they or their side carry texts, and if both are ids alone; a key with more is dealt over several tasks.
HOT, HOT_IDS = 512, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame) -> bool:
    """Whether the rows of a table that is cheap to read, with the lengths of all that varies in them, may be broadcast."""
    width = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(col)), F.lit(0))
        else:
            width = width + 8
    return (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, small: bool | None = None) -> DataFrame:
    """Join that broadcasts the right side only if its measured bytes are few, and merges otherwise. right should be staged."""
    small = is_small(right) if small is None else small
    return left.join(right.hint("broadcast" if small else "merge"), on, how)


def spread_join(rows: DataFrame, side: DataFrame, on: str, n: str, by: str | Column, how: str = "inner", counts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Join rows with a side of one row per key whose column n counts the rows of that key.

    A key with more than `most` rows (HOT_IDS by default) is dealt by a hash of `by` over several tasks, and its row of the side, which
    can be a long text, is sent once to each. side should be staged, or counts, which has its keys and n; n is dropped.
    """
    together, keys = most or HOT_IDS, side if counts is None else counts
    if (keys.agg(F.max(n)).first()[0] or 0) <= together:
        return rows.join(side.drop(n).hint("merge"), on, how)
    while not is_small(keys.filter(F.col(n) > together).select(on)):  # so many hot keys that each is one among many
        together *= 8
    shares = F.ceil(F.col(n) / together).cast("int")
    hot = keys.filter(F.col(n) > together).select(on, shares.alias("__shares"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__share", F.pmod(F.xxhash64(by), F.coalesce("__shares", F.lit(1))).cast("int")).drop("__shares")
    sent = side.withColumn("__share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1))).drop(n)
    return dealt.join(sent.hint("merge"), [on, "__share"], how).drop("__share")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def set_aside(df: DataFrame, *added: str) -> DataFrame:
    """The table with `_` behind the names of columns that would clash with added ones, whatever the case of their letters."""
    taken, names = {x.lower() for x in added}, []
    rest = {c.lower() for c in df.columns}
    for c in df.columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in rest):
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def without_rows(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs but for the rows of `gone`: doc_id and key, a hash of doc_id and text. Ids and hashes together tell rows apart where 64 bits alone would not."""
    key, a, b = (fresh_name(docs, c) for c in ("__key", "__gone_id", "__gone_key"))
    gone = staged(gone.select(F.col("doc_id").alias(a), F.col("key").alias(b)).distinct(), name)
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    same = (F.col(key) == F.col(b)) & rows["doc_id"].eqNullSafe(F.col(a))
    return rows.join(gone.hint("broadcast" if is_small(gone) else "merge"), same, "left_anti").drop(key)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever else the text holds."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_raw_words(name: str = "text") -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.regexp_count(text_or_empty(name), F.lit(RAW_WORD)).cast("long")
