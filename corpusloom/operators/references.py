"""References to records that do not exist: Bloom filter first, exact join for what it lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans import cut, lookup_join

#: Words of 64 bits in a row of the filter.
_ROW = 1024
#: Most bytes of filter that are broadcast, however many parents there are; beyond it only more references are verified.
MAX_FILTER_BYTES = 32 << 20


def _spot(key: Column, words: int) -> tuple[Column, Column, Column]:
    """Row and word of the filter for a key, and the four bits set there."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    word = F.pmod(h, F.lit(words))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(g, 6 * i), F.lit(64)).cast("int")) for i in range(4)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return F.floor(word / _ROW).cast("int"), F.pmod(word, F.lit(_ROW)).cast("int"), mask


def bloom_filter(keys: DataFrame, key: str, expected: int, bits_per_key: int = 12, max_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of ``keys`` as rows (row, words), and its number of words, at most ``max_bytes / 8``.

    Bits are combined before the shuffle; a row is 1,024 words, so the table stays small and dense.
    """
    words = max(1, min(expected * bits_per_key // 64 + 1, max_bytes // 8))
    words = -(-words // _ROW) * _ROW if words > _ROW else words
    row, word, mask = _spot(F.col(key), words)
    zero = keys.sparkSession.range(words).select(F.floor(F.col("id") / _ROW).cast("int").alias("row"), F.pmod("id", F.lit(_ROW)).cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    set_bits = keys.where(F.col(key).isNotNull()).select(row.alias("row"), word.alias("word"), mask.alias("mask"))
    each = set_bits.unionByName(zero).groupBy("row", "word").agg(F.bit_or("mask").alias("mask"))
    rows = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("cells"))
    return rows.select("row", F.transform("cells", lambda c: c["mask"]).alias("words")), words


def maybe_present(refs: DataFrame, key: str, filter_rows: DataFrame, words: int) -> DataFrame:
    """``refs`` with a column __maybe: false where the key certainly is in no parent, null for a null key."""
    row, word, mask = _spot(F.col(key), words)
    spot = refs.withColumn("__row", row).withColumn("__word", word).withColumn("__mask", mask)
    hit = F.element_at("words", F.col("__word") + 1).bitwiseAND(F.col("__mask")) == F.col("__mask")
    joined = spot.join(F.broadcast(filter_rows.withColumnRenamed("row", "__row")), "__row", "left")
    return joined.withColumn("__maybe", F.when(F.col(key).isNotNull(), F.coalesce(hit, F.lit(False)))).drop("__row", "__word", "__mask", "words")


def broken_references(refs: DataFrame, parents: DataFrame, key: str, at: str, parent_key: str = "id", deleted_at: str = "deleted_at", recorded_at: str = "recorded_at", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of ``refs`` whose ``key`` names no valid record of ``parents``, with a column kind.

    kind is missing (no such key), deleted (deleted_at set at whatever time) or late (recorded after ``at``).
    The broadcast filter settles the certain orphans; only the rest meet the parents. Null keys refer to nothing
    and give no row. A repeated parent key counts as one record: deleted if any of its rows is, recorded when the
    earliest was. A null time is never late. Without parents every reference is missing.
    """
    known = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias(key)).agg(
        F.max(F.col(deleted_at).isNotNull()).alias("__deleted"), F.min(recorded_at).alias("__recorded")
    )
    expected = parents.select(parent_key).count()
    filter_rows, words = bloom_filter(parents, parent_key, expected, max_bytes=max_bytes)
    rows = cut(maybe_present(refs.where(F.col(key).isNotNull()), key, filter_rows, words))  # read for hot keys, both kinds of join, and orphans
    orphans = rows.where(~F.col("__maybe")).drop("__maybe").withColumn("kind", F.lit("missing"))
    checked = lookup_join(rows.where("__maybe").drop("__maybe"), known, key)
    kind = F.when(F.col("__deleted").isNull(), "missing").when(F.col("__deleted"), "deleted").when(F.col("__recorded") > F.col(at), "late")
    checked = checked.withColumn("kind", kind).drop("__deleted", "__recorded").where("kind is not null")
    return orphans.unionByName(checked)


def month(at: str) -> Column:
    """yyyy-MM of a timestamp, whatever the session's zone."""
    return F.substring(F.col(at).cast("string"), 1, 7)
