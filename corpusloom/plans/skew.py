"""Joins of a large table with a keyed one when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than this at any size.
HOT_SHARE = 200


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """The keys with more than ``1/share`` of the rows of ``df`` (fewer than ``share`` of them, so broadcastable).

    Counts are combined before the shuffle. Null keys are never hot: they join nothing.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return counts.join(F.broadcast(total), F.col("__n") * share > F.col("__total")).select(key)


def lookup_join(big: DataFrame, table: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``table``, whose ``key`` is unique, without sending a hot key's rows to one task.

    Rows with a hot key stay where they are and meet the few matching rows of ``table`` by broadcast (at most
    ``HOT_SHARE`` rows; a hot key that stands twice in ``table`` fails the job rather than widening the broadcast); the
    others are shuffled. Rows with a null key match nothing: with ``left`` they stay where they are too. ``how`` is left
    or inner. ``big`` is planned for the count of its keys, the hot and the other rows: :func:`cut` it where it is costly.
    """
    hot = hot_keys(big, key) if hot is None else hot
    is_hot = F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot")))
    marked = big.join(is_hot, key, "left")
    rest = [c for c in table.columns if c != key]
    few = table.join(is_hot, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(0).alias("__0"), *rest)).alias("__t"))
    once = F.when(F.col("__n") == 1, F.col("__t")).otherwise(F.raise_error(F.lit(f"lookup_join: {key} is not unique")).cast(few.schema["__t"].dataType))
    few = few.select(key, once.alias("__t")).select(key, *(F.col(f"__t.{c}").alias(c) for c in rest))
    stays = F.col("__hot").isNotNull() | F.col(key).isNull() if how == "left" else F.col("__hot").isNotNull()
    cold = marked.where(F.col("__hot").isNull() & F.col(key).isNotNull()).drop("__hot").join(table, key, how)
    warm = marked.where(stays).drop("__hot").join(F.broadcast(few), key, how)
    return cold.unionByName(warm)


def coin(column: Column, salt: int) -> Column:
    """A fair pseudo-random bit of a key, the same on every run."""
    return F.xxhash64(column, F.lit(salt)).bitwiseAND(1)
