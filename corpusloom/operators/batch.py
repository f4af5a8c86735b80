"""Batches of an ordered table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans import cut


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with positions from 1 in the order of ``order``, without sorting in one task.

    Ranged by the order once, written, and read for both steps: each range's rows are counted (a row per range) and
    numbered from the sum of those before it. Rows that tie are told apart by a hash of the whole row, so that a hot key
    is spread over several ranges; equal rows take neighbouring positions. Nulls come first. An empty table stays empty.
    """
    ranged = cut(df.withColumn("__h", F.xxhash64(*df.columns)).repartitionByRange(*order, "__h").withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__b"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order, "__h"))
    return ranged.withColumn("__l", local).join(F.broadcast(before), "__p", "left").withColumn(name, (F.col("__l") + F.col("__b")).cast("long")).drop("__p", "__l", "__b", "__h")


def fixed(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with batch: numbers from 1, ``size`` rows each but for the last."""
    return numbered(df, order, "__pos").withColumn("batch", F.floor((F.col("__pos") - 1) / size) + 1).drop("__pos")


def by_group(df: DataFrame, group: str, batches: int, leave_out: Column | None = None) -> DataFrame:
    """``df`` with batch: whole groups in order, equally many groups each, the last takes the rest. A null group comes first."""
    kept = df if leave_out is None else df.where(~F.coalesce(leave_out, F.lit(False)))
    ranks = cut(numbered(kept.select(group).distinct(), [group], "__r"))
    per = max(ranks.count() // batches, 1)
    table = ranks.select(F.coalesce(F.hash(group), F.lit(0)).alias("__h"), F.col(group).alias("__g"), F.least(F.floor((F.col("__r") - 1) / per) + 1, F.lit(batches)).alias("batch"))
    keyed = kept.withColumn("__h", F.coalesce(F.hash(group), F.lit(0)))
    return keyed.join(table, (keyed["__h"] == table["__h"]) & keyed[group].eqNullSafe(table["__g"])).select(*df.columns, "batch")


def summary(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(batch, label, n): the span of ids and the number of rows of each batch."""
    ids = F.format_string("ids %d-%d", F.min(id_col), F.max(id_col))
    return df.groupBy("batch").agg(ids.alias("label"), F.count(F.lit(1)).alias("n"))
