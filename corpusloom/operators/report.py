"""Counts, shares, modes and nested groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans import cut


def counts(df: DataFrame, *by: str, nulls: str | None = None) -> DataFrame:
    """Rows per group; a null group bears the name ``nulls``, if one is given."""
    named = df.withColumns({c: F.coalesce(c, F.lit(nulls)) for c in by}) if nulls is not None else df
    return named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """(field, filled, total, share) for each of the columns, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), "total") for c in columns)))
    return one.select(rows.alias("r")).select("r.*").withColumn("share", F.round(F.col("filled") / F.col("total"), 4))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value per group, the smallest among equals. Counted first, so no group is collected."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), value)).alias("m")).select(*by, f"m.{value}", "m.n")


def nested(df: DataFrame, by: list[str], order: list[Column], **fields: Column) -> DataFrame:
    """A JSON array of objects per group, in order. For groups that fit a row, as one node's facts do."""
    got = F.sort_array(F.collect_list(F.struct(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("o"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("v"))))
    return df.groupBy(*by).agg(F.to_json(F.transform(got, lambda x: x["v"])).alias("items"))


def nested_chunks(df: DataFrame, by: list[str], order: list[Column], size: int = 1000, **fields: Column) -> DataFrame:
    """The arrays of :func:`nested` in chunks of ``size`` items, numbered from 1 in order, so that a hot group fits too.

    ``order`` must be total within a group. Rows are ranged by group and order and numbered within their range; a range
    adds the items that its group has in the ranges before. Null keys are a group.
    """
    keys, orders = [f"__k{k}" for k in range(len(by))], [f"__o{k}" for k in range(len(order))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), *(c.alias(o) for c, o in zip(order, orders)), F.struct(*(c.alias(n) for n, c in fields.items())).alias("__v"))
    rows = cut(rows.repartitionByRange(*keys, *orders).withColumn("__p", F.spark_partition_id()))
    sizes = rows.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = rows.withColumn("__l", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*orders)) - 1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = local.alias("a").join(first.alias("b"), [*same, F.col("a.__p") == F.col("b.__p")]).select("a.*", "__b")
    chunked = placed.withColumn("chunk", (F.floor((F.col("__l") + F.col("__b")) / size) + 1).cast("long"))
    got = F.sort_array(F.collect_list(F.struct(F.struct(*orders).alias("o"), F.col("__v").alias("v"))))
    return chunked.groupBy(*keys, "chunk").agg(F.to_json(F.transform(got, lambda x: x["v"])).alias("items")).withColumnsRenamed(dict(zip(keys, by)))


def repeated(df: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Groups of several rows, with their number and smallest id."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("least")).where("n > 1")


def longest(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The longest value per group, the first by ``order`` among equals."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.length(value), -F.col(order))).alias(value))


def info(books: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages and sections of each book."""
    p = pages.groupBy(F.col("textbook_id").alias("id")).agg(F.countDistinct("id").alias("pages"))
    s = sections.groupBy(F.col("textbook_id").alias("id")).agg(F.countDistinct("id").alias("sections"))
    filled = books.select("id").distinct().join(p, "id", "left").join(s, "id", "left")
    return filled.select("id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("sections", F.lit(0)).alias("sections"))
