"""Range, as-of, interval and containment lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import clip
from corpusloom.operators.windows import holding
from corpusloom.plans import cut


def sibling_ends(sections: DataFrame, last: int = 20) -> DataFrame:
    """``sections`` (id, book, parent, page_start, page_end) with range_end: the stated end, else the page before the
    next sibling that starts later, else ``last`` pages on. Null without a start. Siblings that start together share it."""
    keys = ["book", "parent"]
    starts = sections.where("page_start is not null").select(*keys, "page_start").distinct()
    after = starts.withColumn("__next", F.lead("page_start").over(Window.partitionBy(*keys).orderBy("page_start")))
    on = [sections[k].eqNullSafe(after[k]) for k in keys] + [sections.page_start == after.page_start]
    joined = sections.join(after, on, "left").select(sections["*"], "__next")
    end = F.coalesce("page_end", F.col("__next") - 1, F.col("page_start") + last)
    return joined.withColumn("range_end", F.when(F.col("page_start").isNotNull(), end)).drop("__next")


def in_range(ranges: DataFrame, rows: DataFrame, point: str, start: str, end: str, by: list[str], width: int = 64) -> DataFrame:
    """Every row with each range of its keys that holds its point, both ends included.

    An equi-join on keys and buckets of ``width`` points, so that no range meets all rows; a range is repeated once
    per bucket that it touches. Ranges with a null end are left out.
    """
    r = ranges.where(f"{start} <= {end}").withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = rows.withColumn("__b", F.floor(F.col(point) / width))
    return r.join(p, [*by, "__b"]).where(F.col(point).between(F.col(start), F.col(end))).drop("__b")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: Column, tie: Column, name: str = "found") -> DataFrame:
    """``rows`` with the value of the last of ``marks`` at or before them; the greatest ``tie`` among simultaneous ones.

    One union and one window over keys and time; no join, so no pair is ever made.
    """
    lo = marks.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__kind"), tie.cast("long").alias("__tie"), value.alias("__v"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in by))
    hi = rows.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__tie"), F.lit(None).cast(lo.schema["__v"].dataType).alias("__v"), *(c for c in rows.columns if c not in by))
    w = Window.partitionBy(*by).orderBy("__at", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("__kind") == 0, F.struct("__v")), ignorenulls=True).over(w)
    return lo.unionByName(hi).withColumn(name, state["__v"]).where("__kind = 1").select(*rows.columns, name)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key by a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def with_fallback(first: DataFrame, second: DataFrame, key: str, row: str, enough: int) -> DataFrame:
    """The rows of ``first``; for keys with fewer than ``enough`` of them also those of ``second`` not yet there."""
    a = first.withColumn("rank", F.lit(1))
    b = second.withColumn("rank", F.lit(2))
    w = Window.partitionBy(key)
    both = a.unionByName(b).groupBy(key, row).agg(F.min("rank").alias("rank"))
    return both.withColumn("__n", F.sum((F.col("rank") == 1).cast("int")).over(w)).where((F.col("rank") == 1) | (F.col("__n") < enough)).drop("__n")


def quote_home(quotes: DataFrame, texts: DataFrame, quote: str, text: str, order: str, shortest: int = 20, opening: int = 60) -> DataFrame:
    """Each quote with the first text, by ``order``, that holds its opening, wherever in a word that begins or ends.

    The distinct openings are looked for in one pass over the texts, see :func:`windows.holding`; no text is copied or
    paired. Quotes below ``shortest`` characters are left out, nulls and empty ones too.
    """
    q = cut(quotes.where(F.length(quote) >= max(shortest, 1)).distinct().withColumn("__n", clip(F.col(quote), opening)))
    found = holding(texts, cut(q.select("__n").distinct()), text, "__n", order, max(1, min(shortest, opening)))
    return q.join(found.withColumnRenamed(order, "home"), "__n").select(*quotes.columns, "home")


def containing(texts: DataFrame, names: list[str], text: str, order: list[str], limit: int = 20) -> DataFrame:
    """(name, the columns of ``order``): for each of the stated names the first ``limit`` texts that hold it, whatever the
    case, by ``order`` (total). One pass over the texts; at most ``limit`` rows a name and task reach the ranking."""
    asked = F.array(*(F.lit(n) for n in sorted(set(names))))
    hits = texts.select(*order, F.explode(F.filter(asked, lambda n: F.contains(F.lower(text), F.lower(n)))).alias("name"))
    return top_k(hits, ["name"], [F.col(c) for c in order], limit)


def by_id_or_name(rows: DataFrame, table: DataFrame, row_id: str, row_name: str, value: str) -> DataFrame:
    """``rows`` with the value of the table's row of the same id, else of the same name whatever its case."""
    ids = table.select(F.col("id").alias(row_id), F.col(value).alias("__by_id"))
    names = table.groupBy(F.lower(F.trim("name")).alias("__n")).agg(F.min_by(value, "id").alias("__by_name"))
    out = rows.withColumn("__n", F.lower(F.trim(row_name))).join(ids, row_id, "left").join(names, "__n", "left")
    how = F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_name").isNotNull(), "name").otherwise("none")
    return out.select(*rows.columns, F.coalesce("__by_id", "__by_name").alias("matched"), how.alias("matched_by"))
