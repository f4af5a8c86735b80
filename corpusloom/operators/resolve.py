"""Entity resolution: keys, components, canonical records, repointed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans import cut, lookup_join


def key_links(records: DataFrame, keys: dict[str, Column], id_col: str = "id") -> DataFrame:
    """(a, b): each record linked to the smallest id that shares one of its keys. Stars, never all pairs of a group."""
    long = records.select(F.col(id_col).alias("a"), F.explode(F.array(*(F.struct(F.lit(n).alias("how"), k.alias("key")) for n, k in keys.items()))).alias("k"))
    long = long.select("a", "k.how", "k.key").where("key is not null and key <> ''")
    long = cut(long.select("a", F.concat_ws("\n", "how", "key").alias("key")))
    least = long.groupBy("key").agg(F.min("a").alias("b"))
    return lookup_join(long, least, "key", "inner").where("a <> b").select("a", "b").distinct()


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that each node is linked to, however indirectly.

    Alternating large-star and small-star steps: a logarithmic number of rounds, each an aggregate and a join on the
    link table, which never grows. Stops when the links no longer change.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        near = lookup_join(both, least, "a", "inner")  # a hub's links stay where they are
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    pairs = cut(links.select("a", "b").where("a <> b").distinct())
    last = None
    # links that are stars already, each end but the smallest in one link only, need no step
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    chained = pairs.select(F.col("b").alias("a")).join(pairs.select("a"), "a", "left_semi").unionByName(many)
    settled = pairs.where("a < b").isEmpty() and chained.isEmpty()
    while not settled:
        pairs = cut(star(star(pairs, True), False))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    found = pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
    if nodes is None:
        return found
    return nodes.select(F.col(nodes.columns[0]).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def contained(names: DataFrame, shortest: int = 3, ratio: float = 0.5, bounded: int = 5) -> DataFrame:
    """(short, long) of distinct names of which one holds the other: at least ``ratio`` as long, or whole words of at
    least ``bounded`` characters. Candidates share a three-letter piece, the rarest of the shorter name, so that common
    pieces make few pairs."""
    n = names.select(F.col(names.columns[0]).alias("name")).where(F.length(names.columns[0]) >= shortest).distinct()
    piece = F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring("name", i, F.lit(3)))
    pieces = n.select("name", F.explode(F.array_distinct(piece)).alias("g"))
    often = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rare = lookup_join(pieces, often, "g", "inner").groupBy(F.col("name").alias("short")).agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    pairs = rare.join(pieces.select("g", F.col("name").alias("long")), "g").where("short <> long and contains(long, short)")
    whole = F.concat(F.lit(" "), "long", F.lit(" ")).contains(F.concat(F.lit(" "), "short", F.lit(" ")))
    return pairs.where((F.length("short") >= ratio * F.length("long")) | ((F.length("short") >= bounded) & whole)).select("short", "long")


def canonical(records: DataFrame, groups: DataFrame, score: Column) -> DataFrame:
    """(component, canonical): the record with the best score, the smallest id among equals."""
    return records.join(groups, "id").groupBy("component").agg(F.max_by("id", F.struct(score.alias("s"), (-F.col("id")).alias("i"))).alias("canonical"))


def repoint(edges: DataFrame, mapping: DataFrame, ends: list[str], keep: list[str], id_col: str = "id") -> DataFrame:
    """Edges moved to the canonical records; loops dropped, the smallest id kept of equal ones. ``mapping`` is (id, canonical),
    ids unique. An end that is not in it stays, a null end too; a record with many edges is not sent to one task."""
    mapping = cut(mapping)
    for end in ends:
        m = mapping.select(F.col("id").alias(end), F.col("canonical").alias("__c"))
        edges = lookup_join(edges, m, end).withColumn(end, F.coalesce("__c", end)).drop("__c")
    if len(ends) == 2:
        edges = edges.where(F.col(ends[0]) != F.col(ends[1]))
    return edges.groupBy(*ends, *keep).agg(F.min(id_col).alias(id_col))


def score(name: Column, description: Column, section: Column, category: Column) -> Column:
    """How good a record is as the one that stays: a long description, a clean and short name, a section, a category."""
    n = F.coalesce(name, F.lit(""))
    return (
        F.length(F.coalesce(description, F.lit(""))) + F.when(n.rlike(r"^Algorithm\s+\d"), -1000).otherwise(0) + F.when(n.rlike("^[a-z]"), 50).otherwise(0)
        - 0.1 * F.length(n) + F.when(section.isNotNull(), 20).otherwise(0) + F.when(category.isNotNull(), 10).otherwise(0)
    )


def merged(records: DataFrame, groups: DataFrame, rank: Column, longest: str, first: list[str]) -> DataFrame:
    """(component, the longest value of ``longest``, the first non-null value of the others by ``rank``, then id)."""
    rows = records.join(groups, "id")
    order = F.struct(rank.alias("r"), F.col("id").alias("i"))
    kept = (F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in first)
    return rows.groupBy("component").agg(F.min(F.when(F.col(longest).isNotNull(), F.struct((-F.length(longest)).alias("l"), order.alias("o"), F.col(longest).alias("v"))))["v"].alias(longest), *kept)


def suspicious(names: Column, descriptions: Column, general: tuple[str, ...]) -> Column:
    """Why a record looks odd: an array of reasons, empty if none."""
    why = F.array(F.when(F.length(names) <= 2, "short"), F.when(F.lower(names).isin(*general), "general"), F.when(F.coalesce(descriptions, F.lit("")) == "", "no description"))
    return F.filter(why, lambda x: x.isNotNull())
