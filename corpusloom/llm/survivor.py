"""The best record of each group of duplicates, field by field, by iterative truth discovery."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans import cut, hot_keys, lookup_join

# What people write where a value is missing, in lower case without white space around.
STAND_INS = (
    "unknown tbd tba tbc na n/a n.a. none null nil nan missing undefined unspecified uncategorised uncategorized unclassified todo pending empty blank untitled".split()
    + ["not available", "not applicable", "not specified", "not given", "no description", "(no description)", "no category", "see text", "to be added", "to be done", "to be determined", "to be defined", "to do", "not set", "not known"]
)
def says_something(value: Column) -> Column:
    """True unless a text value is null, blank, bare of letters and digits, or a stand-in for a missing value."""
    plain = F.regexp_replace(F.lower(value), r"(?U)^[\s(\[<]+|[\s)\]>.:!]+$", "")
    return F.coalesce(value.rlike(r"[\p{L}\p{N}]") & ~plain.isin([s.strip("().") for s in STAND_INS]), F.lit(False))


def ranked(claims: DataFrame) -> DataFrame:
    """(item, field, value, order): the claim of the best rank, then the smallest ``order``, for each item and field.

    What :func:`discover` comes to where a claim's rank outweighs all ranks below it together and no two claims tie:
    its first vote is then decided by rank and order alone, whatever the reliability of a voter, and so is every later one.
    """
    best = claims.groupBy("item", "field").agg(F.min(F.struct("rank", "order", "value")).alias("w"))
    return best.select("item", "field", "w.value", "w.order")


def discover(claims: DataFrame, rounds: int = 50, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over (item, field, value, voter, order).

    Each voter backs one value per item and field: that of its claim with the smallest ``order`` (a struct, unique).
    In turn, every value is given the sum of its voters' weights and the highest wins, the smaller ``order`` of its best
    claim among equals; and every voter's reliability moves halfway to the share of its claims that won (smoothed), until
    none moves by more than ``tolerance`` (in the first three rounds it moves all the way). A voter's weight is the log-odds of its reliability, a tenth at least. Halving
    the moves keeps winners from swapping for ever; should ``rounds`` not suffice, a warning says so.
    Gives (item, field, value, order) of the winners, order being the best claim's, and (voter, reliability).
    """
    keys = ["item", "field"]
    votes = claims.groupBy(*keys, "voter").agg(F.min(F.struct("order", "value")).alias("c"))
    votes = cut(votes.select(*keys, "voter", F.col("c.value").alias("value"), F.col("c.order").alias("order")))
    hot = cut(hot_keys(votes, "voter"))
    voters = cut(votes.select("voter").distinct().withColumn("reliability", F.lit(0.7)))
    for n in range(rounds):
        r = F.col("reliability")
        weighed = lookup_join(votes, voters.select("voter", F.greatest(F.log(r / (1 - r)), F.lit(0.1)).alias("weight")), "voter", "inner", hot)
        tallies = weighed.groupBy(*keys, "value").agg(F.sum("weight").alias("support"), F.min("order").alias("order"))
        # supports are rounded, so that the order of additions decides no tie
        top = F.min(F.struct((-F.round("support", 9)).alias("s"), "order", "value"))
        winners = tallies.groupBy(*keys).agg(top.alias("w")).select(*keys, F.col("w.value").alias("won"), F.col("w.order").alias("order"))
        winners = cut(winners)
        hits = votes.join(winners.select(*keys, "won"), keys).groupBy("voter").agg(((F.sum((F.col("value") == F.col("won")).cast("int")) + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("share"))
        both = cut(voters.join(hits, "voter").select("voter", "reliability", (r + (F.col("share") - r) * (1.0 if n < 3 else 0.5)).alias("next")))
        moved = both.agg(F.max(F.abs(F.col("next") - r))).first()[0] or 0.0
        voters = both.select("voter", F.col("next").alias("reliability"))
        if moved <= tolerance:
            break
    else:
        warnings.warn(f"truth discovery still moves by {moved:.2g} after {rounds} rounds", stacklevel=2)
    return winners.withColumnRenamed("won", "value"), voters


def survivors(records: DataFrame, groups: DataFrame, fields: list[str], sources: DataFrame | None = None, source_col: str = "source", at_col: str = "recorded_at", valid: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The surviving value of each field in each group, and how reliable each source proved.

    ``groups`` has (id, first_id), ``records`` id, the fields, a source and a time. A field in ``valid`` counts only if
    its value is in that one-column table of existing keys; the others only if they say something. With ``sources``
    (source, trust), 1 the most trusted, the order is given beforehand: trust, then the latest time, then the smallest
    id; a source that is unknown or null ranks after all others. It leaves nothing for reliability to decide, so one
    aggregate settles it (:func:`ranked`), and no reliability comes back. Without ``sources``, the sources are voters
    whose reliability is found out (:func:`discover`); within a voter the latest time counts, then the smallest id.
    A null time is the earliest. Repeated rows count once. A group in which no value counts has no row.
    Result: (first_id, field, value, concept_id).
    """
    r = records.select("id", *fields, source_col, at_col).where("id is not null").groupBy("id").agg(
        F.min(F.struct(*(F.col(c) for c in [*fields, source_col, at_col]))).alias("r")
    ).select("id", "r.*")
    r = r.join(groups.select("id", "first_id"), "id")
    if sources is not None:
        trust = sources.where("source is not null").groupBy(F.col("source").alias(source_col)).agg(F.min("trust").alias("trust"))
        r = lookup_join(r, trust, source_col).withColumn("rank", F.struct(F.col("trust").isNull(), "trust")).withColumn("voter", F.lit(None).cast("string"))
    else:
        r = r.withColumn("rank", F.lit(0)).withColumn("voter", F.coalesce(source_col, F.lit("")))
    r = cut(r)  # read once for each field
    micros = F.coalesce(-F.unix_micros(F.col(at_col).cast("timestamp")), F.lit((1 << 63) - 1))
    parts = []
    for f in fields:
        value = F.col(f).cast("string")
        part = r
        if valid and f in valid:
            keys = valid[f].select(F.col(valid[f].columns[0]).alias(f)).where(F.col(f).isNotNull()).distinct()
            part = lookup_join(part, keys.withColumn("__valid", F.lit(True)), f, "inner")
        else:
            part = part.where(says_something(value))
        parts.append(part.select(F.col("first_id").alias("item"), F.lit(f).alias("field"), value.alias("value"), "voter", "rank", F.struct(micros.alias("late"), F.col("id").alias("id")).alias("order")))
    claims = reduce(DataFrame.unionByName, parts)
    winners, voters = (ranked(claims), None) if sources is not None else discover(claims)
    return winners.select(F.col("item").alias("first_id"), "field", "value", F.col("order.id").alias("concept_id")), voters
