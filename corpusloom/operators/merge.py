"""Validated merges: a status per update, a report of the statuses, an overlay of what is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.classify import Rules, first_match


def with_status(updates: DataFrame, rules: Rules, ok: str = "ok") -> DataFrame:
    """``updates`` with the first objection to each as status."""
    return updates.withColumn("status", first_match(rules, ok))


def allowed(updates: DataFrame, pairs: list[tuple[str, str]], category: str, subcategory: str, known: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Status of taxonomy updates: invalid_category, invalid_pair, unknown_id or ok. The pairs are a stated, short list."""
    cats = sorted({c for c, _ in pairs})
    sound = F.array(*(F.lit(f"{c}\n{s}") for c, s in pairs))
    df = updates if known is None else updates.join(known.select(key).distinct().withColumn("__k", F.lit(True)), key, "left")
    rules: Rules = [
        ("invalid_category", ~F.coalesce(F.col(category).isin(cats), F.lit(False))),
        ("invalid_pair", ~F.coalesce(F.array_contains(sound, F.concat_ws("\n", category, subcategory)), F.lit(False))),
    ]
    if known is not None:
        rules.append(("unknown_id", F.col("__k").isNull()))
    return with_status(df, rules).drop("__k")


def last_valid(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last sound update per key, as an aggregate."""
    rest = [c for c in updates.columns if c not in (key, "status")]
    got = updates.where("status = 'ok'").groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("u"))
    return got.select(key, *(F.col(f"u.{c}").alias(c) for c in rest))


def overlay(base: DataFrame, updates: DataFrame, key: str, columns: list[str], nulls_too: bool = False) -> DataFrame:
    """``base`` with the updates' columns where there is an update; with ``nulls_too`` its nulls overwrite as well."""
    u = updates.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if nulls_too else F.coalesce(f"__{c}", c) for c in columns}
    return base.join(u, key, "left").withColumns(new).select(*base.columns)


def report(statuses: DataFrame, *by: str) -> DataFrame:
    return statuses.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def insert_new(base: DataFrame, rows: DataFrame, key: Column | str, order: str) -> DataFrame:
    """``base`` with the rows whose key it lacks, the first of each by ``order``; existing rows stay as they are."""
    k = F.col(key) if isinstance(key, str) else key
    rest = rows.columns
    fresh = rows.withColumn("__k", k).join(base.select(k.alias("__k")), "__k", "left_anti")
    first = fresh.groupBy("__k").agg(F.min_by(F.struct(*rest), order).alias("r")).select("r.*")
    return base.unionByName(first.select(*base.columns), allowMissingColumns=True)


def link_new(links: DataFrame, rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``links`` with the new pairs (a, b) whose two ends exist and that are not linked yet."""
    a, b = links.columns
    sound = rows.select(a, b).distinct().join(left.select(F.col(left.columns[0]).alias(a)), a, "left_semi").join(right.select(F.col(right.columns[0]).alias(b)), b, "left_semi")
    return links.unionByName(sound.select(a, b).join(links, [a, b], "left_anti"))


def apply_facts(concepts: DataFrame, facts: DataFrame, updates: DataFrame, types: list[str], shortest: int = 10) -> DataFrame:
    """The facts to insert from ``updates`` (concept_id, facts array): for existing concepts that had none before, trimmed
    and long enough, an unknown type made property, a missing rank 99."""
    sound = updates.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").join(facts.select("concept_id"), "concept_id", "left_anti")
    each = sound.select("concept_id", F.explode("facts").alias("f")).select("concept_id", F.trim("f.fact_text").alias("fact_text"), "f.fact_type", "f.importance_rank")
    kind = F.when(F.col("fact_type").isin(types), F.col("fact_type")).otherwise("property")
    return each.where(F.length("fact_text") >= shortest).withColumns({"fact_type": kind, "importance_rank": F.coalesce("importance_rank", F.lit(99))})


def late_parents(sections: DataFrame) -> DataFrame:
    """``sections`` (ord, number, parent_number) with the ord of their parent if it stands earlier, else null."""
    firsts = sections.where("number is not null").groupBy(F.col("number").alias("parent_number")).agg(F.min("ord").alias("__p"))
    return sections.join(firsts, "parent_number", "left").withColumn("parent_ord", F.when(F.col("__p") < F.col("ord"), F.col("__p"))).drop("__p")
