"""Taking results over into tables: concepts and relations, patches by id, additions that may be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.classify import reject_annotated
from corpusloom.functions.text import strip
from corpusloom.operators.merge import insert_new, with_status
from corpusloom.plans import cut, lookup_join

# Relation types that are taken over, and another name for one of them.
RELATIONS = "contrasts_with example_of generalizes prerequisite proved_by special_case_of uses".split()
ALIASES = {"equivalent_to": "uses"}


def new_concepts(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` (id, name, description) with the names of ``found`` (name, description, ord) that it lacks.

    Of a name's records, whatever its case, the longest description counts, the first among equals; names that are no
    concept are left out. New ids follow the largest known one in the order of ``ord``.
    """
    key = F.lower(strip(F.col("name")))
    best = found.where("name is not null").groupBy(key.alias("key")).agg(F.min(F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("l"), "ord", "name", "description")).alias("b")).select("key", "b.ord", "b.name", "b.description")
    fresh = best.where(~reject_annotated(F.col("name"))).join(known.where("name is not null").select(key.alias("key")).distinct(), "key", "left_anti")
    from corpusloom.operators.batch import numbered

    placed = numbered(fresh.select("ord", "name", "description"), ["ord"], "n")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return known.select("id", "name", "description").unionByName(placed.join(F.broadcast(top), F.lit(True)).select((F.col("n") + F.col("top")).alias("id"), "name", "description"))


def relation_statuses(concepts: DataFrame, relations: DataFrame, types: list[str] = RELATIONS, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """``relations`` (source, target by name, relation, ord) with source_id, target_id and a status: bad_type,
    unknown_source, unknown_target, self, duplicate (not the first of its kind) or ok. Names and types are compared in
    lower case without white space around; of equal names the smallest id counts."""
    clean = lambda c: F.lower(strip(F.col(c)))
    names = cut(concepts.where("name is not null").groupBy(clean("name").alias("key")).agg(F.min("id").alias("id")))
    kind = clean("relation")
    for other, meant in aliases.items():
        kind = F.when(kind == other, meant).otherwise(kind)
    rows = relations.select("ord", clean("source").alias("s"), clean("target").alias("t"), kind.alias("relation"))
    for end in ("s", "t"):
        rows = cut(lookup_join(rows, names.select(F.col("key").alias(end), F.col("id").alias(f"{end}_id")), end))
    sound = F.coalesce(F.col("relation").isin(types) & (F.col("s_id") != F.col("t_id")), F.lit(False))
    first = cut(rows.where(sound).groupBy("s_id", "t_id", "relation").agg(F.min("ord").alias("ord"))).select("ord", F.lit(True).alias("first"))
    rules = [("bad_type", ~F.coalesce(F.col("relation").isin(types), F.lit(False))), ("unknown_source", F.col("s_id").isNull()), ("unknown_target", F.col("t_id").isNull()), ("self", F.col("s_id") == F.col("t_id")), ("duplicate", F.col("first").isNull())]
    return with_status(rows.join(first, "ord", "left"), rules).select("ord", F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), "relation", "status")


def chapters(concepts: DataFrame, sections: DataFrame, homes: DataFrame) -> DataFrame:
    """(id, section, how): a section for each concept (id, section, batch): its own if it has one (kept); else that of
    the page where its quote stands, by the last section that starts there or before (quote); else the commonest
    section among its batch, the smallest of equals (batch); else none. ``sections`` is (section, page_start), ``homes``
    (id, page)."""
    from corpusloom.operators.lookup import as_of
    from corpusloom.operators.report import mode

    marks = sections.where("page_start is not null").select(F.lit(1).alias("one"), F.col("page_start").alias("page"), "section")
    pages = homes.where("page is not null").select(F.lit(1).alias("one"), "page").distinct()
    at = cut(as_of(pages.withColumn("p", F.col("page")), marks, ["one"], "page", F.col("section"), F.col("section")).select("page", F.col("found").alias("by_quote")))
    quoted = lookup_join(homes.groupBy("id").agg(F.min("page").alias("page")), at, "page").select("id", "by_quote")
    common = mode(concepts.where("section is not null and batch is not null"), ["batch"], "section").select("batch", F.col("section").alias("by_batch"))
    rows = lookup_join(cut(concepts.join(quoted, "id", "left")), common, "batch")
    how = F.when(F.col("section").isNotNull(), "kept").when(F.col("by_quote").isNotNull(), "quote").when(F.col("by_batch").isNotNull(), "batch").otherwise("none")
    return rows.select("id", F.coalesce("section", "by_quote", "by_batch").alias("section"), how.alias("how"))


def remove(concepts: DataFrame, edges: DataFrame, facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the concepts of ``gone`` (id), and without the edges and facts that hang on them. A null
    end or key hangs on nothing."""
    gone = cut(gone.select("id").distinct())
    kept = edges
    for end in ("source_id", "target_id"):
        kept = kept.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return concepts.join(gone, "id", "left_anti"), kept.select(*edges.columns), facts.join(gone.select(F.col("id").alias("concept_id")), "concept_id", "left_anti").select(*facts.columns)


def patch(table: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """``table`` with columns changed as stated; null counts as no change."""
    return table.withColumns({c: F.coalesce(new, F.col(c)) for c, new in changes.items()})


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` (id, name, ...) with those of ``new`` whose id it lacks, and whose name, whatever its case, too."""
    fresh = new.join(nodes.select("id"), "id", "left_anti")
    return insert_new(nodes, fresh.select(*nodes.columns), F.lower("name"), "id")
