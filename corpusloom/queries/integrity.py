"""Queries p2 and p6: hierarchies and broken references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.hierarchy import all_descendants, hierarchy, number_parents, subtree_sizes
from corpusloom.operators.references import broken_references, month


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(number_parents(_read(spark, sf, "sections")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return section_tree(spark, sf).select(F.col("id").alias("section_id"), "root_id", F.col("depth").cast("int").alias("depth"), "path")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return subtree_sizes(section_tree(spark, sf)).select(F.col("id").alias("section_id"), "descendants")


def p2_descendant_list(spark: SparkSession, sf: str) -> DataFrame:
    return all_descendants(section_tree(spark, sf)).select(F.col("id").alias("section_id"), "descendant")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for table, fields, parents in (("concept_relationships", ["source_id", "target_id"], "concepts"), ("concept_facts", ["paragraph_id"], "paragraphs")):
        rows = _read(spark, sf, table).select("id", *fields, "recorded_at").distinct()
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("ref")) for f in fields)))
        refs = rows.select("id", "recorded_at", each.alias("r")).select("id", "recorded_at", "r.field", "r.ref").distinct()
        found = broken_references(refs, _read(spark, sf, parents).select("id", "deleted_at", "recorded_at"), "ref", "recorded_at")
        parts.append(found.select(F.lit(table).alias("table_name"), "field", F.col("id").alias("row_id"), month("recorded_at").alias("period"), "kind"))
    return parts[0].unionByName(parts[1])


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return p6_found(spark, sf).groupBy("table_name", "field", "period", "kind").agg(F.count(F.lit(1)).alias("n"))


_CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  upper(translate(number, '０１２３４５６７８９．ＡＢＣＤＥＦＧＨ', '0123456789.ABCDEFGH')),
  '^[^0-9A-Z]*(?:SECTION|SECT|SEC|CHAPTER|CHAP|CH|APPENDIX|APP)([^A-Z]|$)', '\\1'), '[^0-9A-Z.]+', '', 'g'), '\\.{2,}', '.', 'g'), '^\\.|\\.$', '', 'g')"""

_TREE = rf"""WITH RECURSIVE s AS (SELECT id, min(textbook_id) textbook_id, min(parent_id) parent_id, nullif(min({_CLEAN}), '') number FROM sections GROUP BY id),
nums AS (SELECT textbook_id, number, min(id) pid FROM s WHERE number IS NOT NULL GROUP BY ALL),
l AS (SELECT s.id, CASE WHEN s.parent_id IS NOT NULL THEN (CASE WHEN s.parent_id IN (SELECT id FROM s) THEN s.parent_id END) ELSE n.pid END parent
  FROM s LEFT JOIN nums n ON n.textbook_id = s.textbook_id AND contains(s.number, '.') AND n.number = regexp_replace(s.number, '\.[^.]*$', '')),
t AS (SELECT id, id root_id, 0 depth, id::varchar path FROM l WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.id FROM l JOIN t ON l.parent = t.id),
u AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM t)),
r AS (SELECT id, parent cur FROM u UNION SELECT r.id, u.parent FROM r JOIN u ON r.cur = u.id),
ring AS (SELECT id FROM r WHERE id = cur),
c AS (SELECT r.id, min(r.cur) root_id, r.id IN (SELECT id FROM ring) on_it FROM r WHERE r.cur IN (SELECT id FROM ring) GROUP BY r.id)
"""

_UNDER = """, x AS (SELECT unnest(string_split(path, '/'))::bigint id, id descendant FROM t),
under AS (SELECT id, descendant FROM x WHERE id <> descendant UNION ALL SELECT DISTINCT cur, id FROM r WHERE id <> cur)"""

QUERIES = {"p2_found": p2_found, "p2_descendants": p2_descendants, "p2_descendant_list": p2_descendant_list, "p6_found": p6_found, "p6_report": p6_report}

_P6 = """WITH cp AS (SELECT id, bool_or(deleted_at IS NOT NULL) del, min(recorded_at) rec FROM concepts GROUP BY id),
pp AS (SELECT id, bool_or(deleted_at IS NOT NULL) del, min(recorded_at) rec FROM paragraphs GROUP BY id),
refs AS (SELECT DISTINCT 'concept_relationships' table_name, 'source_id' field, id row_id, source_id k, recorded_at FROM concept_relationships
  UNION ALL SELECT DISTINCT 'concept_relationships', 'target_id', id, target_id, recorded_at FROM concept_relationships
  UNION ALL SELECT DISTINCT 'concept_facts', 'paragraph_id', id, paragraph_id, recorded_at FROM concept_facts),
f AS (SELECT table_name, field, row_id, strftime(r.recorded_at, '%Y-%m') period,
  CASE WHEN coalesce(cp.id, pp.id) IS NULL THEN 'missing' WHEN coalesce(cp.del, pp.del) THEN 'deleted' WHEN coalesce(cp.rec, pp.rec) > r.recorded_at THEN 'late' END kind
  FROM refs r LEFT JOIN cp ON field <> 'paragraph_id' AND cp.id = r.k LEFT JOIN pp ON field = 'paragraph_id' AND pp.id = r.k WHERE r.k IS NOT NULL)
"""

ORACLE = {
    "p2_found": _TREE + "SELECT id section_id, root_id, depth::int depth, path FROM t UNION ALL SELECT id, root_id, -1, CASE WHEN on_it THEN 'cycle' ELSE 'below' END FROM c",
    "p2_descendants": _TREE + _UNDER + " SELECT l.id section_id, coalesce(n, 0)::bigint descendants FROM l LEFT JOIN (SELECT id, count(*) n FROM under GROUP BY id) USING (id)",
    "p2_descendant_list": _TREE + _UNDER + " SELECT id section_id, descendant FROM under",
    "p6_found": _P6 + "SELECT * FROM f WHERE kind IS NOT NULL",
    "p6_report": _P6 + "SELECT table_name, field, period, kind, count(*) n FROM f WHERE kind IS NOT NULL GROUP BY ALL",
}
