"""The queries over training text, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, formatting, harmful, leaks, lookalike, scanned, survivor, truncation
from corpusloom.plans import cut, spread


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def concept_groups(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.same_names(spread(read(spark, sf, "concepts").select("id", "name")))


def p3_survivors(spark: SparkSession, sf: str) -> DataFrame:
    groups = cut(concept_groups(spark, sf).where("copies > 1"))
    fields = ["description", "category", "section_id"]
    sections = read(spark, sf, "sections").select("id")
    return survivor.survivors(read(spark, sf, "concepts"), groups, fields, read(spark, sf, "extraction_sources"), valid={"section_id": sections})[0]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_survivors(spark, sf).select("first_id", "field", "concept_id")


def p3_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving values where no source is trusted beforehand, by truth discovery."""
    groups = cut(concept_groups(spark, sf).where("copies > 1"))
    sections = read(spark, sf, "sections").select("id")
    return survivor.survivors(read(spark, sf, "concepts"), groups, ["description", "category", "section_id"], valid={"section_id": sections})[0]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return concept_groups(spark, sf).where("id <> first_id").select("first_id", F.col("id").alias("concept_id"))


def p4_copies(spark: SparkSession, sf: str) -> DataFrame:
    return concept_groups(spark, sf).where("id = first_id").select("first_id", "copies")


#: Fields of a record of concepts that say what it describes.
RECORD = ("name", "category", "subcategory")


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    concepts = read(spark, sf, "concepts").select("id", *RECORD)
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in RECORD))
    return formatting.same_records(concepts, pairs)


TEXTS = (("concepts", "name"), ("paragraphs", "text"), ("concept_facts", "fact_text"))


def p5_texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [read(spark, sf, table).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), F.col(field).alias("text")) for table, field in TEXTS]
    return lookalike.one_form(reduce(DataFrame.unionByName, parts), "text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_texts(spark, sf).where("__damaged").select("table_name", "row_id").distinct()


def p5_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return p5_texts(spark, sf).select("table_name", "row_id", F.col("__text").alias("text"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(spread(read(spark, sf, "documents").select("doc_id", "text")))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(spread(read(spark, sf, "documents").select("doc_id", "text")), read(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.removal_spans(p9_leaks(spark, sf))


def p7_scored(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        read(spark, sf, table).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "source", F.col(field).alias("text"))
        for table, field in (("concepts", "quote"), ("concept_facts", "fact_text"))
    ]
    return truncation.truncated(reduce(DataFrame.unionByName, map(spread, parts)))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_scored(spark, sf).where("cut").select("table_name", "row_id").distinct()


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = p7_scored(spark, sf).select("table_name", "row_id", "source", "cut").distinct()
    return rows.groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg(F.col("cut").cast("int")), 4).alias("share_cut"))


def _severity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "source", "text")
    model = harmful.train(spark, *harmful.graded_texts(docs, read(spark, sf, "doc_labels")))
    return harmful.severity(spread(docs), model)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _severity(spark, sf).where(F.col("severity") >= harmful.SEVERE).select("doc_id")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _severity(spark, sf).select("doc_id", F.round("severity", 3).alias("severity"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    bad = (F.col("severity") >= harmful.SEVERE).cast("int")
    return _severity(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(bad), 4).alias("share_harmful"))


def _scans(spark: SparkSession, sf: str) -> tuple[DataFrame, scanned.LineModel]:
    pages, paragraphs = read(spark, sf, "pages"), read(spark, sf, "paragraphs")
    return scanned.damage(spread(pages.select("id", "textbook_id", "page_number", "raw_text")), spread(paragraphs.select("id", "page_id", "text")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf)[0].select("table_name", "row_id", "line_no", "kind", "word").distinct()


def p1_text(spark: SparkSession, sf: str) -> DataFrame:
    pages, paragraphs = read(spark, sf, "pages"), read(spark, sf, "paragraphs")
    rows = pages.select(F.lit("pages").alias("table_name"), F.col("id").alias("row_id"), F.col("raw_text").alias("text")).unionByName(
        paragraphs.select(F.lit("paragraphs").alias("table_name"), F.col("id").alias("row_id"), "text")
    )
    return scanned.repaired(rows, *_scans(spark, sf))


QUERIES = {
    "p3_found": p3_found, "p3_survivors": p3_survivors, "p3_discovered": p3_discovered, "p4_found": p4_found, "p4_copies": p4_copies, "p4_records": p4_records,
    "p5_found": p5_found, "p5_canonical": p5_canonical, "p8_ids": p8_ids,
    "p9_found": p9_found, "p9_leaks": p9_leaks, "p9_spans": p9_spans,
    "p7_found": p7_found, "p7_rates": p7_rates,
    "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
    "p1_found": p1_found,
    "p1_text": p1_text,
}
ORACLE: dict[str, str] = {}
