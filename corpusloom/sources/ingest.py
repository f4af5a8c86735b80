"""Readers: lines of texts, tables, JSON files, transcripts, marked-up lists, graph files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, text): the lines of each text that are not blank, trimmed, numbered from 0 among themselves.

    Within the row: no shuffle, no window. Null texts have no lines.
    """
    kept = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\S"))
    return docs.select(id_col, F.posexplode(kept).alias("line_no", "text"))


def parse_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that ``parse`` makes of each binary file, such as the pages of a document in a format Spark can't read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([{"path": p, **row} for row in parse(content)])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def table_parts(cells: Column) -> Column:
    """struct(headers, rows) of a table as an array of arrays; missing cells are empty."""
    full = F.transform(cells, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
    return F.when(F.size(cells) > 0, F.struct(F.get(full, 0).alias("headers"), F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))).alias("rows")))


def json_files(spark: SparkSession, paths: list[str], schema: str, whole: bool = True) -> DataFrame:
    """JSON files, with the file's name; in order of names where a later file wins."""
    return spark.read.schema(schema).json(paths, multiLine=whole).withColumn("file", F.col("_metadata.file_path"))


def transcript_payload(rows: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """The first usable payload per file: what a tool was given to write, else a JSON array in a fence.

    Lines that are no JSON are passed over. As an aggregate, so that long files need no sort.
    """
    schema = "message struct<content:array<struct<type:string,name:string,text:string,input:struct<content:string>>>>"
    parsed = rows.select(file, order, F.posexplode(F.from_json(text, schema)["message"]["content"]).alias("k", "b"))
    written = F.when(F.col("b.type") == "tool_use", F.col("b.input.content"))
    fenced = F.regexp_extract("b.text", r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    each = parsed.select(file, F.struct(order, "k").alias("o"), written.alias("w"), F.when(fenced != "", fenced).alias("f"))
    best = each.groupBy(file).agg(F.min_by("w", F.when(F.col("w").isNotNull(), F.col("o"))).alias("w"), F.min_by("f", F.when(F.col("f").isNotNull(), F.col("o"))).alias("f"))
    return best.select(file, F.coalesce("w", "f").alias("payload"))


def blocks(rows: DataFrame, doc: str = "doc_id", order: str = "line_no", text: str = "text") -> DataFrame:
    """A list in blocks parted by blank lines: (doc, block, group, topic, item, note) from the first line, the second and
    those after; a note follows "#", lines that start with it are passed over, as are blocks without items."""
    w = Window.partitionBy(doc).orderBy(order)
    b = rows.withColumn("block", F.sum(F.when(F.trim(text) == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.where((F.trim(text) != "") & ~F.ltrim(text).startswith("#"))
    inner = Window.partitionBy(doc, "block").orderBy(order)
    b = b.withColumn("n", F.row_number().over(inner)).withColumn("group", F.first(F.trim(text)).over(inner)).withColumn("topic", F.nth_value(F.trim(text), 2).over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = F.split(text, "#", 2)
    return b.where("n > 2").select(doc, "block", "group", "topic", F.trim(parts[0]).alias("item"), F.trim(F.get(parts, 1)).alias("note"))


def graph_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The object assigned in a script file ("const NAME = {...};")."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.from_json(F.regexp_replace("value", r"(?s)^\s*(?:const|let|var)\s+\w+\s*=\s*|;\s*$", ""), schema).alias("graph")).select("graph.*")
