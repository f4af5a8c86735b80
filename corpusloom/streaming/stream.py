"""Streams of texts and events. An extension: nothing here has a counterpart in a batch pipeline over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.classify import paragraph_type
from corpusloom.sources.ingest import lines


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with their type: stateless, so the same on a stream as on a table."""
    return lines(docs, id_col, text_col).withColumn("type", paragraph_type(F.col("text")))


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per window and kind; what comes later than ``late`` behind the newest is dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
