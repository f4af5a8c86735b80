"""Writers: batches, reports and graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batches(df: DataFrame, path: str, by: str = "batch") -> None:
    """A folder of JSON lines per batch."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def graph_line(nodes: DataFrame, edges: DataFrame, name: str = "GRAPH_DATA") -> DataFrame:
    """One row: a script line that assigns nodes and edges. For graphs that one viewer can hold."""
    pack = lambda df, key: df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(F.struct(*df.columns).alias("data"))))).alias(key))
    both = pack(nodes, "n").crossJoin(F.broadcast(pack(edges, "e")))  # one row each
    body = F.concat(F.lit(f'const {name} = {{"nodes":['), F.array_join("n", ","), F.lit('],"edges":['), F.array_join("e", ","), F.lit("]};"))
    return both.select(body.alias("value"))


def graph_file(nodes: DataFrame, edges: DataFrame, path: str, name: str = "GRAPH_DATA") -> None:
    graph_line(nodes, edges, name).coalesce(1).write.mode("overwrite").text(path)


def left_over(df: DataFrame, path: str, missing: Column) -> None:
    """A report of the rows that could not be assigned."""
    df.where(missing).write.mode("overwrite").json(path)


def picture_path(name: Column, kind: str = "static", suffix: str = "png") -> Column:
    return F.concat(F.lit(f"{kind}/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit(f".{suffix}"))
