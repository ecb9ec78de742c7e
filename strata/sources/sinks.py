"""Sinks: nested and flat JSON, CSV and Markdown of trees and evidence, and loading them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import two_places
from .stage import staged

NODE = "node_id string, title string, level int, start_char bigint, end_char bigint, start_index int, end_index int, summary string"


def node_struct(*extra: Column) -> Column:
    """A node with the names of the exchange format."""
    return F.struct("node_id", "title", "level", "start_char", "end_char", F.col("start_chunk").alias("start_index"), F.col("end_chunk").alias("end_index"), "summary", *extra)


def nested_json(nodes: DataFrame) -> DataFrame:
    """(doc_no, structure): trees as JSON text; nodes: with depth and summary. Nodes stand in pre-order, so the depth of the
    next one tells what a node opens or closes."""
    after = F.lead("depth").over(W.partitionBy("doc_no").orderBy("ord"))
    slim = nodes.select("doc_no", "ord", "depth", after.alias("next"), F.rtrim(F.to_json(node_struct()), F.lit("}")).alias("json"))
    closed = lambda n: F.concat(F.lit("}"), F.repeat(F.lit("]}"), n))
    piece = F.when(F.col("next") > F.col("depth"), F.lit(',"nodes":[')).when(F.col("next").isNull(), closed(F.col("depth"))).otherwise(F.concat(closed(F.col("depth") - F.col("next")), F.lit(",")))
    g = slim.select("doc_no", F.struct("ord", F.concat("json", piece).alias("json")).alias("x")).groupBy("doc_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("doc_no", F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["json"]), ""), F.lit("]")).alias("structure"))


def save_index(nodes: DataFrame, path: str) -> None:
    nested_json(nodes).write.json(path)


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_no, node_id, parent_id, …) from saved trees: levels are unnested one after the other."""
    kind = f"array<struct<{NODE.replace(' string', ': string').replace(' int', ': int').replace(' bigint', ': bigint')}, nodes: string>>"
    told = spark.read.schema("doc_no bigint, structure string").json(path)
    level = told.select("doc_no", F.lit(None).cast("string").alias("parent_id"), F.explode(F.from_json("structure", kind)).alias("n"))
    out = None
    while out is None or not level.isEmpty():  # as deep as the trees are
        level = staged(level, "level")
        here = level.select("doc_no", "parent_id", *[f"n.{x.split()[0]}" for x in NODE.split(", ")])
        out = here if out is None else out.unionByName(here)
        level = level.filter("n.nodes is not null").select("doc_no", F.col("n.node_id").alias("parent_id"), F.explode(F.from_json("n.nodes", kind)).alias("n"))
    return out


def evidence_rows(found: DataFrame) -> DataFrame:
    """Evidence as the columns of the CSV export; found: with title and excerpts."""
    return found.select("node_id", "title", two_places(F.col("score")).alias("relevance_score"), "match_reason", F.size("excerpts").alias("excerpt_count"), F.substring(F.coalesce(F.try_element_at("excerpts", F.lit(1)), F.lit("")), 1, 200).alias("first_excerpt"))


def save_csv(found: DataFrame, path: str) -> None:
    evidence_rows(found).write.option("header", True).csv(path)


def markdown_report(found: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, report): number, mean and the best evidence of each topic as Markdown text; ties in document order."""
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_no", "ord")
    best = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)  # ranked before anything is gathered
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), two_places(F.col("score")), F.lit(")"))
    shown = best.select("query_id", "r", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l"))
    told = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).join(shown, "query_id")
    head = F.concat(F.lit("# Evidence\n\nTotal: "), F.col("n").cast("string"), F.lit("\nAverage: "), two_places(F.round("mean", 9)), F.lit("\n\n"))
    return told.select("query_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("report"))
