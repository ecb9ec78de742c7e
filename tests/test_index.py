"""A whole index, answers and evidence summaries; trees as deep as they are; how often plans read the documents."""

import re

from pyspark.sql import functions as F

from strata.operators import indexing as X
from strata.operators import retrieval as T
from strata.operators import structure as S
from strata.plans import reference_queries as RQ
from strata.plans import retrieval_queries as RT
from strata.plans import structure_queries as SQ
from strata.sources import sinks
from strata.sources.cache import ParquetCache

LONG = "These words are said at some length so that a summary is made of them. There are more sentences here. And one more of them."
FILED = f"FORM 10-K\nCIK: 0001234567\nPART I\n{LONG}\nITEM 1. Business\n{LONG} See Item 7.\nITEM 2. Land\nshort\nPART II\nITEM 7. Results\n{LONG}"


def test_build_index(spark):
    docs = spark.createDataFrame([(1, "a_10K_2024.txt", FILED), (2, "b.txt", LONG), (3, "c.txt", ""), (4, "d.txt", None)], "doc_no bigint, doc_name string, text string")
    index = X.build_index(docs)
    nodes = {(r.doc_no, r.title): r for r in index.nodes.collect()}
    assert nodes[2, "Document"].level == 0 and nodes[2, "Document"].summary == ". ".join(LONG.split(". ")[:2]) + "." and {d for d, _ in nodes} == {1, 2}
    part = nodes[1, "PART I"]
    assert part.summary.startswith("- ITEM 1. Business: ITEM 1. Business") and "ITEM 2" not in part.summary  # a short child has none
    assert nodes[1, "Introduction"].summary.startswith("- PART I: - ITEM 1. Business") and len(nodes[1, "Introduction"].summary) <= 500
    assert {(r.target_description, r.resolved) for r in index.references.collect()} == {("Item 7", True)}
    got = X.stats(index).filter("doc_no = 1").first()
    assert (got.nodes, got.with_metadata, got.max_depth) == (6, 1, 2) and got.with_references == index.references.select("source_node_id").distinct().count()
    assert X.find_node(index.nodes, "0001").filter("doc_no = 1").first().title == "PART I" and X.char_range(docs, 5, 9).first().text == "10-K"


def test_answers(spark):
    nodes = spark.createDataFrame([(1, f"{i:04d}", i, t, None, f"text of {t}") for i, t in enumerate(["red apple", "green apple", "blue sky"])], "doc_no bigint, node_id string, ord int, title string, summary string, text string")
    q = spark.createDataFrame([(1, "red apple"), (2, "submarine")], "query_id bigint, query string")
    got = {r.query_id: r for r in T.answer(q, nodes, nodes, max_iterations=2, threshold=0.2).collect()}
    assert got[1].visited == "1:0000,1:0001" and got[1].trace == "step 1: read red apple; step 2: read green apple" and got[1].confidence == 1.0
    assert (got[2].answer, got[2].confidence, got[2].visited) == (T.NOT_FOUND, 0.0, "")
    found = nodes.withColumn("query_id", F.lit(1)).withColumn("score", F.lit(0.5)).withColumn("excerpts", F.array(F.lit("a" * 400), F.lit("b"), F.lit("c")))
    line = T.evidence_summary(found, most=2).first().summary.split("\n")
    assert line[0] == "Found 3 relevant sections" and len(line) == 3 and line[1] == "- red apple: " + "a" * 300 + " | b"


def test_deep_trees(spark, tmp_path):
    rows = [(1, f"{i:04d}", i, f"{i - 1:04d}" if i else None, f"t{i}", i, 0, 1, 0, 1, "s") for i in range(9)]
    nodes = spark.createDataFrame(rows, "doc_no bigint, node_id string, ord int, parent_id string, title string, level int, start_char bigint, end_char bigint, start_chunk int, end_chunk int, summary string")
    deep = S.depths(nodes)
    assert {(r.ord, r.depth, len(r.path)) for r in deep.collect()} == {(i, i, i + 1) for i in range(9)}
    sinks.save_index(deep, str(tmp_path / "t"))
    assert {(r.node_id, r.parent_id) for r in sinks.load_nodes(spark, str(tmp_path / "t")).collect()} == {(r[1], r[3]) for r in rows}


def test_more_new_entries_than_room(spark, tmp_path):
    c = ParquetCache(spark, str(tmp_path / "cache"), max_size=3)
    c.set_many(spark.createDataFrame([("old", "v")], "key string, value string"))
    c.set_many(spark.createDataFrame([(f"k{i}", "v") for i in range(6)], "key string, value string"))
    assert {r.key for r in c.entries().collect()} == {"k5", "k4", "k3"}


def test_scans(spark, tmp_path):
    """A query reads the documents once; what is read again was staged."""
    text = "\n".join(f"ITEM {i}. Part\nSee Item {i + 1} and more words" for i in range(5))
    spark.createDataFrame([(i, text, "a") for i in range(3)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "more words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for f in (SQ.detect_type, SQ.chunks_full, SQ.tree_nodes, SQ.tree_stats, SQ.node_context, RQ.xref_detect, RQ.xref_resolve, RQ.xref_referenced, RT.search_topk, RT.search_expand, RT.markdown_report):
        plan = f(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation \[doc_id", plan)) <= 1, f.__name__
