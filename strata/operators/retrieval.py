"""Retrieval over nodes: scoring, ranked search, expansion along references, evidence by topic, excerpts, batches, answers.

A scorer is anything with ``score(queries, nodes) -> (query_id, doc_no, node_id, score)``. The default compares words by
an equi-join, so pairs without a common word never exist; ``ModelScorer`` sends batches of titles and summaries to a
function on the executors. Texts join in only after filters and limits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import sentences, word_set


@dataclass(frozen=True)
class SearchConfig:
    relevance_threshold: float = 0.6
    max_results: int = 20
    follow_references: bool = True


@dataclass(frozen=True)
class EvidenceConfig:
    relevance_threshold: float = 0.6
    excerpt_threshold: float = 0.75
    max_excerpts: int = 5
    excerpt_chars: int = 1000
    batch_size: int = 10
    token_budget: int = 30_000


class Scorer(Protocol):
    def score(self, queries: DataFrame, nodes: DataFrame) -> DataFrame: ...


class LexicalScorer:
    """Share of the smaller word set that both have; of a node the title and 150 characters of its summary are read."""

    def score(self, queries: DataFrame, nodes: DataFrame) -> DataFrame:
        q = queries.select("query_id", word_set(F.col("query")).alias("ws")).select("query_id", F.size("ws").alias("nq"), F.explode("ws").alias("w"))
        n = nodes.select("doc_no", "node_id", "ord", word_set(F.concat(F.col("title"), F.lit(" - "), F.substring(F.coalesce("summary", F.lit("")), 1, 150))).alias("ws"))
        n = n.select("doc_no", "node_id", "ord", F.size("ws").alias("nn"), F.explode("ws").alias("w"))
        both = n.join(q, "w").groupBy("query_id", "doc_no", "node_id", "ord", "nq", "nn").agg(F.count(F.lit(1)).alias("n"))
        return both.select("query_id", "doc_no", "node_id", "ord", (F.col("n") / F.least("nq", "nn")).alias("score"))


@dataclass
class ModelScorer:
    """``model(query, [(node_id, title, summary)]) -> {node_id: score}`` over batches; nodes it leaves out score 0.1, those of a
    batch that it fails on 0.3."""

    model: Callable
    batch_size: int = 10
    missing: float = field(default=0.1)
    failed: float = field(default=0.3)

    def score(self, queries: DataFrame, nodes: DataFrame) -> DataFrame:
        w = W.partitionBy("doc_no").orderBy("ord")
        batched = nodes.withColumn("batch", F.floor((F.row_number().over(w) - 1) / self.batch_size)).groupBy("doc_no", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "title", F.substring(F.coalesce("summary", F.lit("")), 1, 150).alias("summary")))).alias("nodes"))
        model, missing, failed = self.model, self.missing, self.failed

        def run(batches):
            for pdf in batches:
                rows = []
                for q, text, doc, ns in zip(pdf.query_id, pdf["query"], pdf.doc_no, pdf.nodes, strict=True):
                    try:
                        got = model(text, [(x["node_id"], x["title"], x["summary"]) for x in ns])
                        rows += [(q, doc, x["node_id"], x["ord"], float(got.get(x["node_id"], missing))) for x in ns]
                    except Exception:  # a batch that a model fails on mustn't end the job
                        rows += [(q, doc, x["node_id"], x["ord"], failed) for x in ns]
                yield type(pdf)(rows, columns=["query_id", "doc_no", "node_id", "ord", "score"])

        asked = batched.join(F.broadcast(queries.select("query_id", "query")), F.lit(True))  # every query with every batch is what is asked for
        return asked.mapInPandas(run, "query_id bigint, doc_no bigint, node_id string, ord int, score double")


def summaries(node_texts: DataFrame, most: int = 500) -> DataFrame:
    """Adds the extractive summary: the first two sentences, cut; texts of 100 characters or less have none."""
    s = F.substring(F.array_join(sentences(F.col("text"), 2), " "), 1, most)
    return node_texts.withColumn("summary", F.when(F.length("text") > 100, s))


def search(queries: DataFrame, nodes: DataFrame, config: SearchConfig = SearchConfig(), scorer: Scorer | None = None) -> DataFrame:
    """(query_id, doc_no, node_id, ord, score, rank): each document's best nodes, ties in document order."""
    s = (scorer or LexicalScorer()).score(queries, nodes).filter(F.col("score") >= config.relevance_threshold)
    w = W.partitionBy("query_id", "doc_no").orderBy(F.col("score").desc(), "ord")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= config.max_results)


def expand(found: DataFrame, queries: DataFrame, nodes: DataFrame, resolved: DataFrame, config: SearchConfig = SearchConfig(), scorer: Scorer | None = None) -> DataFrame:
    """The nodes that found ones refer to and that aren't found themselves, scored like them, if relevant."""
    r = resolved.filter("resolved").select(F.col("doc_no").alias("d"), F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"))
    more = found.join(r, (F.col("doc_no") == F.col("d")) & (F.col("node_id") == F.col("s"))).select("query_id", "doc_no", F.col("t").alias("node_id")).distinct()
    more = more.join(found.select("query_id", "doc_no", "node_id"), ["query_id", "doc_no", "node_id"], "left_anti")
    s = (scorer or LexicalScorer()).score(queries, nodes).filter(F.col("score") >= config.relevance_threshold)
    return s.join(more, ["query_id", "doc_no", "node_id"]).select("query_id", "doc_no", "node_id", "ord", "score")


def evidence(queries: DataFrame, nodes: DataFrame, config: EvidenceConfig = EvidenceConfig(), scorer: Scorer | None = None) -> DataFrame:
    """Every relevant node of every document for every topic, without a limit."""
    return (scorer or LexicalScorer()).score(queries, nodes).filter(F.col("score") >= config.relevance_threshold)


def excerpts(found: DataFrame, queries: DataFrame, node_texts: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """Adds the sentences of a node that hold a word of the query of five letters or more, for scores from the excerpt threshold on."""
    q = queries.select(F.col("query_id").alias("q"), F.filter(word_set(F.col("query")), lambda w: F.length(w) >= 5).alias("terms"))
    t = node_texts.select(F.col("doc_no").alias("d"), F.col("node_id").alias("n"), F.split("text", r"(?<=[.!?])\s+").alias("parts"))
    j = found.filter(F.col("score") >= config.excerpt_threshold).join(q, F.col("query_id") == F.col("q")).join(t, (F.col("doc_no") == F.col("d")) & (F.col("node_id") == F.col("n")))
    with_term = F.filter("parts", lambda s: F.arrays_overlap(word_set(s), F.col("terms")))
    return j.select(*found.columns, F.transform(F.slice(with_term, 1, config.max_excerpts), lambda s: F.substring(s, 1, config.excerpt_chars)).alias("excerpts"))


def batches(items: DataFrame, by: list[str], order: str, chars: Column, budget: int, most: int, cap: int | None = None) -> DataFrame:
    """(by, order, batch): greedy batches in order, each of at most ``budget`` tokens (3.5 characters each) and ``most`` items;
    the first item of a batch is always taken. A fold over each group's own list."""
    size = F.floor((F.least(chars, F.lit(cap)) if cap else chars) / F.lit(3.5)).cast("long")
    rows = items.select(*by, F.struct(F.col(order).alias("o"), size.alias("t")).alias("x")).groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    empty = F.expr("cast(array() as array<struct<o:int,b:int>>)")
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("t"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["n"] > 0) & ((s["t"] + x["t"] > budget) | (s["n"] >= most))
        b = s["b"] + new.cast("int")
        return F.struct(b.alias("b"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, x["t"]).otherwise(s["t"] + x["t"]).alias("t"), F.concat(s["out"], F.array(F.struct(x["o"].cast("int").alias("o"), b.alias("b")))).alias("out"))

    return rows.select(*by, F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("r")).select(*by, F.col("r.o").alias(order), F.col("r.b").alias("batch"))


def answers(queries: DataFrame, nodes: DataFrame, node_texts: DataFrame, max_iterations: int = 5, scorer: Scorer | None = None) -> DataFrame:
    """(query_id, doc_no, step, node_id, node_title, excerpt, start_char, end_char): the deterministic policy reads the best unread
    node at each step, so its steps are the best nodes; each gives a citation of 500 characters."""
    s = (scorer or LexicalScorer()).score(queries, nodes)
    w = W.partitionBy("query_id", "doc_no").orderBy(F.col("score").desc(), "ord")
    top = s.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= max_iterations)
    t = node_texts.select(F.col("doc_no").alias("d"), F.col("node_id").alias("n"), F.col("title").alias("node_title"), F.substring("text", 1, 500).alias("excerpt"), "start_char", "end_char")
    return top.join(t, (F.col("doc_no") == F.col("d")) & (F.col("node_id") == F.col("n"))).select("query_id", "doc_no", "step", "node_id", "node_title", "excerpt", "start_char", "end_char")


def structure_view(nodes: DataFrame) -> DataFrame:
    """(doc_no, view): a document's nodes in order, indented by depth, with 60 characters of their summaries; nodes: with depth and summary."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("["), F.col("node_id"), F.lit("] "), F.col("title"), F.when(F.length(F.coalesce("summary", F.lit(""))) > 0, F.concat(F.lit(" - "), F.substring("summary", 1, 60), F.lit("..."))).otherwise(F.lit("")))
    g = nodes.select("doc_no", "ord", line.alias("line")).groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return g.select("doc_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("view"))


NOT_FOUND = "No evidence was found for this question."


def evidence_summary(found: DataFrame, most: int = 15, each: int = 2, chars: int = 300) -> DataFrame:
    """(query_id, n, summary): of each topic's best evidence a line with its title and the begin of its first excerpts;
    found: with title and excerpts."""
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_no", "node_id")
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.array_join(F.transform(F.slice("excerpts", 1, each), lambda x: F.substring(x, 1, chars)), " | "))
    best = found.select("query_id", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(W.partitionBy("query_id")).alias("n"), line.alias("line")).filter(F.col("r") <= most)
    g = best.groupBy("query_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("r", "line"))).alias("l"))
    return g.select("query_id", "n", F.concat(F.format_string("Found %d relevant sections\n", "n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("summary"))


def answer(queries: DataFrame, nodes: DataFrame, node_texts: DataFrame, max_iterations: int = 5, threshold: float = 0.15, scorer: Scorer | None = None) -> DataFrame:
    """(query_id, answer, confidence, visited, trace) of every question: the deterministic policy reads the best unread node
    of the corpus at each step, until none is relevant or the steps are used up. Confidence is the best score; a question
    without evidence has the fixed answer and confidence 0."""
    s = (scorer or LexicalScorer()).score(queries, nodes).filter(F.col("score") >= threshold)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_no", "ord")
    read = s.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= max_iterations)
    t = node_texts.select(F.col("doc_no").alias("d"), F.col("node_id").alias("n"), "title", F.substring("text", 1, 500).alias("excerpt"))
    told = read.join(t, (F.col("doc_no") == F.col("d")) & (F.col("node_id") == F.col("n"))).groupBy("query_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("step", "doc_no", "node_id", "title", "excerpt"))).alias("steps"))
    all_ = queries.select("query_id").join(told, "query_id", "left")
    each = lambda f, sep: F.array_join(F.transform("steps", f), sep)
    return all_.select(
        "query_id", F.coalesce(each(lambda x: F.concat(F.lit("["), x["title"], F.lit("] "), x["excerpt"]), "\n\n"), F.lit(NOT_FOUND)).alias("answer"), F.coalesce("best", F.lit(0.0)).alias("confidence"),
        F.coalesce(each(lambda x: F.concat(x["doc_no"].cast("string"), F.lit(":"), x["node_id"]), ","), F.lit("")).alias("visited"),
        F.coalesce(each(lambda x: F.concat(F.lit("step "), x["step"].cast("string"), F.lit(": read "), x["title"]), "; "), F.lit("no relevant section")).alias("trace"))
