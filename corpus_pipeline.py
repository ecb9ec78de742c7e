"""The corpus pipeline: five stages over the table ``documents``, each the work of one operator of strata.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Defined results: nulls in any column are allowed, and other columns, whatever their names, pass through all stages but the
last, which reads doc_id and text alone; an empty table gives an empty one. Null, empty and blank texts fail the base rule
and so go in the second stage. Repeated rows share one verdict in the first two stages; of a class of near duplicates the
row with the smallest id stays (of rows that agree in id and words, one). A document with no words left is packed as its
end id. Very long texts are worked on whole. Without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import cutting_stock, order_minhash, quality_rules, substring_dedup, toxicity
from strata.llm.common import cut, documents, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the network finds toxic go; it learns from the labels of rows that aren't held out."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return toxicity.scored(docs, model, keep=tuple(docs.columns), name=score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond the fences of their language and source go."""
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return order_minhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that also stand earlier in the corpus go; all documents stay."""
    return substring_dedup.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    import public_tokenizers

    return cutting_stock.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can't express the network, the alignment and the packing; tests hold each stage, and all in turn, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
