"""Sources: tables of a folder, texts, and the corpus of synthetic filings made from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in a filing: the size of one stays bounded however many documents there are.
BODIES = 25
#: (first lines, name) by number of the filing modulo 4; {} is the number.
KINDS = (
    ("FORM 10-K\nANNUAL REPORT PURSUANT TO SECTION 13\nCompany Name: Acme Holdings, Inc.\nCIK: 0001234567\nTrading Symbol: ACME\nFiling Date: February 15, 2024\nFor the fiscal year ended December 31, 2023\nFiscal Year: 2023\nTotal Revenue: $ {},500 million\nNet Income: $ 1{}.5 million\nTotal Assets: 9{},000\n", "ACME_10K_2024.txt"),
    ("FORM 10-Q\nQuarterly report\nRegistrant: Globex & Co\nStock Symbol: GLBX\nDate Filed: 2024-05-07\nFor the quarter ended March 31, 2024\nDiluted EPS: $1.{}\nStockholders' Equity: $ 7{} million\n", "GLBX-10Q_2024.txt"),
    ("Third quarter 2024 earnings call\nThank you for joining\nOperator\n", "transcript_2023.txt"),
    ("Notes on what was found\n", "NOTES_2022-x.txt"),
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, text): one row for each text file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_name"), F.col("value").alias("text"))


def normalized(text):
    """Line ends as the line feed alone."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_no, doc_name, text): BODIES documents each, with parts, items, notes and references."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", normalized(F.coalesce("text", F.lit(""))).alias("text"))
    k = F.col("doc_id") % BODIES
    s = lambda c: c.cast("string")
    part = F.when(k % 10 == 0, F.concat(F.lit("PART "), F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("III")), (k / 10).cast("int") + 1), F.lit("\n"))).otherwise(F.lit(""))
    refs = F.concat(F.lit("As described in Item "), s(k * 3 % BODIES + 1), F.lit(" and in Appendix G, see Note "), s(k * 2 % BODIES), F.lit(" (Note 3). See Part II on page "), s(k + 1), F.lit(".\n"))
    note = F.when(k % 7 == 3, F.concat(F.lit("NOTE "), s(k), F.lit(". Details\n"))).otherwise(F.lit(""))
    body = F.concat(part, F.lit("ITEM "), s(k + 1), F.lit(". "), F.upper("source"), F.lit("\n"), refs, note, F.col("text"))
    no = F.expr(f"doc_id div {BODIES}")
    bodies = d.select(no.alias("doc_no"), "doc_id", body.alias("body")).groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("doc_id", "body"))).alias("b"))
    joined = F.array_join(F.transform("b", lambda x: x["body"]), "\n\n")
    first, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (lines, file) in enumerate(KINDS):
        a, *rest = lines.split("{}")
        parts = [F.lit(a)]
        for r in rest:
            parts += [s(F.col("doc_no")), F.lit(r)]
        first = F.when(F.col("doc_no") % 4 == i, F.concat(*parts)).otherwise(first)
        name = F.when(F.col("doc_no") % 4 == i, F.lit(file)).otherwise(name)
    return bodies.select("doc_no", name.alias("doc_name"), F.concat(first, joined).alias("text"))


def sql_string(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def filings_sql() -> str:
    """The same corpus as SQL common table expressions (``filings``)."""
    first = " ".join(f"WHEN {i} THEN " + " || doc_no || ".join(sql_string(x) for x in lines.split("{}")) for i, (lines, _) in enumerate(KINDS))
    name = " ".join(f"WHEN {i} THEN {sql_string(f)}" for i, (_, f) in enumerate(KINDS))
    return f"""bodies AS (SELECT doc_id // {BODIES} AS doc_no, doc_id, doc_id % {BODIES} AS k, source, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
told AS (SELECT doc_no, doc_id, CASE WHEN k % 10 = 0 THEN 'PART ' || ['I', 'II', 'III'][k // 10 + 1] || chr(10) ELSE '' END || 'ITEM ' || (k + 1) || '. ' || upper(source) || chr(10)
  || 'As described in Item ' || (k * 3 % {BODIES} + 1) || ' and in Appendix G, see Note ' || (k * 2 % {BODIES}) || ' (Note 3). See Part II on page ' || (k + 1) || '.' || chr(10)
  || CASE WHEN k % 7 = 3 THEN 'NOTE ' || k || '. Details' || chr(10) ELSE '' END || t AS body FROM bodies),
filings AS (SELECT doc_no, CASE doc_no % 4 {name} END AS doc_name, CASE doc_no % 4 {first} END || string_agg(body, chr(10) || chr(10) ORDER BY doc_id) AS text FROM told GROUP BY doc_no)"""
