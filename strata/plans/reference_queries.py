"""Queries on metadata and on references between sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import metadata as M
from ..operators import references as R
from ..sources.stage import staged
from ..sources.tables import filings, sql_string
from . import sql as Q
from . import structure_queries as SQ


def _shown(df):
    return df.withColumn("key_numbers", M.flat_numbers(F.col("key_numbers"))).withColumn("filing_date", F.date_format("filing_date", "yyyy-MM-dd")).withColumn("period_end_date", F.date_format("period_end_date", "yyyy-MM-dd"))


def metadata_extract(s, d):
    return _shown(M.extract(filings(s, d)))


def key_numbers(s, d):
    return M.extract(filings(s, d)).select("doc_no", F.explode("key_numbers").alias("name", "value"))


def fiscal_quarter(s, d):
    return M.extract(filings(s, d)).filter("fiscal_quarter is not null").groupBy("fiscal_year", "fiscal_quarter").agg(F.count(F.lit(1)).alias("n"))


def metadata_merge(s, d):
    """Each filing's metadata with what it lacks from the filing before it."""
    m = M.extract(filings(s, d))
    return _shown(M.merge(m, m.withColumn("doc_no", F.col("doc_no") + 1)))


def _refs(s, d):
    return R.detect(SQ.node_texts(s, d))


def _resolved(s, d):
    """(references with their targets, nodes), the documents read once."""
    f, n = SQ.documents_and_nodes(s, d)
    return R.resolve(staged(R.detect(SQ.with_text(n, f)), "references"), n), n


def xref_detect(s, d):
    return _refs(s, d).select("doc_no", "source_node_id", "ref_type", "ref_id", "target_description", "reference_text")


def xref_resolve(s, d):
    return _resolved(s, d)[0].select("doc_no", "source_node_id", "target_description", "target_node_id", "resolved")


def xref_graph(s, d):
    return R.graph(_resolved(s, d)[0]).withColumn("targets", F.array_join("targets", ","))


def xref_referenced(s, d):
    return R.referenced(*_resolved(s, d)).select("doc_no", "source_node_id", "target_node_id", "target_title")


def xref_referencing(s, d):
    return R.referencing(_resolved(s, d)[0])


def xref_network(s, d):
    """References by type: how many, how many resolved, from how many nodes."""
    return _resolved(s, d)[0].groupBy("ref_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("n_resolved"), F.count_distinct("doc_no", "source_node_id").alias("n_sources"))


# ---- SQL ------------------------------------------------------------------------------------------------------

_C = ["%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%d-%b-%Y", "%d %B %Y"]
_day = lambda c: f"try_strptime({c}, [" + ", ".join(f"'{x}'" for x in _C) + "])"
_field = lambda n: f"nullif(regexp_replace(regexp_extract(substr(text, 1, 20000), {sql_string('(?im)' + P.FIELDS[n])}, 1), '^\\s+|\\s+$', '', 'g'), '') AS {n}"
_numbers = lambda p="": "array_to_string(list_sort(list_filter([" + ", ".join(f"'{n}=' || {p}{n}" for n in P.NUMBERS) + "], lambda x: x IS NOT NULL)), ';')"
META = Q.filings_sql() + ", raw AS (SELECT doc_no, doc_name, " + ", ".join(_field(n) for n in P.FIELDS) + f""" FROM filings),
meta AS (SELECT doc_no, rtrim(company_name, ',.') AS company_name, coalesce(ticker, nullif(regexp_extract(doc_name, '^([A-Z]{{1,5}})[-_]', 1), '')) AS ticker, cik, strftime({_day('filing_date')}, '%Y-%m-%d') AS filing_date, strftime({_day('period_end')}, '%Y-%m-%d') AS period_end_date,
  coalesce(CAST(fiscal_year AS INTEGER), CAST(nullif(regexp_extract(doc_name, '[_-](\\d{{4}})[_.-]', 1), '') AS INTEGER)) AS fiscal_year, CAST(quarter({_day('period_end')}) AS INTEGER) AS fiscal_quarter, {", ".join(P.NUMBERS)} FROM raw)"""


def _refs_sql() -> str:
    parts = []
    for i, (p, kind) in enumerate(P.REFERENCES):
        q = sql_string("(?i)" + p)
        parts.append(f"""SELECT doc_no, node_id, text, {i} AS prio, unnest(range(1, len(c))) AS pos, '{kind}' AS ref_type, c FROM (SELECT doc_no, node_id, text, string_split(regexp_replace(text, {q}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS c FROM nodetexts) WHERE len(c) > 1""")
    ids = "CASE prio " + " ".join(f"WHEN {i} THEN regexp_extract(m, {sql_string('(?i)' + p)}, 1)" for i, (p, _) in enumerate(P.REFERENCES)) + " END"
    return Q.NODES + f""",
nodetexts AS (SELECT n.doc_no, n.node_id, substr(t.text, n.start_char + 1, n.end_char - n.start_char) AS text FROM nodes n JOIN typed t USING (doc_no)),
hits AS ({" UNION ALL ".join(parts)}),
placed_refs AS (SELECT doc_no, node_id, text, prio, pos, ref_type, string_split(c[pos + 1], chr(2))[1] AS m, list_sum(list_transform(c[1:pos], lambda x: length(x) - CASE WHEN contains(x, chr(2)) THEN 1 ELSE 0 END)) AS start FROM hits),
named_refs AS (SELECT *, {ids} AS ref_id FROM placed_refs),
refs AS (SELECT doc_no, node_id AS source_node_id, prio, pos, ref_type, ref_id, upper(ref_type[1]) || ref_type[2:] || ' ' || ref_id AS target_description,
  regexp_replace(substr(text, CAST(greatest(start - 50, 0) + 1 AS BIGINT), CAST(start + length(m) + 50 - greatest(start - 50, 0) AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS reference_text
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_no, node_id, ref_type, ref_id ORDER BY prio, pos) AS r FROM named_refs) WHERE r = 1),
resolved AS (SELECT r.*, CASE WHEN t IS NOT NULL THEN printf('%04d', t) END AS target_node_id, t IS NOT NULL AS resolved FROM
  (SELECT r.*, (SELECT min(n.ord) FROM nodes n WHERE n.doc_no = r.doc_no AND contains(lower(n.title), r.ref_type) AND contains(lower(n.title), lower(r.ref_id))) AS t FROM refs r) r)"""


REFS = _refs_sql()
_MERGED = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in (*M.SCALARS, *P.NUMBERS))
ORACLES = {
    "metadata_extract": Q.with_(META, f"SELECT doc_no, {', '.join(M.SCALARS)}, {_numbers()} AS key_numbers FROM meta"),
    "key_numbers": Q.with_(META, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_no, '{n}' AS name, {n} AS value FROM meta" for n in P.NUMBERS) + ") WHERE value IS NOT NULL"),
    "fiscal_quarter": Q.with_(META, "SELECT fiscal_year, fiscal_quarter, count(*) AS n FROM meta WHERE fiscal_quarter IS NOT NULL GROUP BY ALL"),
    "metadata_merge": Q.with_(META, f"SELECT doc_no, {', '.join(M.SCALARS)}, {_numbers()} AS key_numbers FROM (SELECT a.doc_no, {_MERGED} FROM meta a LEFT JOIN meta b ON b.doc_no + 1 = a.doc_no)"),
    "xref_detect": Q.with_(REFS, "SELECT doc_no, source_node_id, ref_type, ref_id, target_description, reference_text FROM refs"),
    "xref_resolve": Q.with_(REFS, "SELECT doc_no, source_node_id, target_description, target_node_id, resolved FROM resolved"),
    "xref_graph": Q.with_(REFS, "SELECT doc_no, source_node_id AS node_id, string_agg(target_node_id, ',' ORDER BY prio, pos) AS targets FROM resolved WHERE resolved GROUP BY doc_no, source_node_id"),
    "xref_referenced": Q.with_(REFS, "SELECT r.doc_no, r.source_node_id, r.target_node_id, n.title AS target_title FROM resolved r JOIN nodes n ON n.doc_no = r.doc_no AND n.node_id = r.target_node_id"),
    "xref_referencing": Q.with_(REFS, "SELECT DISTINCT doc_no, target_node_id AS node_id, source_node_id FROM resolved WHERE resolved"),
    "xref_network": Q.with_(REFS, "SELECT ref_type, count(*) AS n, count_if(resolved) AS n_resolved, count(DISTINCT (doc_no, source_node_id)) AS n_sources FROM resolved GROUP BY ref_type"),
}
QUERIES = {k: globals()[k] for k in ORACLES}
