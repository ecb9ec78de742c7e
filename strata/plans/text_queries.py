"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.packing import simple_pieces
from ..operators.structure import roman_value
from ..sources.tables import load

_docs = lambda s, d: load(s, d, "documents")
_DATES = ["yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "dd-MMM-yyyy", "d MMMM yyyy"]
_C_DATES = ["%Y-%m-%d", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%b-%Y", "%d %B %Y"]


def doc_hash_id(s, d):
    return _docs(s, d).select("doc_id", X.hash_id(F.col("text")).alias("hash_id"), X.hash_id(F.col("text"), "doc").alias("prefixed"))


def truncate_text(s, d):
    return _docs(s, d).select("doc_id", X.truncate(F.col("text"), 100).alias("short"))


def truncate_middle(s, d):
    return _docs(s, d).select("doc_id", X.truncate_middle(F.col("text"), 200).alias("short"))


def clean_text(s, d):
    return load(s, d, "pages").select("page_id", F.md5(X.clean(F.concat(F.lit(" \r\n\n\n\n\t"), F.replace("html", F.lit(" "), F.lit(" \t ")), F.lit("\r x \r\n")))).alias("cleaned_md5"))


def extract_sentences(s, d):
    return _docs(s, d).select("doc_id", F.array_join(X.sentences(F.col("text")), "|").alias("first_sentences"))


def estimate_tokens(s, d):
    return _docs(s, d).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


def parse_date(s, d):
    o = load(s, d, "orders")
    spelled = F.lit("not a date")
    for i, f in enumerate(_DATES):
        spelled = F.when(F.col("o_orderkey") % 10 == i, F.date_format("o_orderdate", f)).otherwise(spelled)
    return o.select("o_orderkey", F.date_format(X.parse_date(spelled), "yyyy-MM-dd").alias("parsed"))


def int_to_roman(s, d):
    return load(s, d, "orders").select("o_orderkey", X.int_to_roman(F.col("o_orderkey") % 4200).alias("roman"))


def roman_to_int(s, d):
    return load(s, d, "orders").select("o_orderkey", roman_value(X.int_to_roman(F.col("o_orderkey") % 4000)).alias("n"))


def format_number(s, d):
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.format_number(F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") - 3)).alias("shown"))


def highlight_terms(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.highlight(F.col("text"), ["the", "de", "($1)"])).alias("shown_md5"))


def cache_keys(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", X.cache_key("index", F.col("doc_id").cast("string")).alias("index_key"), X.cache_key("llm", F.lit("m"), X.short_hash(t)).alias("llm_key"), X.cache_key("search", F.col("doc_id").cast("string"), X.short_hash(t)).alias("search_key"), X.short_hash(t, 32).alias("file_name"))


def best_match_jaccard(s, d):
    """For each turn of a conversation the benchmark text of most common words, above 0.02; the first of equals.
    Words meet by an equi-join: texts without a common word score 0 and are no match."""
    q = load(s, d, "conversations").select("conv_id", "turn", X.word_set(F.col("text")).alias("ws"))
    c = load(s, d, "benchmark").select("item_id", X.word_set(F.col("text")).alias("ws"))
    a = q.select("conv_id", "turn", F.size("ws").alias("na"), F.explode("ws").alias("w"))
    b = c.select("item_id", F.size("ws").alias("nb"), F.explode("ws").alias("w"))
    both = a.join(b, "w").groupBy("conv_id", "turn", "item_id", "na", "nb").agg(F.count(F.lit(1)).alias("n")).withColumn("score", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).filter("score > 0.02")
    return both.groupBy("conv_id", "turn").agg(F.max(F.struct("score", (-F.col("item_id")).alias("first"))).alias("m")).select("conv_id", "turn", (-F.col("m.first")).alias("item_id"), "m.score")


def chunk_simple(s, d):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: simple_pieces(t or "", 1000))

    return _docs(s, d).select("doc_id", F.posexplode(cut("text")).alias("k", "piece"))


def json_repair(s, d):
    p = F.col("props")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: ```json\n"), p, F.lit("\n``` done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), F.regexp_replace(p, r"\}$", ", }"), F.lit(" end"))).otherwise(p)
    return load(s, d, "events").select("event_id", X.repair_json(broken).alias("json"))


_PIECES = "regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')"
_SETS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
_ROMAN = "['','M','MM','MMM'][(n // 1000) % 4 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(n // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1]"
_SPELL = ["%Y-%m-%d", "%B %-d, %Y", "%B %-d %Y", "%b %-d, %Y", "%b %-d %Y", "%m/%d/%Y", "%m-%d-%Y", "%d-%b-%Y", "%-d %B %Y"]
_BREAKS = ("chr(10) || chr(10)", 2), ("chr(10)", 1), ("'. '", 2), ("' '", 1)
_SIMPLE_END = "CASE WHEN a + 1000 >= length(t) THEN a + 1000 ELSE a + coalesce(" + ", ".join(
    f"CASE WHEN instr(reverse(w), reverse({m})) > 0 AND 1001 - instr(reverse(w), reverse({m})) - {n} > 500 THEN 1001 - instr(reverse(w), reverse({m})) END" for m, n in _BREAKS) + ", 1000) END"
ORACLES = {
    "chunk_simple": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        r AS (SELECT doc_id, t, 0 AS k, 0 AS a, {_SIMPLE_END} AS z FROM (SELECT *, 0 AS a, substr(t, 1, 1000) AS w FROM d WHERE length(t) > 1000)
          UNION ALL SELECT doc_id, t, k + 1, a, {_SIMPLE_END} FROM (SELECT doc_id, t, k, z - 100 AS a, substr(t, z - 99, 1000) AS w FROM r WHERE z - 100 < length(t)))
        SELECT doc_id, k, substr(t, a + 1, z - a) AS piece FROM r UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) <= 1000""",
    "json_repair": "SELECT event_id, props AS json FROM events",
    "doc_hash_id": "SELECT doc_id, substr(sha256(text), 1, 12) AS hash_id, 'doc_' || substr(sha256(text), 1, 12) AS prefixed FROM documents",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS short FROM documents",
    "truncate_middle": "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 90) || chr(10) || '...[truncated]...' || chr(10) || right(text, 90) END AS short FROM documents",
    "clean_text": """WITH p AS (SELECT page_id, ' ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || chr(9) || replace(html, ' ', ' ' || chr(9) || ' ') || chr(13) || ' x ' || chr(13) || chr(10) AS t FROM pages),
        q AS (SELECT page_id, regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM p)
        SELECT page_id, md5(trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\x0B\\f]+', ' ', 'g'))), chr(10)), ' ' || chr(10))) AS cleaned_md5 FROM q""",
    "extract_sentences": f"SELECT doc_id, array_to_string(list_slice(string_split({_PIECES}, chr(1)), 1, 5), '|') AS first_sentences FROM documents",
    "estimate_tokens": "SELECT doc_id, length(text) // 4 AS tokens FROM documents",
    "parse_date": "SELECT o_orderkey, strftime(try_strptime(CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_SPELL)) + " ELSE 'not a date' END, [" + ", ".join(f"'{f}'" for f in _C_DATES) + "]), '%Y-%m-%d') AS parsed FROM orders",
    "int_to_roman": f"SELECT o_orderkey, CASE WHEN n < 1 OR n > 3999 THEN CAST(n AS VARCHAR) ELSE {_ROMAN} END AS roman FROM (SELECT o_orderkey, o_orderkey % 4200 AS n FROM orders)",
    "roman_to_int": "SELECT o_orderkey, CAST(o_orderkey % 4000 AS INTEGER) AS n FROM orders",
    "format_number": "SELECT l_orderkey, l_linenumber, CASE WHEN abs(v) >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN abs(v) >= 1e6 THEN printf('%.2fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.2fK', v / 1e3) ELSE printf('%.2f', v) END AS shown FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * pow(10.0::DOUBLE, l_linenumber - 3) AS v FROM lineitem)",
    "highlight_terms": "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the', '**the**', 'g'), '(?i)de', '**de**', 'g'), '(?i)\\(\\$1\\)', '**($1)**', 'g')) AS shown_md5 FROM documents",
    "cache_keys": "SELECT doc_id, 'index:' || doc_id AS index_key, 'llm:m:' || substr(sha256(text), 1, 16) AS llm_key, 'search:' || doc_id || ':' || substr(sha256(text), 1, 16) AS search_key, substr(sha256(text), 1, 32) AS file_name FROM documents",
    "best_match_jaccard": f"""WITH q AS (SELECT conv_id, turn, {_SETS.format('text')} AS a FROM conversations), c AS (SELECT item_id, {_SETS.format('text')} AS b FROM benchmark),
        s AS (SELECT conv_id, turn, item_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM q, c)
        SELECT conv_id, turn, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, item_id) AS r FROM s WHERE score > 0.02) WHERE r = 1""",
}
QUERIES = {k: globals()[k] for k in ORACLES}
