"""Queries on calls of a model, their cache, samples of texts, spans and results as JSON. A function that repeats the begin
of its prompt stands in the model's place, so that SQL can state the responses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import calls as M
from ..sources import cache as C
from ..sources.stage import shared_dir
from ..sources.tables import filings, filings_sql, load
from . import sql as Q


def echo(prompts: list[str]) -> list[str]:
    return [f"re: {p[:40]}" for p in prompts]


def sample_text(s, d):
    return load(s, d, "documents").select("doc_id", F.md5(X.sample(F.col("text"))).alias("sample_md5"), F.md5(X.sample(F.col("text"), 600)).alias("short_md5"))


def reading_text(s, d):
    return load(s, d, "documents").select("doc_id", F.md5(X.truncate_reading(F.col("text"))).alias("read_md5"))


def filing_tokens(s, d):
    return filings(s, d).select("doc_no", X.count_tokens(F.col("text")).alias("tokens"), X.count_tokens(F.col("text"), lambda t: t.count(" ") + 1).alias("parts"))


def memo_calls(s, d):
    """The users' turns are asked first, then all turns: what a user said is in the cache by then."""
    cache = C.ParquetCache(s, f"{shared_dir(s)}/strata/memo-{uuid.uuid4().hex}")
    turns = load(s, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))
    M.memoised(turns.filter("role = 'user'"), echo, cache)
    return M.memoised(turns, echo, cache).select("conv_id", "turn", "response", "cached")


def _combined(s, d, strategy):
    return M.combined(load(s, d, "conversations"), "conv_id", "turn", "text", echo, strategy)


def combine_concat(s, d):
    return _combined(s, d, "concat")


def combine_last(s, d):
    return _combined(s, d, "last")


def combine_summarize(s, d):
    return _combined(s, d, "summarize")


def cache_families(s, d):
    """Every event as an entry of each family: whether it still lives when its user's next event comes."""
    after = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    family = F.explode(F.array(*[F.lit(x) for x in (*C.TTL, "other")])).alias("family")
    e = load(s, d, "events").withColumn("next", after).filter("next is not null").select("ts", "next", family)
    ends = C.expiry(F.concat("family", F.lit(":x")), F.col("ts"))
    return e.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(ends >= F.col("next"), F.lit(True))).alias("live"))


def span_check(s, d):
    spans = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("start_char"), (F.col("l_suppkey") * 20).alias("end_char"), F.lit(2).alias("start_chunk"), F.col("l_linenumber").alias("end_chunk"))
    return spans.select("l_orderkey", "l_linenumber", M.span_ok().alias("valid"))


_ENDS = "greatest(" + ", ".join(f"CASE WHEN instr(reverse(wide), ' {m}') > 0 THEN length(wide) - instr(reverse(wide), ' {m}') ELSE 0 END" for m in ".?!") + ")"


def _sample_sql(most: int) -> str:
    half, strip = (most - 30) // 2, lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    head = f"CASE WHEN {_ENDS} - 1 > {half // 2} THEN substr(wide, 1, {_ENDS}) ELSE substr(text, 1, {half}) END"
    tail = f"CASE WHEN instr(late, '. ') - 1 BETWEEN 1 AND 399 THEN substr(late, instr(late, '. ') + 2) ELSE right(text, {half}) END"
    mark = "chr(10) || chr(10) || '...[content truncated]...' || chr(10) || chr(10)"
    return f"""SELECT doc_id, CASE WHEN length(text) <= {most} THEN text ELSE {strip(head)} || {mark} || {strip(tail)} END AS t
        FROM (SELECT doc_id, text, substr(text, 1, {half + 200}) AS wide, substr(text, greatest(length(text) - {half + 200}, 0) + 1) AS late FROM documents)"""


_EACH = "WITH e AS (SELECT conv_id, turn, 're: ' || substr(coalesce(text, ''), 1, 40) AS r FROM conversations)"
ORACLES = {
    "filing_tokens": Q.with_(filings_sql(), "SELECT doc_no, length(text) // 4 AS tokens, length(text) - length(replace(text, ' ', '')) + 1 AS parts FROM filings"),
    "sample_text": f"SELECT doc_id, md5(a.t) AS sample_md5, md5(b.t) AS short_md5 FROM ({_sample_sql(6000)}) a JOIN ({_sample_sql(600)}) b USING (doc_id)",
    "reading_text": "SELECT doc_id, md5(CASE WHEN length(text) <= 10000 THEN text ELSE substr(text, 1, 5000) || chr(10) || '...[truncated]...' || chr(10) || right(text, 5000) END) AS read_md5 FROM documents",
    "memo_calls": """SELECT conv_id, turn, 're: ' || substr(text, 1, 40) AS response, CASE WHEN text IS NOT NULL THEN text IN (SELECT text FROM conversations WHERE role = 'user' AND text IS NOT NULL) END AS cached FROM conversations""",
    "combine_concat": f"{_EACH} SELECT conv_id, string_agg(r, chr(10) || chr(10) ORDER BY turn) AS response FROM e GROUP BY conv_id",
    "combine_last": f"{_EACH} SELECT conv_id, arg_max(r, turn) AS response FROM e GROUP BY conv_id",
    "combine_summarize": f"{_EACH} SELECT conv_id, 're: ' || substr('Summarize and consolidate these results:' || chr(10) || chr(10) || string_agg(r, chr(10) || chr(10) ORDER BY turn), 1, 40) AS response FROM e GROUP BY conv_id",
    "cache_families": """SELECT family, count(*) AS n, count_if(ttl IS NULL OR ts + to_seconds(ttl) >= next) AS live FROM (SELECT ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
        (VALUES ('index', 604800), ('llm', 3600), ('search', 1800), ('other', NULL)) f(family, ttl) WHERE next IS NOT NULL GROUP BY family""",
    "span_check": "SELECT l_orderkey, l_linenumber, l_suppkey * 20 >= l_partkey AND l_linenumber >= 2 AS valid FROM lineitem",
}
QUERIES = {k: globals()[k] for k in ORACLES}
