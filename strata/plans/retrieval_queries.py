"""Queries on search, evidence, answers, caches, sinks and streams. Topics are the texts of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import indexing as X
from ..operators import references as R
from ..operators import retrieval as T
from ..operators import structure as S
from ..sources import cache as C
from ..sources import sinks as K
from ..sources.stage import shared_dir, staged
from ..sources.tables import filings, load
from ..streaming import incremental as I
from . import reference_queries as RQ
from . import sql as Q
from . import structure_queries as SQ
from .text_queries import _SETS

#: Shares of common words are lower than a model's scores: these thresholds stand in the queries' place of 0.6 and 0.75.
SEARCH = T.SearchConfig(relevance_threshold=0.15, max_results=20)
EVIDENCE = T.EvidenceConfig(relevance_threshold=0.15, excerpt_threshold=0.2)


def _topics(s, d):
    return load(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _nodes(s, d):
    """Nodes with text and summary, made once for a query."""
    return staged(T.summaries(SQ.node_texts(s, d)), "node_texts")


def _slim(s, d):
    return staged(T.summaries(SQ.node_texts(s, d)).select("doc_no", "node_id", "ord", "title", "summary"), "summaries")


def _evidence(s, d):
    return T.evidence(_topics(s, d), _slim(s, d), EVIDENCE)


def _by_category(s, d):
    """(category, doc_no, node_id, score): topics in four categories, a node's best score in each."""
    return _evidence(s, d).groupBy((F.col("query_id") % 4).alias("category"), "doc_no", "node_id").agg(F.max("score").alias("score"))


def node_summaries(s, d):
    return _slim(s, d).select("doc_no", "node_id", F.md5(F.coalesce("summary", F.lit(""))).alias("summary_md5"))


def search_topk(s, d):
    return T.search(_topics(s, d), _slim(s, d), SEARCH)


def search_expand(s, d):
    f, n = SQ.documents_and_nodes(s, d)
    texts = SQ.with_text(n, f)
    slim = staged(T.summaries(texts).select("doc_no", "node_id", "ord", "title", "summary"), "summaries")
    refs = staged(R.detect(texts), "references")
    found = staged(T.search(_topics(s, d), slim, SEARCH), "found")
    return T.expand(found, _topics(s, d), slim, R.resolve(refs, n), SEARCH)


def provenance_all(s, d):
    """Each topic's evidence and the share of nodes that were looked at: all."""
    e = _evidence(s, d)
    return e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).withColumn("scan_coverage", F.lit(1.0))


def provenance_doc_order(s, d):
    return _evidence(s, d).select("query_id", "doc_no", "ord", "node_id", "score")


def provenance_by_category(s, d):
    return _by_category(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def category_overlap(s, d):
    g = _by_category(s, d).groupBy("doc_no", "node_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("category").cast("string"))), ",").alias("categories"), F.count(F.lit(1)).alias("n"))
    return g.filter("n > 1")


def overlap_matrix(s, d):
    c = _by_category(s, d).filter("score >= 0.2")
    o = c.select(F.col("category").alias("other"), "doc_no", "node_id")
    return c.join(o, ["doc_no", "node_id"]).filter("category < other").groupBy("category", "other").agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(s, d):
    grid = F.explode(F.array(*[F.lit(x) for x in (0.15, 0.2, 0.25, 0.3, 0.4)])).alias("threshold")
    return _evidence(s, d).select("score", grid).filter("score >= threshold").groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


def score_histogram(s, d):
    return _evidence(s, d).groupBy((F.floor(F.col("score") * 10) / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def topic_coverage(s, d):
    n = _slim(s, d)
    hit = T.evidence(_topics(s, d), n, EVIDENCE).filter("score >= 0.2").agg(F.count_distinct("doc_no", "node_id").alias("covered"))
    return hit.join(n.agg(F.count(F.lit(1)).alias("total")), F.lit(True)).select("covered", "total", (F.col("covered") / F.col("total")).alias("share"))  # a row each


def section_rollup(s, d):
    """Matches by the node below the root that they stand in."""
    n = S.depths(_nodes(s, d).drop("text"))
    top = n.select("doc_no", "node_id", F.when(F.col("depth") >= 1, F.element_at("path", 2)).otherwise(F.col("node_id")).alias("section"))
    titles = n.select("doc_no", F.col("node_id").alias("section"), "title")
    e = T.evidence(_topics(s, d), n.select("doc_no", "node_id", "ord", "title", "summary"), EVIDENCE)
    return e.join(top, ["doc_no", "node_id"]).join(titles, ["doc_no", "section"]).groupBy("doc_no", "section", "title").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def excerpts(s, d):
    n = _nodes(s, d)
    x = T.excerpts(T.evidence(_topics(s, d), n.select("doc_no", "node_id", "ord", "title", "summary"), EVIDENCE), _topics(s, d), n, EVIDENCE)
    return x.select("query_id", "doc_no", "node_id", F.size("excerpts").alias("n"), F.md5(F.array_join("excerpts", "|")).alias("excerpts_md5"))


def excerpt_batches(s, d):
    n = SQ.node_texts(s, d)
    return T.batches(n, ["doc_no"], "ord", F.length("text"), EVIDENCE.token_budget, EVIDENCE.batch_size)


def summary_batches(s, d):
    n = SQ.node_texts(s, d)
    return T.batches(n, ["doc_no"], "ord", F.length("text"), 2000, 10, cap=2000)


def qa_citations(s, d):
    n = _nodes(s, d)
    a = T.answers(_topics(s, d), n.select("doc_no", "node_id", "ord", "title", "summary"), n)
    return a.withColumn("excerpt", F.md5("excerpt"))


def structure_view(s, d):
    return T.structure_view(S.depths(_nodes(s, d).drop("text"))).withColumn("view", F.md5("view"))


def tree_json(s, d):
    return K.nested_json(S.depths(_nodes(s, d).drop("text")))


def evidence_csv(s, d):
    n = _nodes(s, d)
    x = T.excerpts(T.evidence(_topics(s, d), n.select("doc_no", "node_id", "ord", "title", "summary"), EVIDENCE), _topics(s, d), n, EVIDENCE)
    t = n.select("doc_no", "node_id", "title")
    return K.evidence_rows(x.join(t, ["doc_no", "node_id"]).withColumn("match_reason", F.lit("common words")))


def markdown_report(s, d):
    n = _slim(s, d)
    e = T.evidence(_topics(s, d), n, EVIDENCE)
    return K.markdown_report(e.join(n.select("doc_no", "node_id", "title"), ["doc_no", "node_id"]))


def _entries(s, d):
    """Events as cache entries: each user's last page of a type, with six hours to live and the number of events as hits."""
    e = load(s, d, "events")
    g = e.groupBy(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")).agg(F.max("ts").alias("created_at"), F.count(F.lit(1)).alias("hit_count"))
    return g.select("key", F.concat(F.lit("v"), "key").alias("value"), "created_at", (F.col("created_at") + F.expr("interval 6 hours")).alias("expires_at"), "hit_count")


def cache_hit_miss(s, d):
    """Every event asks for the entry that the event before it of the same key made."""
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    e = load(s, d, "events").select("event_type", "ts", key.alias("of"), F.row_number().over(W.partitionBy(key).orderBy("ts", "event_id")).alias("turn"))
    at = lambda n: F.concat_ws("#", "of", n.cast("string")).alias("key")
    made = e.select(at(F.col("turn")), F.concat(F.lit("v"), "of").alias("value"), (F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"))
    r = C.lookup(e.select(at(F.col("turn") - 1), "ts", "event_type"), made, F.col("ts"))
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


def cache_evict_lfu(s, d):
    return C.evicted(_entries(s, d), 100).select("key", "hit_count")


def stream_accumulate(s, d):
    c = I.accumulated(load(s, d, "conversations"), "conv_id", "turn", "text")
    return c.select("conv_id", "turn", "token_count", F.md5("accumulated_content").alias("content_md5"))


def incremental_index(s, d):
    """The nodes of the documents, delivered as a stream and drained."""
    folder = shared_dir(s)
    schema = load(s, d, "documents").schema
    return I.drain(s, f"{d}/document[s].parquet", schema, folder, SQ.SIZE).groupBy("title", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("end_char").alias("chars"))


def search_full(s, d):
    """Ranked nodes, then the relevant ones that they refer to, unranked."""
    f, n = SQ.documents_and_nodes(s, d)
    texts = SQ.with_text(n, f)
    slim = staged(T.summaries(texts).select("doc_no", "node_id", "ord", "title", "summary"), "summaries")
    refs = staged(R.detect(texts), "references")
    found = staged(T.search(_topics(s, d), slim, SEARCH), "found")
    more = T.expand(found, _topics(s, d), slim, R.resolve(refs, n), SEARCH)
    return found.unionByName(more.withColumn("rank", F.lit(None).cast("int"))).select("query_id", "doc_no", "node_id", "score", "rank")


def evidence_summary(s, d):
    n = _nodes(s, d)
    x = T.excerpts(T.evidence(_topics(s, d), n.select("doc_no", "node_id", "ord", "title", "summary"), EVIDENCE), _topics(s, d), n, EVIDENCE)
    return T.evidence_summary(x.join(n.select("doc_no", "node_id", "title"), ["doc_no", "node_id"])).withColumn("summary", F.md5("summary"))


def qa_answer(s, d):
    n = _nodes(s, d)
    return T.answer(_topics(s, d), n.select("doc_no", "node_id", "ord", "title", "summary"), n, threshold=0.3).withColumn("answer", F.md5("answer"))


def category_comparison(s, d):
    """Of each category the number of matches, their mean score and the share of nodes that they cover."""
    n = _slim(s, d)
    best = T.evidence(_topics(s, d), n, EVIDENCE).groupBy((F.col("query_id") % 4).alias("category"), "doc_no", "node_id").agg(F.max("score").alias("score"))
    total = n.agg(F.count(F.lit(1)).alias("total"))  # a row
    g = best.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).join(total, F.lit(True))
    return g.select("category", "n", F.round("mean", 6).alias("mean"), F.round(F.col("n") / F.col("total"), 6).alias("coverage"))


def sweep_means(s, d):
    grid = F.explode(F.array(*[F.lit(x) for x in (0.15, 0.2, 0.25, 0.3, 0.4)])).alias("threshold")
    return _evidence(s, d).select("score", grid).filter("score >= threshold").groupBy("threshold").agg(F.round(F.avg("score"), 6).alias("mean"))


def index_nodes(s, d):
    """Nodes of a whole index by route, with summaries from the leaves up: the filings, and each conversation as a document."""
    n = X.build_index(_mixed(s, d)).nodes
    return n.select("doc_no", "node_id", "parent_id", "title", "level", "start_char", "end_char", F.md5(F.coalesce("summary", F.lit(""))).alias("summary_md5"))


def index_stats(s, d):
    return X.stats(X.build_index(_mixed(s, d)))


def _mixed(s, d):
    """Filings beside conversations, numbered from a million on: these have no sections."""
    c = load(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    line = lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), F.coalesce(x["text"], F.lit("")))
    talk = c.select((F.col("conv_id") + 1_000_000).cast("bigint").alias("doc_no"), F.lit("talk.txt").alias("doc_name"), F.array_join(F.transform("l", line), "\n").alias("text"))
    return filings(s, d).select(F.col("doc_no").cast("bigint").alias("doc_no"), "doc_name", "text").unionByName(talk)


def find_node(s, d):
    return X.find_node(SQ.node_table(s, d), "0003").select("doc_no", "title", "start_char")


def text_range(s, d):
    return X.char_range(filings(s, d), 100, 400).select("doc_no", F.md5("text").alias("text_md5"))


def structure_summary(s, d):
    return X.structure_summary(SQ.nodes_staged(s, d)).withColumn("summary", F.md5("summary"))


# ---- SQL ------------------------------------------------------------------------------------------------------

_PARTS = "string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
TEXTS = Q.NODES + f""",
nodetexts AS (SELECT n.*, substr(t.text, n.start_char + 1, n.end_char - n.start_char) AS text FROM nodes n JOIN typed t USING (doc_no)),
summed AS (SELECT *, CASE WHEN length(text) > 100 THEN substr(array_to_string(list_slice({_PARTS.format('text')}, 1, 2), ' '), 1, 500) END AS summary FROM nodetexts)"""
SCORES = TEXTS + f""",
qs AS (SELECT item_id AS query_id, text AS query, {_SETS.format('text')} AS a FROM benchmark),
ns AS (SELECT doc_no, node_id, ord, title, {_SETS.format("(title || ' - ' || substr(coalesce(summary, ''), 1, 150))")} AS b FROM summed),
qw AS (SELECT query_id, len(a) AS nq, unnest(a) AS w FROM qs), nw AS (SELECT doc_no, node_id, ord, len(b) AS nn, unnest(b) AS w FROM ns),
scored AS (SELECT query_id, doc_no, node_id, ord, count(*) / least(nq, nn) AS score FROM qw JOIN nw USING (w) GROUP BY query_id, doc_no, node_id, ord, nq, nn),
evidence AS (SELECT * FROM scored WHERE score >= 0.15),
cats AS (SELECT query_id % 4 AS category, doc_no, node_id, max(score) AS score FROM evidence GROUP BY ALL)"""
_TOPK = "SELECT *, row_number() OVER (PARTITION BY query_id, doc_no ORDER BY score DESC, ord) AS rank FROM evidence"
_TERMS = "list_filter(a, lambda w: length(w) >= 5)"
_EXC = SCORES + f""",
exc AS (SELECT e.query_id, e.doc_no, e.node_id, e.score, t.title, list_slice(list_filter({_PARTS.format('t.text')}, lambda p: len(list_intersect({_SETS.format('p')}, {_TERMS})) > 0), 1, 5) AS x
  FROM evidence e JOIN qs q ON q.query_id = e.query_id JOIN summed t ON t.doc_no = e.doc_no AND t.node_id = e.node_id WHERE e.score >= 0.2)"""


def _batch_sql(budget: int, cap: str) -> str:
    return TEXTS + f""",
sizes AS (SELECT doc_no, ord, CAST(floor({cap} / 3.5) AS BIGINT) AS t FROM nodetexts),
fold AS (WITH RECURSIVE r AS (SELECT doc_no, ord, 0 AS batch, 1 AS n, t FROM sizes WHERE ord = 0
  UNION ALL SELECT z.doc_no, z.ord, r.batch + CASE WHEN r.t + z.t > {budget} OR r.n >= 10 THEN 1 ELSE 0 END, CASE WHEN r.t + z.t > {budget} OR r.n >= 10 THEN 1 ELSE r.n + 1 END, CASE WHEN r.t + z.t > {budget} OR r.n >= 10 THEN z.t ELSE r.t + z.t END
  FROM r JOIN sizes z ON z.doc_no = r.doc_no AND z.ord = r.ord + 1) SELECT * FROM r)"""


_ENTRIES = "entries AS (SELECT event_type || ':' || user_id AS key, max(ts) AS created_at, max(ts) + INTERVAL 6 HOUR AS expires_at, count(*) AS hit_count FROM events GROUP BY 1)"
_STREAM = Q.NODES.replace(Q.filings_sql(), "filings AS (SELECT doc_id AS doc_no, '' AS doc_name, coalesce(text, '') AS text FROM documents)")
ORACLES = {
    "node_summaries": Q.with_(TEXTS, "SELECT doc_no, node_id, md5(coalesce(summary, '')) AS summary_md5 FROM summed"),
    "search_topk": Q.with_(SCORES, f"SELECT query_id, doc_no, node_id, ord, score, rank FROM ({_TOPK}) WHERE rank <= 20"),
    "search_expand": Q.with_(RQ.REFS.removeprefix("") + ", " + SCORES.removeprefix(Q.NODES).lstrip(",\n").replace("nodetexts AS (SELECT n.*", "nodetexts2 AS (SELECT n.*").replace("FROM nodetexts)", "FROM nodetexts2)", 1),
        f"""SELECT s.query_id, s.doc_no, s.node_id, s.ord, s.score FROM evidence s JOIN (SELECT DISTINCT f.query_id, f.doc_no, r.target_node_id AS node_id FROM (SELECT * FROM ({_TOPK}) WHERE rank <= 20) f
        JOIN resolved r ON r.doc_no = f.doc_no AND r.source_node_id = f.node_id AND r.resolved) m USING (query_id, doc_no, node_id)
        WHERE NOT EXISTS (SELECT 1 FROM ({_TOPK}) k WHERE k.rank <= 20 AND k.query_id = s.query_id AND k.doc_no = s.doc_no AND k.node_id = s.node_id)"""),
    "provenance_all": Q.with_(SCORES, "SELECT query_id, count(*) AS n, max(score) AS best, 1.0::DOUBLE AS scan_coverage FROM evidence GROUP BY query_id"),
    "provenance_doc_order": Q.with_(SCORES, "SELECT query_id, doc_no, ord, node_id, score FROM evidence"),
    "provenance_by_category": Q.with_(SCORES, "SELECT category, count(*) AS n, max(score) AS best FROM cats GROUP BY category"),
    "category_overlap": Q.with_(SCORES, "SELECT doc_no, node_id, string_agg(CAST(category AS VARCHAR), ',' ORDER BY category) AS categories, count(*) AS n FROM cats GROUP BY ALL HAVING count(*) > 1"),
    "overlap_matrix": Q.with_(SCORES, "SELECT a.category, b.category AS other, count(*) AS n FROM cats a JOIN cats b USING (doc_no, node_id) WHERE a.category < b.category AND a.score >= 0.2 AND b.score >= 0.2 GROUP BY ALL"),
    "threshold_sweep": Q.with_(SCORES, "SELECT threshold, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM evidence, (SELECT unnest([0.15, 0.2, 0.25, 0.3, 0.4]::DOUBLE[]) AS threshold) WHERE score >= threshold GROUP BY threshold"),
    "score_histogram": Q.with_(SCORES, "SELECT floor(score * 10) / 10 AS bucket, count(*) AS n FROM evidence GROUP BY 1"),
    "topic_coverage": Q.with_(SCORES, "SELECT covered, total, covered / total AS share FROM (SELECT count(DISTINCT (doc_no, node_id)) AS covered FROM evidence WHERE score >= 0.2), (SELECT count(*) AS total FROM nodes)"),
    "section_rollup": Q.with_(Q.DEPTHS + SCORES.removeprefix(Q.NODES), "SELECT e.doc_no, CASE WHEN w.depth >= 1 THEN w.path[2] ELSE w.node_id END AS section, any_value(n.title) AS title, count(*) AS n, max(score) AS best FROM evidence e JOIN walk w USING (doc_no, node_id) JOIN nodes n ON n.doc_no = e.doc_no AND n.node_id = CASE WHEN w.depth >= 1 THEN w.path[2] ELSE w.node_id END GROUP BY 1, 2"),
    "excerpts": Q.with_(_EXC, "SELECT query_id, doc_no, node_id, len(x) AS n, md5(array_to_string(list_transform(x, lambda s: substr(s, 1, 1000)), '|')) AS excerpts_md5 FROM exc"),
    "excerpt_batches": Q.with_(_batch_sql(30_000, "length(text)"), "SELECT doc_no, ord, batch FROM fold"),
    "summary_batches": Q.with_(_batch_sql(2000, "least(length(text), 2000)"), "SELECT doc_no, ord, batch FROM fold"),
    "qa_citations": Q.with_(SCORES, """SELECT s.query_id, s.doc_no, step, s.node_id, t.title AS node_title, md5(substr(t.text, 1, 500)) AS excerpt, t.start_char, t.end_char FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id, doc_no ORDER BY score DESC, ord) AS step FROM scored) s JOIN summed t USING (doc_no, node_id) WHERE step <= 5"""),
    "structure_view": Q.with_(Q.DEPTHS + TEXTS.removeprefix(Q.NODES), """SELECT doc_no, md5(string_agg(repeat('  ', depth) || '[' || node_id || '] ' || title || CASE WHEN length(coalesce(summary, '')) > 0 THEN ' - ' || substr(summary, 1, 60) || '...' ELSE '' END, chr(10) ORDER BY ord)) AS view
        FROM summed JOIN walk USING (doc_no, node_id) GROUP BY doc_no"""),
    "evidence_csv": Q.with_(_EXC, "SELECT node_id, title, printf('%.2f', score) AS relevance_score, 'common words' AS match_reason, len(x) AS excerpt_count, substr(coalesce(x[1], ''), 1, 200) AS first_excerpt FROM exc"),
    "cache_hit_miss": """SELECT event_type, count(*) AS n, count_if(before IS NOT NULL AND before + INTERVAL 6 HOUR >= ts) AS hits FROM
        (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY event_type""",
    "cache_evict_lfu": f"WITH {_ENTRIES} SELECT key, hit_count FROM entries ORDER BY hit_count DESC, created_at DESC, key DESC LIMIT 100",
    "stream_accumulate": "SELECT conv_id, turn, count(*) OVER w AS token_count, md5(string_agg(text, '') OVER w) AS content_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    "incremental_index": Q.with_(_STREAM, "SELECT title, level, count(*) AS n, CAST(sum(end_char) AS BIGINT) AS chars FROM nodes GROUP BY title, level"),
}
_EXPANDED = ORACLES["search_expand"]
_MIXED = "filings AS (SELECT * FROM filings0 UNION ALL SELECT conv_id + 1000000, 'talk.txt', string_agg(upper(role[1]) || lower(role[2:]) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id)"
_INDEX = Q.DEPTHS.replace(", typed AS (", ", " + _MIXED + ", typed AS (", 1).replace("filings AS (SELECT doc_no, CASE", "filings0 AS (SELECT doc_no, CASE", 1).replace("nodes AS (SELECT p.doc_no", "nodes0 AS (SELECT p.doc_no", 1)
_ROUTED = """,
way AS (SELECT doc_no, count(DISTINCT section_title) >= 3 AND avg(CASE WHEN section_title IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) > 0.2 AS tree FROM chunks GROUP BY doc_no),
fb0 AS (SELECT c.*, last_value(section_title IGNORE NULLS) OVER (PARTITION BY doc_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS seen, count(section_title) OVER (PARTITION BY doc_no) AS titles FROM chunks c JOIN way USING (doc_no) WHERE NOT tree),
fb1 AS (SELECT *, CASE WHEN titles = 0 THEN 'Document' ELSE seen END AS t FROM fb0 WHERE titles = 0 OR seen IS NOT NULL),
fb2 AS (SELECT *, CASE WHEN t IS DISTINCT FROM lag(t) OVER (PARTITION BY doc_no ORDER BY chunk_index) THEN 1 ELSE 0 END AS new FROM fb1),
fb3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS island FROM fb2),
nodes AS MATERIALIZED (SELECT n.* FROM nodes0 n JOIN way USING (doc_no) WHERE tree UNION ALL BY NAME
  SELECT doc_no, printf('%04d', CAST(island - 1 AS INTEGER)) AS node_id, CAST(island - 1 AS INTEGER) AS ord, NULL AS parent_id, any_value(t) AS title, 0 AS level, arg_min(start_char, chunk_index) AS start_char, arg_max(end_char, chunk_index) AS end_char, min(chunk_index) AS start_chunk, max(chunk_index) + 1 AS end_chunk FROM fb3 GROUP BY doc_no, island)"""
_INDEX = _INDEX.replace(",\nwalk AS", _ROUTED + ",\nwalk AS", 1) + f""",
owned AS (SELECT n.*, w.depth, c.doc_no IS NOT NULL AS inner_, CASE WHEN length(x) > 100 THEN substr(array_to_string(list_slice({_PARTS.format('x')}, 1, 2), ' '), 1, 500) END AS own
  FROM (SELECT n.*, substr(t.text, n.start_char + 1, n.end_char - n.start_char) AS x FROM nodes n JOIN typed t USING (doc_no)) n JOIN walk w USING (doc_no, node_id) LEFT JOIN (SELECT DISTINCT doc_no, parent_id FROM nodes) c ON c.doc_no = n.doc_no AND c.parent_id = n.node_id),
up4 AS (SELECT * REPLACE (CASE WHEN inner_ THEN NULL ELSE own END AS own) FROM owned)""" + "".join(f""",
up{k} AS (SELECT u.* REPLACE (CASE WHEN u.inner_ AND u.depth = {k} THEN s.t ELSE u.own END AS own) FROM up{k + 1} u LEFT JOIN
  (SELECT doc_no, parent_id, substr(string_agg('- ' || title || ': ' || own, chr(10) ORDER BY ord), 1, 500) AS t FROM up{k + 1} WHERE depth = {k + 1} AND own <> '' GROUP BY ALL) s ON s.doc_no = u.doc_no AND s.parent_id = u.node_id)""" for k in (3, 2, 1, 0))
ORACLES |= {
    "search_full": _EXPANDED.replace("SELECT s.query_id, s.doc_no, s.node_id, s.ord, s.score FROM evidence s", f"SELECT query_id, doc_no, node_id, score, rank FROM ({_TOPK}) WHERE rank <= 20 UNION ALL SELECT s.query_id, s.doc_no, s.node_id, s.score, NULL FROM evidence s"),
    "evidence_summary": Q.with_(_EXC, """SELECT query_id, max(n) AS n, md5('Found ' || max(n) || ' relevant sections' || chr(10) || string_agg('- ' || title || ': ' || array_to_string(list_transform(x[1:2], lambda s: substr(s, 1, 300)), ' | '), chr(10) ORDER BY r)) AS summary
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_no, node_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM exc) WHERE r <= 15 GROUP BY query_id"""),
    "qa_answer": Q.with_(SCORES, f"""SELECT q.query_id, md5(coalesce(answer, '{T.NOT_FOUND}')) AS answer, coalesce(best, 0.0::DOUBLE) AS confidence, coalesce(visited, '') AS visited, coalesce(trace, 'no relevant section') AS trace FROM qs q LEFT JOIN
        (SELECT query_id, max(score) AS best, string_agg('[' || t.title || '] ' || substr(t.text, 1, 500), chr(10) || chr(10) ORDER BY step) AS answer, string_agg(s.doc_no || ':' || s.node_id, ',' ORDER BY step) AS visited, string_agg('step ' || step || ': read ' || t.title, '; ' ORDER BY step) AS trace
         FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_no, ord) AS step FROM scored WHERE score >= 0.3) s JOIN summed t USING (doc_no, node_id) WHERE step <= 5 GROUP BY query_id) a USING (query_id)"""),
    "category_comparison": Q.with_(SCORES, "SELECT category, count(*) AS n, round(avg(score), 6) AS mean, round(count(*) / any_value(total), 6) AS coverage FROM cats, (SELECT count(*) AS total FROM nodes) GROUP BY category"),
    "sweep_means": Q.with_(SCORES, "SELECT threshold, round(avg(score), 6) AS mean FROM evidence, (SELECT unnest([0.15, 0.2, 0.25, 0.3, 0.4]::DOUBLE[]) AS threshold) WHERE score >= threshold GROUP BY threshold"),
    "index_nodes": Q.with_(_INDEX, "SELECT doc_no, node_id, parent_id, title, level, start_char, end_char, md5(coalesce(own, '')) AS summary_md5 FROM up0"),
    "markdown_report": Q.with_(SCORES, """SELECT query_id, '# Evidence' || chr(10) || chr(10) || 'Total: ' || max(n) || chr(10) || 'Average: ' || printf('%.2f', round(max(mean), 9)) || chr(10) || chr(10) || string_agg('- ' || title || ' (' || printf('%.2f', score) || ')', chr(10) ORDER BY r) || chr(10) AS report
        FROM (SELECT e.*, t.title, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_no, e.ord) AS r, count(*) OVER (PARTITION BY query_id) AS n, avg(score) OVER (PARTITION BY query_id) AS mean FROM evidence e JOIN summed t USING (doc_no, node_id)) WHERE r <= 5 GROUP BY query_id"""),
    "tree_json": Q.with_(Q.DEPTHS + TEXTS.removeprefix(Q.NODES), """SELECT doc_no, '[' || string_agg(json || CASE WHEN after > depth THEN ',"nodes":[' WHEN after IS NULL THEN '}' || repeat(']}', depth) ELSE '}' || repeat(']}', depth - after) || ',' END, '' ORDER BY ord) || ']' AS structure FROM
        (SELECT doc_no, ord, depth, lead(depth) OVER (PARTITION BY doc_no ORDER BY ord) AS after, '{"node_id":' || to_json(node_id) || ',"title":' || to_json(title) || ',"level":' || level || ',"start_char":' || start_char || ',"end_char":' || end_char
          || ',"start_index":' || start_chunk || ',"end_index":' || end_chunk || CASE WHEN summary IS NULL THEN '' ELSE ',"summary":' || to_json(summary) END AS json FROM summed JOIN walk USING (doc_no, node_id)) GROUP BY doc_no"""),
    "find_node": Q.with_(Q.NODES, "SELECT doc_no, title, start_char FROM nodes WHERE node_id = '0003'"),
    "text_range": Q.with_(Q.filings_sql(), "SELECT doc_no, md5(substr(text, 101, 300)) AS text_md5 FROM filings"),
    "structure_summary": Q.with_(Q.DEPTHS, """SELECT doc_no, md5(string_agg(repeat('  ', depth) || CASE WHEN r <= 5 THEN '- ' || title ELSE '... and ' || (n - 5) || ' more' END, chr(10) ORDER BY ord)) AS summary FROM
        (SELECT *, list_filter(path[1:depth], lambda x: list_contains(gone, x)) AS above FROM (SELECT z.*, list(node_id) FILTER (r > 5) OVER (PARTITION BY doc_no) AS gone FROM
          (SELECT n.*, w.depth, w.path, CASE WHEN n.parent_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY n.doc_no, n.parent_id ORDER BY n.ord) END AS r, count(*) OVER (PARTITION BY n.doc_no, n.parent_id) AS n FROM nodes n JOIN walk w USING (doc_no, node_id) WHERE w.depth <= 2) z))
        WHERE r <= 6 AND (gone IS NULL OR len(above) = 0) GROUP BY doc_no"""),
}
QUERIES = {k: globals()[k] for k in [*ORACLES, "index_stats"]}
