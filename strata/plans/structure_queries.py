"""Queries on types, sections, chunks and trees of the filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import structure as S
from ..sources.stage import staged
from ..sources.tables import filings
from . import sql as Q

#: The default size; SQL states the split of sections of one paragraph, as those of the filings are.
SIZE = S.ChunkConfig()


def typed(spark: SparkSession, d: str) -> DataFrame:
    """The filings with their types, made once for a query."""
    return staged(S.typed(filings(spark, d)), "typed")


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """Chunks for one reading: from the filings without a stage between."""
    return S.chunks(S.typed(filings(spark, d)), SIZE)


def chunks_staged(spark: SparkSession, d: str) -> DataFrame:
    return staged(chunk_table(spark, d), "chunks")


def node_table(spark: SparkSession, d: str) -> DataFrame:
    """Nodes; the chunks' places are staged, as a tree reads them twice."""
    return S.tree_from_chunks(staged(chunk_table(spark, d).drop("text"), "chunks"))


def nodes_staged(spark: SparkSession, d: str) -> DataFrame:
    return staged(node_table(spark, d), "nodes")


def documents_and_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The typed filings and their nodes, both staged."""
    f = typed(spark, d)
    return f, staged(S.tree_from_chunks(staged(S.chunks(f, SIZE).drop("text"), "chunks")), "nodes")


def detect_type(spark, d):
    return S.typed(filings(spark, d)).select("doc_no", "doc_type")


def detect_filename(spark, d):
    f = filings(spark, d)
    return f.select("doc_no", S.doc_type(F.col("text"), F.col("doc_name")).alias("doc_type"))


def detect_confidence(spark, d):
    return S.scored_type(filings(spark, d))


def section_headers(spark, d):
    return S.headers(S.typed(filings(spark, d)))


def sections(spark, d):
    return S.sections(S.typed(filings(spark, d)))


def chunks_fast(spark, d):
    """All chunks of the default size: sections up to it as they are, longer ones split."""
    return chunk_table(spark, d).select("doc_no", F.col("start_char").alias("start"), F.col("end_char").alias("stop"), F.col("section_title").alias("title"), F.md5("text").alias("text_md5"))


def chunks_full(spark, d):
    return chunk_table(spark, d).withColumn("text_md5", F.md5("text")).drop("text")


def chunk_offsets(spark, d):
    return chunk_table(spark, d).select("doc_no", "chunk_index", "start_char", "end_char")


def tree_nodes(spark, d):
    return node_table(spark, d)


def tree_stats(spark, d):
    """Nodes by depth and chunks of each filing; the chunks are made once."""
    c = staged(chunk_table(spark, d).drop("text"), "chunks")
    n = S.depths(staged(S.tree_from_chunks(c), "nodes"))
    inner = n.filter("parent_id is not null").select("doc_no", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(1))
    j = n.join(inner, ["doc_no", "node_id"], "left")
    per = j.groupBy("doc_no").agg(F.count(F.lit(1)).alias("total_nodes"), F.max("depth").alias("max_depth"), F.count_if(F.col("inner").isNull()).alias("leaf_nodes"), *[F.count_if(F.col("depth") == k).alias(f"depth_{k}") for k in range(4)])
    return per.join(c.groupBy("doc_no").agg(F.count(F.lit(1)).alias("total_chunks")), "doc_no")


def leaf_nodes(spark, d):
    n = nodes_staged(spark, d)
    return n.join(n.select("doc_no", F.col("parent_id").alias("node_id")), ["doc_no", "node_id"], "left_anti").select("doc_no", "node_id", "title")


def node_paths(spark, d):
    return S.depths(nodes_staged(spark, d)).select("doc_no", "node_id", "depth", F.array_join("path", "/").alias("path"))


def with_text(n: DataFrame, f: DataFrame) -> DataFrame:
    """Nodes with their documents' text between their bounds."""
    return n.join(f.select("doc_no", "text"), "doc_no").withColumn("text", F.expr("substring(text, cast(start_char + 1 as int), cast(end_char - start_char as int))"))


def node_texts(spark, d):
    """(doc_no, node_id, ord, title, level, parent_id, text)."""
    f, n = documents_and_nodes(spark, d)
    return with_text(n, f)


def node_text(spark, d):
    return node_texts(spark, d).select("doc_no", "node_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _joined(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The chunks of each group in order, with line feeds between."""
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c")).select(*by, F.size("c").alias("n_chunks"), F.md5(F.array_join(F.transform("c", lambda x: x["text"]), "\n")).alias("text_md5"))


def node_context(spark, d):
    """Each node's chunks and one more on both sides."""
    c = chunks_staged(spark, d)
    n = S.tree_from_chunks(c).select("doc_no", "node_id", "start_chunk", "end_chunk")
    near = c.join(n, "doc_no").filter("chunk_index >= start_chunk - 1 and chunk_index < end_chunk + 1")
    return _joined(near, ["doc_no", "node_id"])


def chunk_text_range(spark, d):
    """The chunks 2 to 5 of each document."""
    return _joined(chunk_table(spark, d).filter("chunk_index >= 2 and chunk_index < 6"), ["doc_no"])


def fallback_tree(spark, d):
    return S.tree_fallback(chunk_table(spark, d))


def tree_route(spark, d):
    return S.routes(chunk_table(spark, d)).withColumn("titled_share", F.round("titled_share", 9))


def chunk_summary(spark, d):
    """Titled chunks with the begin of their text, runs of untitled ones as counts, and the total."""
    c = staged(chunk_table(spark, d).withColumn("text", F.substring("text", 1, 200)), "chunks")
    w = W.partitionBy("doc_no").orderBy("chunk_index")
    flag = c.withColumn("run", F.sum(F.col("section_title").isNotNull().cast("int")).over(w))
    shown = F.concat(F.lit("<chunk_"), F.col("chunk_index"), F.lit("> ["), F.col("section_title"), F.lit("]: "), S.strip(F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" "))), F.lit("..."))
    titled = flag.filter("section_title is not null").select("doc_no", "chunk_index", shown.alias("line"))
    runs = flag.filter("section_title is null").groupBy("doc_no", "run").agg(F.min("chunk_index").alias("chunk_index"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("doc_no", "chunk_index", F.format_string("  ... %d content chunk(s) ...", "n").alias("line"))
    lines = titled.unionByName(runs).groupBy("doc_no").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "line"))).alias("l"))
    total = c.groupBy("doc_no").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(total, "doc_no").select("doc_no", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.format_string("\n\nTotal: %d chunks", "n")).alias("summary"))


def _flat(spark, d):
    """Numbered rows as a model would give them: roman parts, their items, one without its parent."""
    c = staged(chunk_table(spark, d).drop("text"), "chunks")
    k = F.col("chunk_index")
    number = F.when(k % 6 == 0, F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")]), (k / 6).cast("int") % 12 + 1)).otherwise(F.concat((k / 6).cast("int") + 1, F.lit("."), k % 6))
    return c.select("doc_no", number.alias("structure"), F.concat(F.lit("Section "), k).alias("title"), (k + F.when(k % 5 == 4, 1000).otherwise(0)).alias("chunk_index"), (k + k % 3).alias("end_chunk_index")), c


def tree_from_flat(spark, d):
    return S.tree_from_flat(*_flat(spark, d))


_ROMAN = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII']"
_FLAT = Q.CHUNKS + f""",
flat AS (SELECT doc_no, CASE WHEN chunk_index % 6 = 0 THEN {_ROMAN}[(chunk_index // 6) % 12 + 1] ELSE (chunk_index // 6 + 1) || '.' || (chunk_index % 6) END AS structure,
  'Section ' || chunk_index AS title, chunk_index + CASE WHEN chunk_index % 5 = 4 THEN 1000 ELSE 0 END AS ci, chunk_index + chunk_index % 3 AS ce FROM chunks),
sized AS (SELECT f.*, n.n, greatest(0, least(ci, n.n - 1)) AS a FROM flat f JOIN (SELECT doc_no, count(*) AS n FROM chunks GROUP BY doc_no) n USING (doc_no)),
keyed AS (SELECT *, greatest(a + 1, least(ce, n)) AS b, CASE WHEN structure NOT LIKE '%.%' THEN [CAST(list_position({_ROMAN}, structure) AS INTEGER)]
  ELSE list_transform(string_split(structure, '.'), lambda x: CAST(x AS INTEGER)) END AS key FROM sized),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY key, structure) - 1 AS ord FROM keyed)"""

ORACLES = {
    "detect_type": Q.with_(Q.TYPED, "SELECT doc_no, doc_type FROM typed"),
    "detect_filename": Q.with_(Q.filings_sql(), f"SELECT doc_no, {Q.type_sql('text', 'doc_name')} AS doc_type FROM filings"),
    "detect_confidence": Q.with_(
        Q.filings_sql() + ", scored AS (SELECT doc_no, " + ", ".join(f"least(1.0::DOUBLE, {Q.hits('lower(substr(text, 1, 20000))', ps)} / {Q.P.FULL_AT[k]}.0::DOUBLE) AS s{i}" for i, (k, ps) in enumerate({**Q.P.SEC_TYPES, **Q.P.OTHER_TYPES}.items())) + " FROM filings), "
        + "best AS (SELECT *, greatest(" + ", ".join(f"s{i}" for i in range(11)) + ") AS best FROM scored)",
        "SELECT doc_no, CASE WHEN best = 0 THEN 'generic' " + " ".join(f"WHEN s{i} = best THEN '{k}'" for i, k in enumerate({**Q.P.SEC_TYPES, **Q.P.OTHER_TYPES})) + " END AS doc_type, CASE WHEN best = 0 THEN 0.5::DOUBLE ELSE best END AS confidence FROM best"),
    "section_headers": Q.with_(Q.HEADERS, "SELECT doc_no, start, title, level FROM headers"),
    "sections": Q.with_(Q.SECTIONS, "SELECT doc_no, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, title, level FROM sections"),
    "chunks_fast": Q.with_(Q.CHUNKS, "SELECT doc_no, start_char AS start, end_char AS stop, section_title AS title, md5(text) AS text_md5 FROM chunks"),
    "chunks_full": Q.with_(Q.CHUNKS, "SELECT doc_no, chunk_index, start_char, end_char, section_title, section_level, md5(text) AS text_md5 FROM chunks"),
    "chunk_offsets": Q.with_(Q.CHUNKS, "SELECT doc_no, chunk_index, start_char, end_char FROM chunks"),
    "tree_nodes": Q.with_(Q.NODES, "SELECT * FROM nodes"),
    "tree_stats": Q.with_(Q.DEPTHS, """SELECT w.doc_no, count(*) AS total_nodes, max(depth) AS max_depth, count_if(i.node_id IS NULL) AS leaf_nodes, count_if(depth = 0) AS depth_0, count_if(depth = 1) AS depth_1, count_if(depth = 2) AS depth_2,
        count_if(depth = 3) AS depth_3, any_value(c.n) AS total_chunks FROM walk w LEFT JOIN (SELECT DISTINCT doc_no, parent_id AS node_id FROM nodes) i ON w.doc_no = i.doc_no AND w.node_id = i.node_id
        JOIN (SELECT doc_no, count(*) AS n FROM chunks GROUP BY doc_no) c ON c.doc_no = w.doc_no GROUP BY w.doc_no"""),
    "leaf_nodes": Q.with_(Q.NODES, "SELECT doc_no, node_id, title FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_no = n.doc_no AND c.parent_id = n.node_id)"),
    "node_paths": Q.with_(Q.DEPTHS, "SELECT doc_no, node_id, depth, array_to_string(path, '/') AS path FROM walk"),
    "node_text": Q.with_(Q.NODES, "SELECT n.doc_no, node_id, length(substr(t.text, start_char + 1, end_char - start_char)) AS n_chars, md5(substr(t.text, start_char + 1, end_char - start_char)) AS text_md5 FROM nodes n JOIN typed t USING (doc_no)"),
    "node_context": Q.with_(Q.NODES, "SELECT n.doc_no, n.node_id, count(*) AS n_chunks, md5(string_agg(c.text, chr(10) ORDER BY c.chunk_index)) AS text_md5 FROM nodes n JOIN chunks c ON c.doc_no = n.doc_no AND c.chunk_index >= n.start_chunk - 1 AND c.chunk_index < n.end_chunk + 1 GROUP BY ALL"),
    "chunk_text_range": Q.with_(Q.CHUNKS, "SELECT doc_no, count(*) AS n_chunks, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS text_md5 FROM chunks WHERE chunk_index BETWEEN 2 AND 5 GROUP BY doc_no"),
    "fallback_tree": Q.with_(Q.CHUNKS + """, f0 AS (SELECT *, last_value(section_title IGNORE NULLS) OVER (PARTITION BY doc_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS seen, count(section_title) OVER (PARTITION BY doc_no) AS titles FROM chunks),
        f1 AS (SELECT *, CASE WHEN titles = 0 THEN 'Document' ELSE seen END AS t FROM f0 WHERE titles = 0 OR seen IS NOT NULL),
        f2 AS (SELECT *, CASE WHEN t IS DISTINCT FROM lag(t) OVER (PARTITION BY doc_no ORDER BY chunk_index) THEN 1 ELSE 0 END AS new FROM f1),
        f3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS island FROM f2)""",
        "SELECT doc_no, printf('%04d', CAST(island - 1 AS INTEGER)) AS node_id, any_value(t) AS title, 0 AS level, arg_min(start_char, chunk_index) AS start_char, arg_max(end_char, chunk_index) AS end_char, min(chunk_index) AS start_chunk, max(chunk_index) + 1 AS end_chunk FROM f3 GROUP BY doc_no, island"),
    "tree_route": Q.with_(Q.CHUNKS, "SELECT *, CASE WHEN n_titles >= 3 AND titled_share > 0.2 THEN 'chunks' ELSE 'fallback' END AS route FROM (SELECT doc_no, count(DISTINCT section_title) AS n_titles, round(avg(CASE WHEN section_title IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS titled_share FROM chunks GROUP BY doc_no)"),
    "chunk_summary": Q.with_(Q.CHUNKS + """, s0 AS (SELECT *, sum(CASE WHEN section_title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_no ORDER BY chunk_index) AS run FROM chunks),
        s1 AS (SELECT doc_no, chunk_index, '<chunk_' || chunk_index || '> [' || section_title || ']: ' || regexp_replace(replace(substr(text, 1, 200), chr(10), ' '), '^\\s+|\\s+$', '', 'g') || '...' AS line FROM s0 WHERE section_title IS NOT NULL
          UNION ALL SELECT doc_no, min(chunk_index), '  ... ' || count(*) || ' content chunk(s) ...' FROM s0 WHERE section_title IS NULL GROUP BY doc_no, run)""",
        "SELECT s1.doc_no, string_agg(line, chr(10) ORDER BY chunk_index) || chr(10) || chr(10) || 'Total: ' || any_value(n) || ' chunks' AS summary FROM s1 JOIN (SELECT doc_no, count(*) AS n FROM chunks GROUP BY doc_no) c ON c.doc_no = s1.doc_no GROUP BY s1.doc_no"),
    "tree_from_flat": Q.with_(_FLAT, """SELECT o.doc_no, printf('%04d', o.ord) AS node_id, CASE WHEN p.ord IS NOT NULL THEN printf('%04d', p.ord) END AS parent_id, o.title, len(string_split(o.structure, '.')) - 1 AS level, c.start_char, e.end_char, o.a AS start_chunk, o.b AS end_chunk
        FROM ordered o LEFT JOIN ordered p ON p.doc_no = o.doc_no AND o.structure LIKE '%.%' AND p.structure = regexp_replace(o.structure, '\\.[^.]*$', '') AND p.ord < o.ord
        JOIN chunks c ON c.doc_no = o.doc_no AND c.chunk_index = o.a JOIN chunks e ON e.doc_no = o.doc_no AND e.chunk_index = o.b - 1"""),
}
QUERIES = {k: globals()[k] for k in ORACLES}
