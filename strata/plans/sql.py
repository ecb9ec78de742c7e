"""DuckDB statements of what the structure operators compute, as common table expressions that build on each other."""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.tables import filings_sql, sql_string


def matches(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, {sql_string(f'(?{flags})' + pattern)})"


def hits(text: str, ps: list[str]) -> str:
    return "(" + " + ".join(f"CAST({matches(text, p)} AS INTEGER)" for p in ps) + ")"


def type_sql(text: str, name: str | None = None) -> str:
    sample = f"lower(substr({text}, 1, 20000))"
    rules = []
    if name:
        rules += [" AND ".join(f"contains(lower({name}), '{x}')" for x in parts) + f" THEN '{kind}'" for parts, kind in P.NAME_RULES]
    rules += [matches(sample, "(?:" + "|".join(ps) + ")") + f" THEN '{k}'" for k, ps in P.SEC_TYPES.items()]
    rules += [hits(sample, ps) + f" >= 2 THEN '{k}'" for k, ps in P.OTHER_TYPES.items()]
    return f"CASE WHEN coalesce(length({text}), 0) = 0 THEN 'generic' " + " ".join(f"WHEN {r}" for r in rules) + " ELSE 'generic' END"


def level_sql(line: str, kind: str) -> str:
    chain = lambda t: "CASE " + " ".join(f"WHEN {matches(line, p)} THEN {n}" for p, n in P.headers_of(t)) + " END"
    return f"CASE {kind} " + " ".join(f"WHEN '{t}' THEN {chain(t)}" for t in P.TYPE_HEADERS) + f" ELSE {chain('generic')} END"


TYPED = filings_sql() + f", typed AS (SELECT doc_no, doc_name, text, {type_sql('text')} AS doc_type FROM filings)"
HEADERS = TYPED + f""",
lines AS (SELECT doc_no, doc_type, n_chars, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_no, doc_type, length(text) AS n_chars, string_split(text, chr(10)) AS ls FROM typed)),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_no ORDER BY i) - length(line) - 1 AS start FROM lines),
headers AS (SELECT doc_no, n_chars, CAST(start AS BIGINT) AS start, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS title, level
  FROM (SELECT *, {level_sql("line", "doc_type")} AS level FROM placed WHERE line <> '') WHERE level IS NOT NULL)"""
SECTIONS = HEADERS + """,
sections AS (SELECT doc_no, start, coalesce(lead(start) OVER (PARTITION BY doc_no ORDER BY start), n_chars) AS stop, title, level FROM headers
  UNION ALL SELECT t.doc_no, 0, coalesce(f.first, length(t.text)), NULL, 0 FROM typed t LEFT JOIN (SELECT doc_no, min(start) AS first FROM headers GROUP BY doc_no) f USING (doc_no) WHERE f.first IS NULL OR f.first > 0)"""
#: Chunks of the default size (7000 characters): a longer section, of one paragraph, is a chunk up to one and a half times
#: that; beyond, its sentences are put together up to the size.
CHUNKS = SECTIONS + """,
cuts AS MATERIALIZED (SELECT * FROM (SELECT s.doc_no, s.start, s.title, s.level, substr(t.text, CAST(s.start + 1 AS BIGINT), CAST(s.stop - s.start AS BIGINT)) AS text FROM sections s JOIN typed t USING (doc_no)) WHERE regexp_matches(text, '\\S')),
bodies_long AS MATERIALIZED (SELECT doc_no, start, title, level, start + length(text) - length(regexp_replace(text, '^\\s+', '')) AS b, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM cuts WHERE length(text) > 7000),
marked AS (SELECT doc_no, start, title, level, b, unnest(p) AS part, generate_subscripts(p, 1) AS k
  FROM (SELECT *, string_split(regexp_replace(body, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS p FROM bodies_long WHERE length(body) > 10500)),
told_parts AS (SELECT *, CASE WHEN k = 1 THEN part ELSE split_part(part, chr(2), 2) END AS s, CASE WHEN k = 1 THEN length(part) ELSE length(part) - 1 END AS n FROM marked),
sent AS MATERIALIZED (SELECT doc_no, start, title, level, k, s, CAST(b + sum(n) OVER (PARTITION BY doc_no, start ORDER BY k ROWS UNBOUNDED PRECEDING) - length(s) AS BIGINT) AS place FROM told_parts),
packed AS MATERIALIZED (WITH RECURSIVE r AS (SELECT doc_no, start, k, 1 AS grp, length(s) AS held FROM sent WHERE k = 1
  UNION ALL SELECT x.doc_no, x.start, x.k, r.grp + CASE WHEN r.held + length(x.s) > 7000 THEN 1 ELSE 0 END, CASE WHEN r.held + length(x.s) > 7000 THEN length(x.s) ELSE r.held + 1 + length(x.s) END
  FROM r JOIN sent x ON x.doc_no = r.doc_no AND x.start = r.start AND x.k = r.k + 1) SELECT * FROM r),
pieces AS (SELECT doc_no, start, title, level, start AS place, text FROM cuts WHERE length(text) <= 7000
  UNION ALL SELECT doc_no, start, title, level, b, body FROM bodies_long WHERE length(body) <= 10500
  UNION ALL SELECT doc_no, start, title, level, min(place), string_agg(s, ' ' ORDER BY k) FROM sent JOIN packed USING (doc_no, start, k) GROUP BY doc_no, start, title, level, grp),
chunks AS MATERIALIZED (SELECT doc_no, row_number() OVER (PARTITION BY doc_no ORDER BY start, place) - 1 AS chunk_index, place AS start_char, place + length(text) AS end_char, title AS section_title, level AS section_level, text FROM pieces)"""
NODES = CHUNKS + """,
named AS (SELECT *, last_value(section_title IGNORE NULLS) OVER (PARTITION BY doc_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS seen FROM chunks),
flagged AS (SELECT *, coalesce(seen, 'Introduction') AS title, CASE WHEN seen IS NULL THEN 0 ELSE section_level END AS lvl FROM named),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, CASE WHEN title IS DISTINCT FROM lag(title) OVER (PARTITION BY doc_no ORDER BY chunk_index) THEN 1 ELSE 0 END AS new FROM flagged)),
flatnodes AS (SELECT doc_no, CAST(island - 1 AS INTEGER) AS ord, arg_min(title, chunk_index) AS title, arg_min(lvl, chunk_index) AS level, arg_min(start_char, chunk_index) AS start_char, arg_max(end_char, chunk_index) AS own_end,
  min(chunk_index) AS start_chunk, max(chunk_index) + 1 AS own_stop FROM islands GROUP BY doc_no, island),
parented AS (SELECT a.*, (SELECT max(b.ord) FROM flatnodes b WHERE b.doc_no = a.doc_no AND b.ord < a.ord AND b.level < a.level) AS parent FROM flatnodes a),
nodes AS (SELECT p.doc_no, printf('%04d', p.ord) AS node_id, p.ord, CASE WHEN p.parent IS NOT NULL THEN printf('%04d', p.parent) END AS parent_id, p.title, p.level, p.start_char,
  greatest(p.own_end, c.ce) AS end_char, p.start_chunk, greatest(p.own_stop, c.cc) AS end_chunk
  FROM parented p LEFT JOIN (SELECT doc_no, parent AS ord, max(own_end) AS ce, max(own_stop) AS cc FROM parented WHERE parent IS NOT NULL GROUP BY ALL) c USING (doc_no, ord))"""
DEPTHS = NODES + """,
walk AS (WITH RECURSIVE r AS (SELECT doc_no, node_id, 0 AS depth, [node_id] AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.doc_no, n.node_id, r.depth + 1, list_append(r.path, n.node_id) FROM nodes n JOIN r ON n.doc_no = r.doc_no AND n.parent_id = r.node_id) SELECT * FROM r)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"
