"""Operator 10: url filters by Bloom filter cascades.

The keys of a table of urls (host, and as much of the path as the longest rule's has) are all known, so a
cascade of filters gives exact membership: level 1 holds the listed keys, level 2 those unlisted keys of the
universe that level 1 takes for listed, level 3 those listed ones that level 2 takes for unlisted, and so on
until a level makes no mistake. The first level that lacks a key decides. Each rule has a cascade of the keys
that it governs. Urls are looked up in the cascades, without a join.

Keys are spread by hash over segments of bounded size, each built in one task from its distinct keys. The
filters are sent to the executors up to ``broadcast_bytes``; beyond, urls and filters meet by segment in one shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; urls that no rule
governs are in no cascade and are allowed; of rules of equal length the one with the longer host wins, then the earlier
in the list; a null page_id stays; very long urls are keyed by host and as much of the path as rules have; repeated rows are judged one by one; columns
other than page_id and url aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: (action, host, path); of the rules that fit, the longest host and path wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, HASHES = 8, 5
SEGMENT_KEYS = 1 << 20


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    pattern = "^([^/?#]*)([^?#]*)"
    return df.withColumn("host", F.translate(F.regexp_extract(rest, pattern, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(rest, pattern, 2))


def governing(rules=RULES) -> Column:
    """Number of the rule that governs host and path; -1: none. For the distinct keys that cascades are built from."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1])))
    fits = lambda h, p: ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
    return reduce(lambda c, i: F.when(fits(*rules[i][1:]), F.lit(i)).otherwise(c), reversed(order), F.lit(-1))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Places of keys in a level's filter: double hashing, mixed anew for each level."""
    with np.errstate(over="ignore"):
        x = (h1 + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        y = (h2 ^ (np.uint64(level + 1) * np.uint64(0x94D049BB133111EB))) * np.uint64(0xD6E8FEB86659FD93)
        y = (y ^ y >> np.uint64(32)) | np.uint64(1)
        return [(x + np.uint64(i) * y) % np.uint64(bits) for i in range(HASHES)]


def _has(filt: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for p in _places(h1, h2, level, len(filt) * 8):
        ok &= filt[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1
    return ok


def build(listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The levels of a cascade over two disjoint sets of keys (two 64-bit hashes of each)."""
    levels: list[np.ndarray] = []
    put, test = listed, others
    while len(put[0]):
        if len(levels) > 200:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        filt = np.zeros(max(8, len(put[0]) * BITS // 8 + 1), np.uint8)
        for p in _places(*put, len(levels), len(filt) * 8):
            np.bitwise_or.at(filt, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        wrong = _has(filt, *test, len(levels))
        levels.append(filt)
        put, test = (test[0][wrong], test[1][wrong]), put
    return levels


def member(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: a key is listed if the first level that lacks it is an even one (counted from 1)."""
    out = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for k, filt in enumerate(levels):
        ok = _has(filt, h1[live], h2[live], k)
        out[live[~ok]] = k % 2 == 1
        live = live[ok]
    out[live] = len(levels) % 2 == 1
    return out


def cascades(keys: DataFrame, segments: int, n_rules: int) -> DataFrame:
    """(segment, rule, level, filter) from distinct keys (h1, h2, segment, rule)."""
    def one(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        rule, seg = table.column("rule").to_numpy(), table.column("segment")[0].as_py()
        rows = []
        for r in range(n_rules):
            on = rule == r
            rows += [(seg, r, k, f.tobytes()) for k, f in enumerate(build((h1[on], h2[on]), (h1[~on], h2[~on])))]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["segment", "rule", "level", "filter"])

    return keys.groupBy("segment").applyInArrow(one, "segment int, rule int, level int, filter binary")


def _look(held: dict[int, list[np.ndarray]], n: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
    """Writes the governing rule of the rows ``at`` into ``n``, by one segment's cascades."""
    for r, levels in held.items():
        n[at[member(levels, h1[at], h2[at])]] = r


def _unsigned(b: pa.RecordBatch, col: str) -> np.ndarray:
    return b.column(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _looked_at_once(hashed: DataFrame, filters: DataFrame, segments: int, schema: str) -> DataFrame:
    """All filters go to the executors; urls aren't shuffled."""
    held: dict[int, dict[int, list[np.ndarray]]] = {}
    for s, r, _, f in filters.orderBy("segment", "rule", "level").collect():
        held.setdefault(s, {}).setdefault(r, []).append(np.frombuffer(f, np.uint8))
    sent = hashed.sparkSession.sparkContext.broadcast(held)

    def look(batches):
        for b in batches:
            h1, h2 = _unsigned(b, "h1"), _unsigned(b, "h2")
            where = b.column("h1").to_numpy(zero_copy_only=False) % segments
            n = np.full(len(h1), -1, np.int32)
            for s, own in sent.value.items():
                _look(own, n, np.flatnonzero(where == s), h1, h2)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(n)], names=["page_id", "host", "path", "n"])

    return hashed.mapInArrow(look, schema)


def _looked_by_segment(hashed: DataFrame, filters: DataFrame, universe: DataFrame, segments: int, schema: str, part_rows: int) -> DataFrame:
    """Urls meet the filters of their segment in one shuffle, the filters first. A segment of many urls (a hot key's) is
    salted into parts of about ``part_rows``, each with a copy of its filters; a task streams its urls past them."""
    seg = F.pmod(F.col("h1"), F.lit(segments)).cast("int")
    parts = cut(universe.groupBy(seg.alias("segment")).agg(F.ceil(F.sum("n") / part_rows).cast("int").alias("parts")), "parts")
    levels = filters.join(parts, "segment").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("segment", "salt", "rule", "level", "filter")
    urls = hashed.withColumn("place", F.monotonically_increasing_id()).withColumn("segment", seg).join(parts, "segment")
    urls = urls.withColumn("salt", F.pmod(F.col("place"), F.col("parts")).cast("int")).drop("place", "parts")
    both = urls.unionByName(levels, allowMissingColumns=True).repartition("segment", "salt").sortWithinPartitions("segment", "salt", F.col("filter").isNull(), "rule", "level")

    def look(batches):
        own, held = None, {}
        for b in batches:
            h1, h2 = _unsigned(b, "h1"), _unsigned(b, "h2")
            group = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "salt")], 1)
            url = np.asarray(b.column("filter").is_null().to_numpy(zero_copy_only=False))
            n = np.full(len(h1), -1, np.int32)
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(1)]) if len(h1) else []
            for i, j in zip(starts, [*starts[1:], len(h1)], strict=True):
                if own != tuple(group[i]):
                    own, held = tuple(group[i]), {}
                for k in i + np.flatnonzero(~url[i:j]):
                    held.setdefault(b.column("rule")[int(k)].as_py(), []).append(np.frombuffer(b.column("filter")[int(k)].as_py(), np.uint8))
                _look(held, n, i + np.flatnonzero(url[i:j]), h1, h2)
            out = pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(n)], names=["page_id", "host", "path", "n"])
            yield out.filter(pa.array(url))

    return both.mapInArrow(look, schema)


def url_filter(pages: DataFrame, rules=RULES, segment_keys: int = SEGMENT_KEYS, broadcast_bytes: int = 256 << 20, part_rows: int = 1 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    longest = max(len(p) for _, _, p in rules)
    key = [F.col("host"), F.substring("path", 1, longest)]
    named = with_host_path(pages.select("page_id", "url"))
    distinct = named.groupBy(key[0], key[1].alias("path")).agg(F.count(F.lit(1)).alias("n"))
    universe = cut(distinct.select(F.xxhash64(F.lit(1), "host", "path").alias("h1"), F.xxhash64(F.lit(2), "host", "path").alias("h2"), governing(rules).alias("rule"), "n"), "universe")
    segments = -(-universe.count() // segment_keys) or 1
    seg = F.pmod(F.col("h1"), F.lit(segments)).cast("int").alias("segment")
    filters = cut(cascades(universe.select("h1", "h2", seg, "rule"), segments, len(rules)), "cascades")
    total = filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    hashed = named.select("page_id", "host", "path", F.xxhash64(F.lit(1), key[0], key[1]).alias("h1"), F.xxhash64(F.lit(2), key[0], key[1]).alias("h2"))
    schema = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, n int"
    looked = _looked_at_once(hashed, filters, segments, schema) if total <= broadcast_bytes else _looked_by_segment(hashed, filters, universe, segments, schema, part_rows)
    name = reduce(lambda c, i: F.when(F.col("n") == i, F.lit(rules[i][1] + rules[i][2])).otherwise(c), range(len(rules)), F.lit(None).cast("string"))
    verdict = reduce(lambda c, i: F.when(F.col("n") == i, F.lit(rules[i][0])).otherwise(c), range(len(rules)), F.lit("allow"))
    return looked.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle(rules=RULES) -> str:
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda value, last: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(a, h, p)}'" for a, h, p in order) + f" ELSE {last} END"
    return f"""WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM r)
SELECT page_id, host, path, {case(lambda a, h, p: h + p, "NULL")} AS rule, {case(lambda a, h, p: a, "'allow'")} AS verdict FROM p"""


QUERIES = {"op10_bloom_cascade": query}
ORACLES = {"op10_bloom_cascade": _oracle()}
