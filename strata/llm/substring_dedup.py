"""Operator 7: substring dedup with a compressed FM-index for each shard.

Every window of 20 words has an anchor, the least hash among its runs of eight words (the first of equals), so equal
windows have equal anchors; windows side by side that share one anchor form a region. Regions whose anchor stands
in one place only (copies of a text count once) can't repeat. The others are dealt to shards by anchor, so that all
occurrences of a window meet in one shard. Regions of an anchor that stands in more than ``HOT_REGIONS`` places are taken
apart into single windows, dealt by the windows' words, so that equal windows still meet and a shard's size in words stays
bounded. Equal regions go there once, with their first place. A shard's regions, in the order of their places, are the text of its FM-index; backward search over its
wavelet matrix, streamed over all regions side by side, finds for each region the longest stretches that also stand
earlier, and so the windows that do. Windows are compared word by word, not by hashes.

A region that stands earlier as a whole has all its windows removed; of a region's first place the index says which
windows are kept. Removed are the words that a window with an earlier occurrence covers. Of a text that an earlier
document has (equal 128-bit hashes) all windows go.

Defined results: null, empty and blank texts have no words and keep none; documents are ordered by doc_id, nulls
first; rows with the same id and text are one document, so that neither removes the other; rows with one id and
different texts are told apart by the text; only needed columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, drop_cut, free_shuffles, fresh, text_or_empty
from .fm_index import CONTEXT, FmIndex, repeated_windows
from .order_minhash import mix
from .texts import hold

WINDOW, RUN = 20, 8
#: Words of a shard, about.
SHARD_WORDS = 1_200_000
#: Places of an anchor beyond which its regions are dealt window by window.
HOT_REGIONS = 10_000
#: Lists of up to so many texts are broadcast, to shuffle fewer texts; beyond, all are shuffled.
BROADCAST_ROWS = 1_000_000
assert 2 * WINDOW - RUN <= CONTEXT  # the longest region
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Regions:
    """Splits texts into words and finds their regions; words' hashes are kept in a bounded dict."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        hold("regions", self.known.clear)

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, anchor) of each region."""
        from xxhash import xxh3_64_intdigest

        if len(words) < WINDOW:
            none = np.zeros(0, np.int64)
            return none, none, none
        known = self.known
        if len(known) > 200_000:
            known.clear()
        got = list(map(known.get, words))
        if None in got:
            for k, w in enumerate(words):
                if got[k] is None:
                    v = known.get(w)
                    if v is None:
                        v = known[w] = xxh3_64_intdigest(w)
                    got[k] = v
        h = np.array(got, np.uint64)
        n = len(h) - RUN + 1
        s = np.zeros(n, np.uint64)
        for k in range(RUN):
            s = (s ^ h[k:k + n]) * _GOLD
            s ^= s >> np.uint64(32)
        s = mix(s)
        span = WINDOW - RUN + 1
        at = np.lib.stride_tricks.sliding_window_view(s, span).argmin(axis=1) + np.arange(n - span + 1)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return begin, np.diff(np.append(begin, len(at))), s[at[begin]].view(np.int64)


def _key():
    """128 bits of a text, as one string of 16 bytes."""
    t = text_or_empty()
    return F.concat(F.unhex(F.lpad(F.hex(F.xxhash64(t)), 16, "0")), F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(1), t)), 16, "0")))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _key().alias("tk"), "text")


def _regions(docs: DataFrame) -> DataFrame:
    """(tk, place, anchor) of all regions of all documents; place: first window * 32 + number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Regions()
        for b in batches:
            at, cols = [], [[], []]
            for i, t in enumerate(b.column(1).to_pylist()):
                start, n, anchor = find(find.words(t))
                if len(start):
                    at.append(np.full(len(start), i))
                    cols[0].append(start * 32 + n)
                    cols[1].append(anchor)
            if at:
                place, anchor = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), pa.array(place), pa.array(anchor)], names=["tk", "place", "anchor"])

    return docs.select(_key().alias("tk"), "text").mapInArrow(run, "tk binary, place bigint, anchor bigint")


def _told(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, tk, start, anchor, words) of the regions listed for each text, from its first document; no anchor: a single window."""
    source = _with_key(docs)
    if reps.count() <= BROADCAST_ROWS:  # fewer texts to shuffle
        source = source.join(F.broadcast(reps.select("tk")), "tk", "left_semi")
    r = reps.withColumnsRenamed({"tk": "k", "doc_id": "i"})
    both = source.join(r, (F.col("tk") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "tk", "text", "regions")
    kind = dict(reps.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, starts, anchors, texts, size = [], [], [], [], 0

            def out(b=b, at=at, starts=starts, anchors=anchors, texts=texts):
                take = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int64()), pa.array(anchors, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "tk", "start", "anchor", "words"])

            for i, (t, rs) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                for r in rs:
                    start, n = divmod(r["place"], 32)
                    at.append(i)
                    starts.append(start)
                    anchors.append(r["anchor"])
                    texts.append(b" ".join(words[start:start + n + WINDOW - 1]))
                size += len(words)
                if size > 500_000:
                    yield out()
                    size = 0
                    for x in (at, starts, anchors, texts):
                        x.clear()
            yield out()

    return both.mapInArrow(run, f"doc_id {kind}, tk binary, start bigint, anchor bigint, words binary")


def _search(table: pa.Table) -> pa.Table:
    """Of a shard's distinct regions (doc_id, tk, start, words), those of which windows are kept: bits of these windows."""
    order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("start", "ascending"), ("tk", "ascending")], null_placement="at_start")
    table = table.take(order)
    regions = [w.split(b" ") for w in table.column("words").to_pylist()]
    number: dict[bytes, int] = {}
    text, base = [], []
    for ws in regions:
        base.append(len(text))
        text.extend([number.setdefault(w, len(number) + 1) for w in ws])
        text.append(0)
    windows = np.array([len(ws) - WINDOW + 1 for ws in regions])
    earlier = repeated_windows(FmIndex(np.array(text, np.int64)), np.array(base), windows, WINDOW)
    kept = ((np.int64(1) << windows) - 1) & ~earlier
    on = np.flatnonzero(kept)
    return table.select(["tk", "start"]).take(pa.array(on)).append_column("kept", pa.array(kept[on]))


def findings(docs: DataFrame, shard_words: int = SHARD_WORDS, hot: int | None = None) -> DataFrame:
    """(tk, doc_id, regions, firsts) of each text that has copies or repeated anchors: its smallest id, its regions,
    array of (place, anchor), and of those whose first place it has, array of (start, kept bits)."""
    found = cut(_regions(docs), "regions")
    place = F.xxhash64("tk", "place")
    anchors = found.groupBy("anchor").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("c")).filter("x <> y")
    anchors = cut(anchors.select(F.col("anchor").alias("a"), (F.col("c") > (HOT_REGIONS if hot is None else hot)).alias("hot")), "anchors")
    free_shuffles()
    several = found.join(anchors, F.col("anchor") == F.col("a"))
    single = F.transform(F.sequence(F.lit(0).cast("long"), F.col("place") % 32 - 1), lambda i: (F.expr("place div 32") + i) * 32 + 1)
    several = several.select("tk", F.explode(F.when(F.col("hot"), single).otherwise(F.array("place"))).alias("place"), F.when(~F.col("hot"), F.col("anchor")).alias("anchor"))
    listed = several.groupBy("tk").agg(F.collect_set(F.struct("place", "anchor")).alias("regions"))  # a text's own regions
    texts = docs.groupBy(_key().alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    table = texts.join(listed, F.col("k") == F.col("tk"), "left").filter("copies > 1 or regions is not null").select(F.col("k").alias("tk"), "doc_id", "regions")
    table = cut(table, "reps")
    drop_cut(found)
    free_shuffles()
    reps = table.filter("regions is not null")
    words = reps.agg(F.sum(F.aggregate("regions", F.lit(0).cast("long"), lambda s, r: s + r["place"] % 32 + F.lit(WINDOW)))).first()[0] or 0
    distinct = _told(docs, reps).groupBy("words").agg(F.min(F.struct("doc_id", "start", "tk", "anchor")).alias("m"))
    shards = max(-(-words // shard_words), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = distinct.select("m.doc_id", "m.tk", "m.start", "words", F.pmod(F.coalesce("m.anchor", F.xxhash64("words")), F.lit(shards)).alias("shard"))
    firsts = dealt.groupBy("shard").applyInArrow(_search, "tk binary, start bigint, kept bigint")
    firsts = firsts.groupBy("tk").agg(F.collect_list(F.struct("start", "kept")).alias("firsts")).withColumnRenamed("tk", "k")
    out = cut(table.join(firsts, F.col("tk") == F.col("k"), "left").drop("k"), "findings")
    drop_cut(table)
    free_shuffles()
    return out


def removed_words(n: int, regions: list[dict] | None, firsts: list[dict] | None) -> np.ndarray:
    """Which of a document's n words go."""
    kept = {r["start"]: r["kept"] for r in firsts or ()}
    edge = np.zeros(n + 1, np.int64)
    for r in regions or ():
        s, m = divmod(r["place"], 32)
        bits = kept.get(s, 0)
        if not bits:
            edge[s] += 1
            edge[s + m - 1 + WINDOW] -= 1
        else:
            for i in range(m):
                if not bits >> i & 1:
                    edge[s + i] += 1
                    edge[s + i + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_removed(docs: DataFrame, keep: tuple[str, ...], columns: list[tuple[str, str, pa.DataType]], make: Callable) -> DataFrame:
    """``keep`` columns of every row and new ones: ``make()`` gives a function of (text, words, removed or None)."""
    key, did, r, f, here = (fresh(docs, x) for x in ("key", "id", "regions", "firsts", "here"))
    listed = findings(docs).withColumnsRenamed({"tk": key, "doc_id": did, "regions": r, "firsts": f})
    needed = list(dict.fromkeys([*keep, "text", "doc_id"]))
    source = docs.select(*needed).withColumn(here, _key())
    first = F.col("doc_id").eqNullSafe(F.col(did))
    if listed.count() <= BROADCAST_ROWS:  # only texts that have regions of their own are shuffled, and of copies the first alone
        ids = F.broadcast(listed.select(key, did, F.col(r).isNotNull().alias(f)))
        told = source.join(ids, F.col(here) == F.col(key), "left")
        state = F.when(F.col(key).isNull(), F.lit(0)).when(first, F.lit(1)).otherwise(F.lit(2))
        told = told.select(*needed, here, state.alias(key), (first & F.coalesce(F.col(f), F.lit(False))).alias(f))
        nothing = [F.lit(None).cast(dict(listed.dtypes)[c]).alias(c) for c in (r, f)]
        own = told.filter(F.col(f)).drop(f).withColumnRenamed(key, did + "_").join(listed.drop(did), F.col(here) == F.col(key)).select(*needed, F.col(did + "_").alias(here), r, f)
        joined = own.union(told.filter(~F.coalesce(F.col(f), F.lit(False))).drop(f).select(*needed, F.col(key).alias(here), *nothing))
    else:
        state = F.when(F.col(key).isNull(), F.lit(0)).when(first, F.lit(1)).otherwise(F.lit(2))  # not listed, first of its text, later copy
        joined = source.join(listed, F.col(here) == F.col(key), "left").select(*needed, state.alias(here), r, f)
    extra = ["text"] * ("text" not in keep)
    source = joined.select(*keep, *extra, r, f, here)
    place = source.columns.index("text")
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {k}" for n, k, _ in columns)])
    names, types = [n for n, _, _ in columns], [t for _, _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            out = []
            rs, fs, states = (b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1))
            for t, x, y, z in zip(b.column(place).to_pylist(), rs, fs, states, strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                gone = None
                if z == 2 and len(words) >= WINDOW:
                    gone = np.ones(len(words), bool)
                elif z == 1 and x:
                    gone = removed_words(len(words), x, y)
                out.append(work(t, words, gone))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kept = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def _left(words: list[bytes], gone: np.ndarray | None) -> list[bytes]:
    return words if gone is None else [words[i] for i in np.flatnonzero(~gone).tolist()]


def intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans array<struct<start,stop>>): the runs of removed words of every row."""
    def one(_, words, gone):
        if gone is None:
            return len(words), []
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        return len(words), [{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]

    return with_removed(docs, ("doc_id",), [("n_words", "bigint", pa.int64()), ("spans", "array<struct<start: bigint, stop: bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], lambda: one)


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    def one(_, words, gone):
        return len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(b" ".join(_left(words, gone))).hexdigest()

    return with_removed(docs, ("doc_id",), [("n_words", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("kept_sha256", "string", pa.string())], lambda: one)


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that lose words replaced by their kept words joined by spaces; n_chars follows, if it is there."""
    new = fresh(docs, "new")

    def one(text, words, gone):
        return (text if gone is None or not gone.any() else b" ".join(_left(words, gone)).decode("utf-8", "surrogatepass"),)

    out = with_removed(docs, tuple(docs.columns), [(new, "string", pa.string())], lambda: one)
    changed = {"text": F.col(new)}
    if dict(docs.dtypes).get("n_chars") in ("bigint", "int"):
        changed["n_chars"] = F.when(F.col(new).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new).cast(dict(docs.dtypes)["n_chars"]))
    return out.withColumns(changed).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir))


_ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM d, range({WINDOW}) r(o)),
each AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS t, count(*) AS n FROM each e LEFT JOIN gone USING (doc_id, pos) WHERE gone.pos IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op7_fm_index": query}
ORACLES = {"op7_fm_index": _ORACLE}
