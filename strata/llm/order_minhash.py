"""Operator 2: near duplicates by order MinHash, verified by banded alignment.

A text's k-mers are its shingles of five words (fewer words than that: one shingle of them all), each labelled with its
occurrence number. A sketch takes the ``picked`` labelled shingles of smallest hash and keeps them in text order; it
agrees for two texts if those agree in order, so that it follows edit similarity, not just the sets. Texts that share
one of ``sketches`` sketches are candidates. A candidate pair's words are aligned: with M words matched in order,
M / (n1 + n2 - M) of 0.8 or more links two texts. A changed word counts once, not once for each shingle it stands in.
The alignment goes over the diagonals that a similarity of 0.8 can reach, which is exact, a machine word of them at once.

Texts with the same words are one node, so that copies cost nothing. First each text is compared with the smallest of
its sketches' buckets' first members that it isn't too long or short for. Texts of buckets that hold several classes
after that are dealt anew, by their rarest words: by the prefix principle any two similar ones share one of them. There
a bucket's members outside its largest class are compared with all members of other classes, which settles the bucket;
while they are too many for that, its first members, more from round to round, are compared with those of other classes,
so that classes merge. So pairs within a bucket's largest class aren't even met, pairs within others aren't compared, and
no link between texts of a mixed bucket is lost. Pairs whose words' parities differ in more bits than two similar texts'
words can aren't compared. Very short texts, whose few shingles one edit may all change, go to the buckets of rarest
words at once, which are exact.

Hot keys (a bucket or a leader with more than a thousandth of all rows, so at most a thousand for each sketch) are
salted: their members are spread over tasks, and the one row that they meet is repeated.

Defined results: a text without words (null, empty, white space) is a class of its own; the class id is the
smallest doc_id of the class (null if all are); rows with a null id get their text's class; repeated rows all get the
class; of ties (several leaders) the smallest fingerprint leads, whatever the order of rows; very long texts are compared
whole, the alignment's memory is a bit for each word; only doc_id and text are read, so other columns can't clash; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_SPLIT, cut, documents, fresh, text_or_empty
from .components import components
from .texts import hold

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Lists of up to so many texts are broadcast (some 50 bytes each), to shuffle fewer texts; beyond, all are shuffled.
BROADCAST_ROWS = 500_000
#: Lists of up to so many 64-bit keys are broadcast, so that rows without one of them aren't shuffled; beyond, all are.
BROADCAST_KEYS = 2_000_000


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    similarity: float = 0.8
    #: With 20 sketches of 3, a pair that has a share q of its shingles in common is missed with a probability of about
    #: (1 - q ** 3) ** 20: below 0.0001 for q = 0.8 (two of a hundred words changed), 0.0002 for 0.7, 0.07 for 0.5.
    sketches: int = 20
    picked: int = 3
    #: Texts of fewer words, and those that are similar to one, go to the buckets of rarest words at once.
    short: int = 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of a text's words in order; those of known words are kept in a bounded dict."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        hold("word hashes", self.known.clear)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > 200_000:
            known.clear()
        got = list(map(known.get, words))
        if None in got:
            for i, w in enumerate(words):
                if got[i] is None:
                    v = known.get(w)
                    if v is None:
                        v = known[w] = xxh3_64_intdigest(w)
                    got[i] = v
        return np.array(got, np.uint64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """64-bit hashes of the shingles of a sequence of words."""
    k = min(words, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = (s ^ h[i:i + n]) * _MIX[0]
        s ^= s >> np.uint64(32)
    return mix(s)


def occurrences(s: np.ndarray) -> np.ndarray:
    """How often each value stood before."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
    out = np.empty(len(s), np.int64)
    at = np.arange(len(s))
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketch(s: np.ndarray, p: NearDupParams) -> np.ndarray:
    """p.sketches hashes, each of the picked shingles in text order."""
    seeds = mix(np.arange(1, p.sketches + 1, dtype=np.uint64) * _MIX[0])[:, None]
    odd = seeds | np.uint64(1)
    labelled = mix(s + occurrences(s).astype(np.uint64) * _MIX[0])
    rows, top = np.arange(p.sketches), np.uint64(0xFFFFFFFFFFFFFFFF)

    def picked(v: np.ndarray, where: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k = min(p.picked, v.shape[1])
        least, at = np.empty((p.sketches, k), np.uint64), np.empty((p.sketches, k), np.int64)
        for i in range(k):
            j = v.argmin(axis=1)
            least[:, i], at[:, i] = v[rows, j], j
            v[rows, j] = top
        return least, at if where is None else np.take_along_axis(where, at, 1)

    least = where = None
    for a in range(0, len(s), 1 << 14):  # blocks, so that very long texts need no more memory
        v, at = picked((labelled[None, a:a + (1 << 14)] ^ seeds) * odd, None)
        at += a
        least, where = (v, at) if least is None else picked(np.hstack([least, v]), np.hstack([where, at]))
    where = np.sort(where, axis=1)
    out = seeds[:, 0].copy()
    for k in range(where.shape[1]):
        out = mix(out + s[where[:, k]] + _MIX[0])
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most elements matched in order with |i - j| <= band, or more that can be: exact if the two differ by ``band`` at most.

    Bits of an integer stand for the places of ``b``; a cleared bit is a place where the best count of the elements of
    ``a`` so far goes up by one. Blocks of rows see the places in their band alone; those beyond aren't touched yet.
    """
    most = min(len(a), len(b))
    differ = np.flatnonzero(a[:most] != b[:most])
    head = int(differ[0]) if len(differ) else most
    a, b, most = a[head:], b[head:], most - head
    differ = np.flatnonzero(a[len(a) - most:][::-1] != b[len(b) - most:][::-1])
    tail = int(differ[0]) if len(differ) else most
    rows, places = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    if not rows or not places:
        return head + tail
    state, block = (1 << len(places)) - 1, max(1024, 2 * band)
    for first in range(0, len(rows), block):
        lo, hi = max(0, first - band), min(len(places), first + block + band)
        if lo >= hi:
            break
        at: dict[int, int] = {}
        for j, x in enumerate(places[lo:hi]):
            at[x] = at.get(x, 0) | 1 << j
        full = (1 << (hi - lo)) - 1
        seen = state >> lo & full
        state ^= seen << lo
        for x in rows[first:first + block]:
            if x in at:
                up = seen & at[x]
                seen = (seen + up) | (seen - up)
        state |= (seen & full) << lo
    return head + tail + len(places) - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """That of two sequences; where it is below ``least``, a number below it."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(cx[i], cy[j]).sum())  # no alignment has more
    if common < least * (n - common):
        return 0.0
    m = aligned(a, b, int(n * (1 - least) / (1 + least)) + 1)
    return m / (n - m)


def _with_print(docs: DataFrame, name: str) -> DataFrame:
    """Adds the fingerprint of the words, 16 bytes."""
    words = F.btrim(F.regexp_replace(text_or_empty(), WORD_SPLIT, " "))
    return docs.withColumn(name, F.unhex(F.md5(words)))


_NO_WORDS = bytes.fromhex("d41d8cd98f00b204e9800998ecf8427e")  # md5 of nothing


def sketches(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(doc_id, node, n, sketches) of every row; n: words."""
    source = docs.select("doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for b in batches:
            nodes, ns, flat, at = [], [], [], [0]
            for k in range(0, b.num_rows, 1000):
                for t in b.column(1).slice(k, 1000).to_pylist():
                    words = split(t)
                    nodes.append(hashlib.md5(b" ".join(words)).digest())
                    ns.append(len(words))
                    if words:
                        flat.append(sketch(shingles(hashed(words), p.words), p).view(np.int64))
                    at.append(at[-1] + (p.sketches if words else 0))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(ns, pa.int64()), lists], names=["doc_id", "node", "n", "sketches"])

    return source.mapInArrow(run, f"doc_id {kind}, node binary, n bigint, sketches array<bigint>")


def _listed(keys: DataFrame, name: str) -> DataFrame:
    """Written rows of a 64-bit key, marked for a broadcast if they are few enough."""
    keys = cut(keys, name)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _salted(df: DataFrame, key: str, spread: str, few: DataFrame, few_key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """``df`` and ``few`` (few_key, c: its number of rows in df; ...) with a column ``salt``: 0, but for keys with more than
    a thousandth of ``rows``, whose rows are spread by the hash of ``spread`` and whose row in ``few`` is repeated."""
    hot = [r[0] for r in few.filter(F.col("c") > max(2000, rows // 1000)).select(few_key).collect()]  # a thousand for each row that a member has
    if not hot:
        return df.withColumn("salt", F.lit(0)), few.withColumn("salt", F.lit(0))
    spark = df.sparkSession
    listed = F.broadcast(spark.createDataFrame([(x,) for x in hot], f"hot {dict(few.dtypes)[few_key]}"))
    wide = lambda t, k: t.join(listed, F.col(k) == F.col("hot"), "left")
    df = wide(df, key).withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(64))).cast("int")).drop("hot")
    few = wide(few, few_key).withColumn("salt", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(63))))).drop("hot")
    return df, few


def verified(pairs: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b, similarity) of pairs of nodes; texts: (node, text)."""
    pairs = cut(pairs.select("a", "b"), "pairs")
    left, leads = _salted(pairs, "a", "b", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "a", pairs.count())
    # no bound is known for the texts: these joins shuffle, whatever their sizes look like
    ta = texts.withColumnsRenamed({"node": "a", "text": "ta"}).join(leads.select("a", "salt").hint("merge"), "a")
    both = left.join(texts.withColumnsRenamed({"node": "b", "text": "tb"}).hint("merge"), "b").join(ta.hint("merge"), ["a", "salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, last = Words(), (None, None)
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 500):
                for a, x, y in zip(*(batch.column(i).slice(k, 500).to_pylist() for i in (0, 2, 3)), strict=True):
                    if last[0] != a:  # pairs come ordered by a
                        last = (a, hashed(split(x)))
                    out.append(similarity(last[1], hashed(split(y)), p.similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(run, "a binary, b binary, similarity double")


def _roots(parents: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of a forest (a, b): a is the parent of b. Paths are halved until nothing changes."""
    up = parents.select(F.col("b").alias("node"), F.col("a").alias("comp"), F.lit(True).alias("moved"))
    while True:
        up = cut(up, "roots")
        if up.filter("moved").isEmpty():
            return up.select("node", "comp")
        to = up.select(F.col("node").alias("n"), F.col("comp").alias("onward"))
        up = up.join(to, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("onward", "comp").alias("comp"), F.col("onward").isNotNull().alias("moved"))


def classes(docs: DataFrame, p: NearDupParams = NearDupParams()) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): (doc_id, node) of every row; (node, rep, comp) of every distinct sequence of words."""
    rows = cut(sketches(docs, p), "sketches")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketches").alias("sketches")), "nodes")
    # the buckets that several nodes share, with their first members
    every = nodes.select(F.explode("sketches").alias("bucket"), "node", "n")  # a sketch's hash is its own bucket
    shared = _listed(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket"), "shared")
    every = cut(every.join(shared, "bucket", "left_semi"), "members")
    lead = cut(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("m")).select("bucket", "c", F.col("m.node").alias("a"), F.col("m.n").alias("na")), "leaders")
    dealt, few = _salted(every, "bucket", "node", lead, "bucket", nodes.count())
    active = cut(dealt.join(few, ["bucket", "salt"]).select("bucket", "node", "n", "a", "na"), "buckets")
    small = nodes.filter((F.col("n") > 0) & (F.col("n") < p.short / p.similarity)).select("node")
    wanted = cut(active.select("node").union(small).distinct().join(nodes.select("node", "rep"), "node"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # only texts that are wanted are shuffled
        wanted = F.broadcast(wanted)
    held = docs.select("doc_id", "text").join(wanted.withColumnRenamed("node", "w"), F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = _with_print(held, "node").filter(F.col("node") == F.col("w")).select("node", "text")
    texts = cut(texts.dropDuplicates(["node"]) if not _unique(rows) else texts, "texts")
    # each node with the smallest of its leaders
    fits = "least(n, na) >= %r * greatest(n, na)" % p.similarity
    pairs = active.filter("a < node").filter(fits).groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a"))
    links = cut(verified(pairs, texts, p), "links")
    tested = [links.select("a", "b")]
    moved = _roots(links.filter(F.col("similarity") >= p.similarity))
    comps = cut(nodes.select("node", "rep").join(moved, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("was")), "comps")
    # mixed buckets, and short texts, go on by their rarest words; only their classes can change
    in_class = active.select("bucket", "node").join(moved, "node", "left").select("bucket", F.coalesce("comp", "node").alias("comp"))
    mixed = in_class.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
    some = active.join(mixed, "bucket").select("node").union(small).distinct()
    now = cut(comps.join(some, "node").select("node", "was", F.col("was").alias("comp")), "now")
    held = cut(texts.join(now.select("node"), "node"), "held")
    active = cut(_prefix_buckets(held, p).join(_parities(held), "node").select(*_MEMBER), "prefixes")
    leaders, near = 4, _near(p)
    while True:
        members = active.join(now.select("node", "comp"), "node")
        alive = _mixed_buckets(members).withColumn("settled", F.col("minors") <= leaders)
        members = cut(members.join(alive, "bucket").select(*_MEMBER, "comp", (F.col("comp") != F.col("major")).alias("minor"), "settled"), "members")
        if members.isEmpty():
            break
        few = members.filter("settled and minor").unionByName(_first_of(members.filter("not settled"), leaders))
        lead = few.select("bucket", *(F.col(c).alias(f"{c}_x") for c in (*_MEMBER[1:], "comp")))
        pairs = members.join(lead.hint("merge"), "bucket").filter(near)
        pairs = pairs.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()
        for known in tested:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        links = cut(verified(pairs, texts, p), "links")
        tested.append(links.select("a", "b"))
        active = members.filter("not settled").select(*_MEMBER)
        alike = links.filter(F.col("similarity") >= p.similarity)
        if not alike.isEmpty():
            ca, cb = (now.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in ("a", "b"))
            edges = alike.join(ca, "a").join(cb, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
            onto = components(edges).withColumnsRenamed({"node": "from", "comp": "to"})
            now = cut(now.join(onto, now["comp"] == onto["from"], "left").select("node", "was", F.coalesce("to", "comp").alias("comp")), "now")
        leaders *= 64
    changed = now.filter("was <> comp").select("was", "comp").distinct()
    return rows.select("doc_id", "node"), comps.join(changed, "was", "left").select("node", "rep", F.coalesce("comp", "was").alias("comp"))


#: Columns of a member of a bucket of rarest words.
_MEMBER = ("bucket", "node", "n", "r", "leads", "p0", "p1", "p2", "p3")


def _near(p: NearDupParams) -> str:
    """Whether two members (the other's columns end with _x) can be similar. Of two that meet in their first common word
    the one that isn't longer leads, and no more than the rest of either can agree; each word that only one of them has
    changes one parity."""
    differ = " + ".join(f"bit_count(p{i} ^ p{i}_x)" for i in range(4))
    return (f"node <> node_x and comp <> comp_x and (n > n_x or leads) and (n_x > n or leads_x) and least(n, n_x) >= {p.similarity!r} * greatest(n, n_x)"
            f" and 1 + least(n - r, n_x - r_x) >= {p.similarity / (1 + p.similarity)!r} * (n + n_x) - 0.000001"
            f" and {differ} <= {(1 - p.similarity) / (1 + p.similarity)!r} * (n + n_x) + 0.000001")


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """(bucket, major, minors) of buckets with several classes and a leading member: the largest class and the number of
    members outside it."""
    groups = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.bool_or("leads").alias("any"))
    of = groups.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("c"), F.bool_or("any").alias("any"))
    return of.filter("any and c > m.c").select("bucket", F.col("m.comp").alias("major"), (F.col("c") - F.col("m.c")).alias("minors"))


def parities(h: np.ndarray) -> np.ndarray:
    """Of each of 256 classes of word hashes whether an odd number of words is in it, as four 64-bit integers."""
    return np.packbits(np.bincount((mix(h) & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64)


def _parities(texts: DataFrame) -> DataFrame:
    """(node, p0 to p3) of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for b in batches:
            out = np.zeros((b.num_rows, 4), np.int64)
            for k in range(0, b.num_rows, 500):
                for i, t in enumerate(b.column(1).slice(k, 500).to_pylist()):
                    out[k + i] = parities(hashed(split(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, i]) for i in range(4))], names=["node", "p0", "p1", "p2", "p3"])

    return texts.select("node", "text").mapInArrow(run, "node binary, p0 bigint, p1 bigint, p2 bigint, p3 bigint")


def _prefix_buckets(texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(bucket, node, n, r, leads): of each text its rarest labelled words, as many as two similar texts must have one in
    common of: with n words, n - ceil(similarity * n) + 1 in an order that holds for all texts. Of two similar texts the
    one that isn't longer has it among fewer still, as 2 * similarity / (1 + similarity) of its words must agree:
    these lead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                at, out, ns = [], [], []
                for i, t in enumerate(b.column(1).slice(k, 500).to_pylist()):
                    s = hashed(split(t))
                    out.append(mix(s + occurrences(s).astype(np.uint64) * _MIX[0]).view(np.int64))
                    at.append(np.full(len(s), k + i))
                    ns.append(np.full(len(s), len(s)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), b.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(ns))], names=["bucket", "node", "n"])

    every = cut(texts.select("node", "text").mapInArrow(run, "bucket bigint, node binary, n bigint"), "words")
    often = _listed(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    order = W.partitionBy("node").orderBy("often", "bucket")  # a text's own words; those that stand once come before
    least = lambda share: F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("node"))
    kept = every.join(often, "bucket").withColumn("r", alone + F.row_number().over(order)).filter(F.col("r") <= least(p.similarity))
    return kept.select("bucket", "node", "n", F.col("r").cast("int").alias("r"), (F.col("r") <= least(2 * p.similarity / (1 + p.similarity))).alias("leads"))


def _first_of(members: DataFrame, k: int) -> DataFrame:
    """The k members of each bucket with the smallest nodes, by partial aggregation."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)))
    few = salted.withColumn("place", F.row_number().over(W.partitionBy("bucket", "salt").orderBy("node"))).filter(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy("node"))).filter(F.col("place") <= k).select(*members.columns)


def _unique(rows: DataFrame) -> bool:
    """Whether no (id, words) stands twice: then each node's text is found once."""
    return rows.groupBy("doc_id", "node").count().filter("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(doc_id, class_id) of every row."""
    rows, nodes = classes(docs, p)
    ids = nodes.groupBy("comp").agg(F.min("rep").alias("class_id"))
    by_node = nodes.join(ids, "comp").select("node", "class_id")
    out = rows.join(by_node, "node")
    return out.select("doc_id", F.when(F.col("node") == F.lit(_NO_WORDS), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` without those that are near duplicates of a kept one: of each class the row with the
    smallest id stays (of rows that agree in id and words, one); rows without words all stay."""
    node, one, rank = (fresh(docs, x) for x in ("node", "one", "rank"))
    _, nodes = classes(docs, p)
    best = nodes.filter(F.col("node") != F.lit(_NO_WORDS)).groupBy("comp").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("m"))
    best = cut(best.select(F.col("m.node").alias(one), F.col("m.rep").alias(f"{one}_id")), "best")
    printed = _with_print(docs, node)
    kept = printed.join(best, (F.col(node) == F.col(one)) & F.col("doc_id").eqNullSafe(F.col(f"{one}_id")), "left").filter(F.col(one).isNotNull() | (F.col(node) == F.lit(_NO_WORDS)))
    again = F.when(F.col(one).isNotNull(), F.row_number().over(W.partitionBy(node, one).orderBy(F.col("doc_id").asc_nulls_last()))).otherwise(F.lit(1))
    if kept.filter(F.col(one).isNotNull()).groupBy(node).count().filter("count > 1").isEmpty():
        return kept.select(*docs.columns)
    return kept.withColumn(rank, again).filter(F.col(rank) == 1).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op2_order_minhash": query}
ORACLES: dict = {}
