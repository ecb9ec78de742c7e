"""Operator 4: packing into sequences of a fixed length by cutting-stock column generation.

A document's ids are cut into full sequences and a rest. The rests' lengths are counted in a histogram of at
most ``length / grid`` classes (rounded up to the grid), whatever the number of documents. Over it a linear
program asks for the fewest sequences: a column is a pattern (how many rests of each class share a sequence),
priced by a knapsack over the classes' dual values (dynamic programming over the length in grid steps), until no
pattern improves it. Its solution is rounded down; what is left over (a bounded number of rests for each
class) is packed by first fit, longest first. Then rests, ranked within their class, are assigned to the
patterns' places, and each sequence lays its pieces one after the other, without gaps.

Only class counts and patterns reach the driver; ranks come from counts for each class and salt, so that no
class is ordered in one task. Ids are never shuffled: pieces are told by where they begin and their checksum.

Pricing ends when no pattern improves the program, after ``most`` steps at the latest; the plan takes each rest once
either way, it may then need more sequences.

Defined results: a null text is packed like the empty one (the end id alone); repeated rows and ids are packed
one by one (rows that agree in all columns are exchangeable, as are ties in id, place and checksum); a very long text
is encoded in parts and cut into full sequences; only doc_id and text are read, so other columns can't clash; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, documents
from .texts import blocks, hold

LENGTH, GRID, END_ID = 4096, 16, 2
CACHE_UNITS, CACHE_CHARS = 500_000, 48
#: Rests of one class and salt that are ranked in one task, about.
SALT_ROWS = 20_000
_LOADED: dict[str, WordTokenizer] = {}


#: Letters whose lower case needs no context and that no normal form changes; a stop after what is no letter, digit or
#: white space of the tokenizer (U+001C to U+001F are none).
_OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]")
_JOINED = re.compile("[^\t-\r \x85\xa0a-z\u00e0-\u00f6\u00f8-\u024f0-9][.,][ \n]")
#: Words of one piece that no normal form changes; the model takes them with their bytes as letters.
_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+").fullmatch
_LETTER_BYTES = {c: "".join([chr(b) if b > 0xA0 and b != 0xAD else chr(0x143 if b == 0xAD else 0xA2 + b) for b in chr(c).encode()]) for c in range(0xE0, 0x100)}


class WordTokenizer:
    """The file's tokenizer over parts between spaces and line ends, which its pre-tokenizer drops anyway;
    parts are encoded once and kept, as little-endian unsigned 32-bit ids, in a bounded dict."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts that are encoded alone. Latin texts are put to lower case here, as the tokenizer would do, and a
        single stop after a letter or digit is a part of its own, as for the tokenizer: fewer parts differ."""
        if _OTHER.search(text) is None and "<|" not in text:
            text = text.lower()
            if _JOINED.search(text) is None:
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ").replace(",\n", " , ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts with the end id."""
        split = [self.split(t or "") for t in texts]
        known = self.parts
        if len(known) >= CACHE_UNITS:
            known.clear()
        rest, long = [], []
        of = self.tokenizer.model.tokenize
        for p in set().union(*split):
            if p not in known:
                if len(p) > CACHE_CHARS:
                    long.append(p)
                if _LETTERS(p) is None:
                    rest.append(p)
                else:
                    known[p] = array("I", [x.id for x in of(p if p.isascii() else p.translate(_LETTER_BYTES))]).tobytes()
        for k in range(0, len(rest), 20_000):
            group = rest[k:k + 20_000]
            known.update(zip(group, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)], strict=True))
        end, ids = END_ID.to_bytes(4, "little"), known.__getitem__
        out = [b"".join(map(ids, parts)) + end for parts in split]
        for p in long:
            del known[p]
        return out


def load(path: str) -> WordTokenizer:
    hold("word ids", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of each full sequence and rest of each document."""
    source = docs.select("doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                at, rows, ids = [], [], []
                for i, raw in zip(range(a, b), tok.encode(texts[a:b]), strict=True):
                    n = len(raw) // 4
                    for s in range(0, n, length):
                        own = raw[4 * s:4 * (s + length)]
                        at.append(i)
                        rows.append((s, len(own) // 4, zlib.crc32(own), n))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    return source.mapInArrow(run, schema)


# ---- the plan, from class counts alone ------------------------------------------------------------------------

def knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of highest value that fits: best[c] over the room in steps, each class any number of times."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    worth = [(int(s), float(v), k) for k, (s, v) in enumerate(zip(sizes, value, strict=True)) if v > 1e-12]
    if worth:
        ss, vs, ks = (np.array(x) for x in zip(*worth, strict=True))
        for c in range(1, room + 1):
            best[c] = best[c - 1]
            ok = ss <= c
            if ok.any():
                got = np.where(ok, best[np.maximum(c - ss, 0)] + vs, -1.0)
                k = int(got.argmax())
                if got[k] > best[c] + 1e-12:
                    best[c], last[c] = got[k], k
        pattern, c = np.zeros(len(sizes), np.int64), room
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                pattern[ks[last[c]]] += 1
                c -= ss[last[c]]
        return float(best[room]), pattern
    return 0.0, np.zeros(len(sizes), np.int64)


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear program's solution, by the revised simplex method."""
    k = len(sizes)
    columns = [np.where(np.arange(k) == i, room // sizes[i], 0) for i in range(k)]
    basis = np.array(columns, float).T
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    for step in range(most):
        dual = inverse.sum(axis=0)  # all columns cost one sequence
        value, pattern = knapsack(dual, sizes, room)
        if value <= 1 + 1e-7:
            break
        move = inverse @ pattern
        up = move > 1e-9
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * move
        x[out] = ratio[out]
        columns[out] = pattern
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        if step % 100 == 99:  # rounding errors don't add up
            inverse = np.linalg.inv(np.array(columns, float).T)
            x = inverse @ demand
        x = np.maximum(x, 0)
    return [(columns[i].astype(np.int64), float(x[i])) for i in range(k) if x[i] > 1e-9]


def plan(counts: dict[int, int], grid: int = GRID, length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: number} and how many sequences follow each; together they take all rests of each class."""
    room = length // grid
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(s)] for s in sizes], np.int64)
    out: list[tuple[dict[int, int], int]] = []
    if not len(sizes):
        return out
    for pattern, times in column_generation(sizes, left.astype(float), room):
        use = pattern > 0
        n = min(int(times + 1e-6), int((left[use] // pattern[use]).min()))
        if n:
            out.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(use)}, n))
            left -= n * pattern
    bins: list[tuple[int, dict[int, int]]] = []  # what rounding left over, longest first
    for s, n in sorted(zip(sizes.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            for b, (free, own) in enumerate(bins):
                if free >= s:
                    own[s] = own.get(s, 0) + 1
                    bins[b] = (free - s, own)
                    break
            else:
                bins.append((room - s, {s: 1}))
    return out + [(own, 1) for _, own in bins]


def pack(piece_table: DataFrame, length: int = LENGTH, grid: int = GRID) -> DataFrame:
    """Adds sequence_id and offset to the table of pieces."""
    own = piece_table.columns
    df = piece_table.withColumn("__class", F.when(F.col("length") < length, F.ceil(F.col("length") / grid).cast("int")).otherwise(F.lit(0)))
    counts = {int(k): int(n) for k, n in df.groupBy("__class").count().collect()}  # length / grid rows at most
    salts = max(1, -(-sum(counts.values()) // SALT_ROWS))
    # equal rows may be exchanged, so that a hash of the row spreads a class evenly
    df = df.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    whole = counts.pop(0, 0)
    table: dict[int, list[tuple[int, int, int, int]]] = {0: [(0, 1, 0, 0)]}  # class: (first rank, a sequence's number of them, first sequence, first place)
    first, taken = whole, dict.fromkeys(counts, 0)
    for pattern, n in plan(counts, grid, length):
        place = 0
        for c, k in sorted(pattern.items(), reverse=True):
            table.setdefault(c, []).append((taken[c], k, first, place))
            taken[c] += n * k
            place += k
        first += n
    if taken != counts:
        raise AssertionError("the plan doesn't take each rest once")
    by_salt = df.groupBy("__class", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__class").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    by_salt = cut(by_salt.withColumn("__before", F.coalesce(before, F.lit(0))).withColumnsRenamed({"__class": "__c", "__salt": "__s"}).drop("__n"), "ranks")
    ranked = df.withColumn("__in", F.row_number().over(W.partitionBy("__class", "__salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    ranked = ranked.join(by_salt, (F.col("__class") == F.col("__c")) & (F.col("__salt") == F.col("__s"))).withColumn("__rank", F.col("__before") + F.col("__in") - 1)
    arrays = {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in table.items()}
    fields = ", ".join(f"`{n}` {k}" for n, k in piece_table.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (len(own), len(own) + 1))
            seq, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(cls).tolist():
                at = np.flatnonzero(cls == c)
                start, each, base, slot = arrays[c]
                row = np.searchsorted(start, rank[at], side="right") - 1
                inside = rank[at] - start[row]
                seq[at] = base[row] + inside // each[row]
                place[at] = slot[row] + inside % each[row]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(own))), pa.array(seq), pa.array(place)], names=[*own, "sequence_id", "__place"])

    placed = ranked.select(*own, "__class", "__rank").mapInArrow(assign, f"{fields}, sequence_id bigint, __place bigint")
    laid = F.sum("length").over(W.partitionBy("sequence_id").orderBy("__place").rowsBetween(W.unboundedPreceding, -1))  # a sequence has length / grid places at most
    return placed.withColumn("offset", F.coalesce(laid, F.lit(0)).cast("long")).drop("__place")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, path, length, with_ids), "pieces"), length, grid)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_cutting_stock": query}
ORACLES: dict = {}
