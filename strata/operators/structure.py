"""From texts to trees: document types, section headers, sections, chunks and nodes.

Sections and chunks are made from each document's row alone, in one Arrow pass without an exchange; trees are windows
over a document's chunks, without their texts. Callers stage the typed documents and chunks that they read twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..functions.packing import pieces

SAMPLE = 20_000


@dataclass(frozen=True)
class ChunkConfig:
    max_chunk_tokens: int = 2000
    overlap_tokens: int = 100
    chars_per_token: float = 3.5
    respect_sections: bool = True
    respect_paragraphs: bool = True

    @property
    def max_chars(self) -> int:
        return int(self.max_chunk_tokens * self.chars_per_token)

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap_tokens * self.chars_per_token)


def has(text: Column, pattern: str, flags: str = "id") -> Column:
    return text.rlike(f"(?{flags}){pattern}")


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(Column.__add__, [has(text, p).cast("int") for p in patterns])


# ---- types ----------------------------------------------------------------------------------------------------

def doc_type(text: Column, name: Column | None = None) -> Column:
    """File name rules, then filing types by any pattern, then the others by two patterns; else generic."""
    sample = F.lower(F.substring(text, 1, SAMPLE))
    out = F.lit("generic")
    for kind, ps in reversed(P.OTHER_TYPES.items()):
        out = F.when(hits(sample, ps) >= 2, kind).otherwise(out)
    for kind, ps in reversed(P.SEC_TYPES.items()):
        out = F.when(has(sample, "(?:" + "|".join(ps) + ")"), kind).otherwise(out)
    if name is not None:
        low = F.lower(name)
        for parts, kind in reversed(P.NAME_RULES):
            out = F.when(reduce(Column.__and__, [F.coalesce(F.contains(low, F.lit(x)), F.lit(False)) for x in parts]), kind).otherwise(out)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "generic").otherwise(out)


def scored_type(docs: DataFrame) -> DataFrame:
    """(doc_no, doc_type, confidence): the type of most matches, the first of equals."""
    kinds = {**P.SEC_TYPES, **P.OTHER_TYPES}
    sample = F.lower(F.substring("text", 1, SAMPLE))
    df = docs.select("doc_no", "text", *[F.least(F.lit(1.0), hits(sample, ps) / F.lit(float(P.FULL_AT[k]))).alias(f"s{i}") for i, (k, ps) in enumerate(kinds.items())])
    df = df.withColumn("best", F.greatest(*[F.col(f"s{i}") for i in range(len(kinds))]))
    kind = reduce(lambda out, ik: F.when(F.col(f"s{ik[0]}") == F.col("best"), ik[1]).otherwise(out), reversed(list(enumerate(kinds))), F.lit(None).cast("string"))
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return df.select("doc_no", F.when(empty | (F.col("best") == 0), "generic").otherwise(kind).alias("doc_type"), F.when(empty, 0.0).when(F.col("best") == 0, 0.5).otherwise(F.col("best")).alias("confidence"))


def typed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_type", doc_type(F.col("text")))


# ---- sections -------------------------------------------------------------------------------------------------

_FLAGS = re.IGNORECASE | re.ASCII  # classes and cases as in the engine's own expressions
_SPACE, _BLANK = " \t\n\r\f\v", re.compile(r"[ \t\n\r\f\v]*")
_CANDIDATE = re.compile(P.MAYBE_HEADER + "[^\n]*", _FLAGS | re.MULTILINE)


@lru_cache(maxsize=64)
def _levels(doc_type: str) -> list[tuple[re.Pattern, int]]:
    return [(re.compile(p, _FLAGS), level) for p, level in P.headers_of(doc_type)]


def split_sections(text: str, doc_type: str) -> list[tuple[int, int, str | None, int]]:
    """(start, stop, title, level): header to header, and the untitled text before the first. A header is a line that
    matches a pattern of its type's list; the first pattern gives its level."""
    found = []
    for m in _CANDIDATE.finditer(text):
        level = next((n for p, n in _levels(doc_type) if p.search(m[0])), None)
        if level is not None:
            found.append((m.start(), m[0].strip(_SPACE), level))
    if not found or found[0][0] > 0:
        found.insert(0, (0, None, 0))
    return [(a, b, title, level) for (a, title, level), b in zip(found, [*(x[0] for x in found[1:]), len(text)], strict=True)]


def _by_document(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], make: Callable) -> DataFrame:
    """doc_no and ``fields`` of the rows that ``make(text, doc_type)`` gives for each document, about a million characters at a time."""
    source = docs.select("doc_no", "doc_type", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(source.dtypes)["doc_no"]
    names, types = [n for n, _, _ in fields], [t for _, _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, size = [], [], 0
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                new = make(text, b.column(1)[i].as_py())
                at += [i] * len(new)
                rows += new
                size += len(text)
                if rows and (size > 1_000_000 or i == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_no", *names])
                    at, rows, size = [], [], 0

    return source.mapInArrow(run, ", ".join([f"doc_no {kind}", *(f"{n} {k}" for n, k, _ in fields)]))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_no, start, stop, title, level); docs: doc_no, doc_type, text."""
    return _by_document(docs, [("start", "bigint", pa.int64()), ("stop", "bigint", pa.int64()), ("title", "string", pa.string()), ("level", "int", pa.int32())], split_sections)


def headers(docs: DataFrame) -> DataFrame:
    """(doc_no, start, title, level) of the header lines."""
    return sections(docs).filter("title is not null").select("doc_no", "start", "title", "level")


# ---- chunks ---------------------------------------------------------------------------------------------------

def chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_no, chunk_index, start_char, end_char, section_title, section_level, text): sections up to the size are chunks
    as they are, longer ones are split; blank ones are left out."""
    size, overlap, paragraphs, titled = config.max_chars, config.overlap_chars, config.respect_paragraphs, config.respect_sections

    def make(text: str, doc_type: str) -> list[tuple]:
        out = []
        for start, stop, title, level in split_sections(text, doc_type) if titled else [(0, len(text), None, 0)]:
            own = text[start:stop]
            if not _BLANK.fullmatch(own):
                for at, part in pieces(own, size, overlap, paragraphs) if len(own) > size else [(0, own)]:
                    out.append((len(out), start + at, start + at + len(part), title, level, part))
        return out

    return _by_document(docs, [("chunk_index", "int", pa.int32()), ("start_char", "bigint", pa.int64()), ("end_char", "bigint", pa.int64()),
                               ("section_title", "string", pa.string()), ("section_level", "int", pa.int32()), ("text", "string", pa.string())], make)


# ---- trees ----------------------------------------------------------------------------------------------------

def _spans(islands: DataFrame) -> DataFrame:
    """A row for each run of an island number: its first title and level, its chunks and characters."""
    return islands.groupBy("doc_no", "island", "n_chunks").agg(
        F.min_by("title", "chunk_index").alias("title"), F.min_by("section_level", "chunk_index").alias("level"),
        F.min("chunk_index").alias("start_chunk"), F.max("chunk_index").alias("last"), F.min_by("start_char", "chunk_index").alias("start_char"), F.max_by("end_char", "chunk_index").alias("end_char"))


def tree_from_chunks(chunk_table: DataFrame) -> DataFrame:
    """(doc_no, node_id, ord, parent_id, title, level, start_char, end_char, start_chunk, end_chunk).

    A new title begins a node; untitled chunks go on with it, leading ones are an introduction at level 0. A node's
    parent is the nearest one before it of a smaller level, whose span grows to the ends of its own children.
    """
    slim = chunk_table.select("doc_no", "chunk_index", "start_char", "end_char", "section_title", "section_level")
    w = W.partitionBy("doc_no").orderBy("chunk_index")
    named = slim.withColumn("seen", F.last("section_title", True).over(w)).withColumn("title", F.coalesce("seen", F.lit("Introduction")))
    new = named.withColumn("new", (~F.col("title").eqNullSafe(F.lag("title").over(w))).cast("int")).withColumn("section_level", F.when(F.col("seen").isNull(), 0).otherwise(F.col("section_level")))
    runs = _spans(new.withColumn("island", F.sum("new").over(w)).withColumn("n_chunks", F.lit(0)))
    v = W.partitionBy("doc_no").orderBy("island")
    nodes = runs.select("doc_no", (F.col("island") - 1).cast("int").alias("ord"), "title", "level", "start_char", "end_char", "start_chunk", (F.col("last") + 1).alias("end_chunk"))
    v = W.partitionBy("doc_no").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    for k in range(5):
        nodes = nodes.withColumn(f"p{k}", F.max(F.when(F.col("level") == k, F.col("ord"))).over(v))
    smaller = lambda k: F.when(F.col("level") > k, F.col(f"p{k}"))
    nodes = nodes.withColumn("parent", F.greatest(*[smaller(k) for k in range(5)])).drop(*[f"p{k}" for k in range(5)])
    grown = nodes.filter("parent is not null").groupBy("doc_no", F.col("parent").alias("ord")).agg(F.max("end_char").alias("ce"), F.max("end_chunk").alias("cc"))
    out = nodes.join(grown, ["doc_no", "ord"], "left")
    return out.select("doc_no", F.format_string("%04d", "ord").alias("node_id"), "ord", F.when(F.col("parent").isNotNull(), F.format_string("%04d", "parent")).alias("parent_id"), "title", "level", "start_char",
                      F.greatest("end_char", "ce").alias("end_char"), "start_chunk", F.greatest("end_chunk", "cc").alias("end_chunk"))


def tree_fallback(chunk_table: DataFrame) -> DataFrame:
    """All nodes at level 0: a node for each new title, leading untitled chunks left out; without titles one for the document."""
    slim = chunk_table.select("doc_no", "chunk_index", "start_char", "end_char", "section_title", "section_level")
    w = W.partitionBy("doc_no").orderBy("chunk_index")
    named = slim.withColumn("title", F.last("section_title", True).over(w)).withColumn("titles", F.count("section_title").over(W.partitionBy("doc_no")))
    named = named.withColumn("title", F.when(F.col("titles") == 0, F.lit("Document")).otherwise(F.col("title"))).filter("title is not null")
    new = named.withColumn("new", (~F.col("title").eqNullSafe(F.lag("title").over(w))).cast("int"))
    runs = _spans(new.withColumn("island", F.sum("new").over(w)).withColumn("n_chunks", F.lit(0)))
    return runs.select("doc_no", F.format_string("%04d", F.col("island") - 1).alias("node_id"), "title", F.lit(0).alias("level"), "start_char", "end_char", "start_chunk", (F.col("last") + 1).alias("end_chunk"))


def routes(chunk_table: DataFrame) -> DataFrame:
    """(doc_no, n_titles, titled_share, route): trees come from the chunks where there are three titles on a fifth of them."""
    a = chunk_table.groupBy("doc_no").agg(F.count_distinct("section_title").alias("n_titles"), F.avg(F.col("section_title").isNotNull().cast("double")).alias("titled_share"))
    return a.withColumn("route", F.when((F.col("n_titles") >= 3) & (F.col("titled_share") > 0.2), "chunks").otherwise("fallback"))


def tree_from_flat(flat: DataFrame, chunk_table: DataFrame) -> DataFrame:
    """Nodes of numbered rows (doc_no, structure, title, chunk_index, end_chunk_index): sorted by their dotted numbers,
    level by the dots, parent the row whose number is theirs without the last part."""
    n = chunk_table.groupBy("doc_no").agg(F.count(F.lit(1)).cast("int").alias("n"))
    f = flat.join(n, "doc_no").withColumn("a", F.greatest(F.lit(0), F.least("chunk_index", F.col("n") - 1)))
    f = f.withColumn("b", F.greatest(F.col("a") + 1, F.least("end_chunk_index", "n")))
    part = F.transform(F.split("structure", r"\."), lambda x: F.coalesce(x.try_cast("int"), F.when(x.rlike("^[A-Za-z]+$"), roman_value(x)).otherwise(F.lit(0))))
    f = f.withColumn("key", part).withColumn("ord", F.row_number().over(W.partitionBy("doc_no").orderBy("key", "structure")) - 1)
    up = F.when(F.contains("structure", F.lit(".")), F.regexp_replace("structure", r"\.[^.]*$", ""))
    parents = f.select(F.col("doc_no").alias("d"), F.col("structure").alias("up"), F.col("ord").alias("po"))
    f = f.withColumn("wanted", up).join(parents, (F.col("doc_no") == F.col("d")) & (F.col("wanted") == F.col("up")) & (F.col("po") < F.col("ord")), "left")
    c = chunk_table.select(F.col("doc_no").alias("cd"), F.col("chunk_index").alias("ci"), "start_char", "end_char")
    starts, ends = c.select("cd", "ci", "start_char"), c.select(F.col("cd").alias("ed"), F.col("ci").alias("ei"), "end_char")
    f = f.join(starts, (F.col("doc_no") == F.col("cd")) & (F.col("a") == F.col("ci"))).join(ends, (F.col("doc_no") == F.col("ed")) & (F.col("b") - 1 == F.col("ei")))
    return f.select("doc_no", F.format_string("%04d", "ord").alias("node_id"), F.when(F.col("po").isNotNull(), F.format_string("%04d", "po")).alias("parent_id"), "title", (F.size(F.split("structure", r"\.")) - 1).alias("level"), "start_char", "end_char", F.col("a").alias("start_chunk"), F.col("b").alias("end_chunk"))


def roman_value(c: Column) -> Column:
    """Value of a numeral, read from its end; characters that are none count 0."""
    values = F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    digits = F.transform(F.reverse(F.split(F.upper(F.btrim(c)), "")), lambda x: F.coalesce(F.try_element_at(values, x), F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, d: F.struct((s["sum"] + F.when(d < s["last"], -d).otherwise(d)).alias("sum"), d.alias("last"))
    return F.aggregate(digits, start, step, lambda s: s["sum"])


def depths(nodes: DataFrame) -> DataFrame:
    """Adds depth (0: root) and path (ids from the root), whatever the depth; one pass over each document's nodes."""
    keyed = nodes.select("doc_no", "node_id", "parent_id")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {n: p for n, p in zip(pdf.node_id, pdf.parent_id, strict=True)}
        paths: dict[str, list[str]] = {}
        for n in up:
            chain = []
            while n is not None and n in up and n not in paths:
                chain.append(n)
                n = up[n]
            for x in reversed(chain):
                paths[x] = [*paths.get(up[x], []), x]
        return pd.DataFrame({"doc_no": pdf.doc_no, "node_id": pdf.node_id, "depth": [len(paths[n]) - 1 for n in pdf.node_id], "path": [paths[n] for n in pdf.node_id]})

    kind = dict(nodes.dtypes)["doc_no"]
    told = keyed.groupBy("doc_no").applyInPandas(walk, f"doc_no {kind}, node_id string, depth int, path array<string>")
    return nodes.join(told, ["doc_no", "node_id"])
