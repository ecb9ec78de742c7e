"""Arrow mapping over whole texts, and the split of a text into units that tokenizers treat alone."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text that are handled together, whatever number of rows Arrow hands over.
BLOCK_CHARS = 1_000_000


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """A worker process keeps the tables of one operator at a time: those that others left go, back to the system where it
    can take them. ``release`` drops one's own."""
    left = [x for x in _HELD if x != owner]
    for name in left:
        _HELD.pop(name)()
    if left:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _HELD[owner] = release


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about BLOCK_CHARS characters (a longer text is a run of its own)."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > BLOCK_CHARS:
            yield start, i
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, columns: list[tuple[str, str, pa.DataType]], make: Callable, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and new ones of every row: ``make()`` runs once in each task and gives a function
    from a list of texts (None: null) to the list of the new columns' values, row by row."""
    source = df.select(*keep) if text in keep else df.select(*keep, text)
    place = source.columns.index(text)
    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {k}" for n, k, _ in columns)])
    names, types = [n for n, _, _ in columns], [t for _, _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in blocks(texts):
                got = work(texts[a:b])
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip(got, types, strict=True))], names=[*keep, *names])

    return source.mapInArrow(run, schema)
