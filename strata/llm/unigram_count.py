"""Operator 3: token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's matches by their ends, longest first. Dynamic programming
carries, for each place of a unit, only the best score of the text before it and the number of pieces of the
path that has it: no links back, no pieces. The rules are those of the ``tokenizers`` library's Unigram model
with byte fallback and a metaspace split: a path replaces another only if its score is strictly higher, and
candidates are tried from the earliest start, so that of equal scores the longest last piece stays; a
character without a piece of its own scores 10 below the lowest score of the vocabulary and counts as its
UTF-8 bytes. Scores are added from left to right in double precision.

The vocabulary is a parameter: (piece, score) by id. The query takes the pieces and scores of
``piece_bpe_32k.model``; no tokenizer is trained. Units (split before each metaspace) are counted once and
kept in a bounded dict.

Defined results: null and empty texts have no tokens and score 0; repeated rows and ids are counted one by
one; a very long text is read unit by unit, and of ties in score the longest last piece stays; only doc_id and text
are read, so other columns can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .piece_bpe import SPACE, read_pieces
from .texts import hold, map_texts

CACHE_UNITS, CACHE_CHARS = 500_000, 48
_LOADED: dict[str, UnigramCounter] = {}


class UnigramCounter:
    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for piece, score in vocab:
            auto.add_word(piece, (len(piece), score))
        auto.make_automaton()
        self.auto = auto
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - 10.0
        self.broken_by_lines = not any("\n" in p for p, _ in vocab)
        self.units: dict[str, tuple[int, float]] = {}

    def _search(self, unit: str) -> tuple[int, float]:
        n = len(unit)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done, single, unknown = 0, self.single, self.unknown

        def alone(at: int) -> None:
            """The step over the character before ``at``, if that has no piece: the last candidate for its end."""
            c = unit[at - 1]
            if c not in single:
                score = best[at - 1] + unknown
                if best[at] is None or score > best[at]:
                    best[at], count[at] = score, count[at - 1] + len(c.encode("utf-8", "replace"))

        for e, (size, score) in self.auto.iter(unit):
            e += 1
            while done < e - 1:
                done += 1
                alone(done)
            s = e - size
            score += best[s]
            old = best[e]
            if old is None or score > old:
                best[e], count[e] = score, count[s] + 1
        while done < n:
            done += 1
            alone(done)
        return count[n], best[n]

    def _make(self, unit: str) -> tuple[int, float]:
        if self.broken_by_lines and "\n" in unit:
            n, total = 0, 0.0
            for k, x in enumerate(unit.split("\n")):
                if k:
                    n, total = n + 1, total + self.unknown
                if x:
                    a, b = self.units.get(x) or self._make(x)
                    n, total = n + a, total + b
            return n, total
        got = self._search(unit)
        if len(unit) <= CACHE_CHARS:
            if len(self.units) >= CACHE_UNITS:
                self.units.clear()
            self.units[unit] = got
        return got

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        whole = text.replace(" ", SPACE)
        parts = whole.split(SPACE)
        if parts[0] == "":  # the text begins with a space: none is put before it
            parts = parts[1:]
        get, make = self.units.get, self._make
        n, total = 0, 0.0
        for p in parts:
            p = SPACE + p
            a, b = get(p) or make(p)
            n += a
            total += b
        return n, total


def load(path: str) -> UnigramCounter:
    hold("unigrams", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter([(p, s) for p, s, _ in read_pieces(path)])
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of every row."""
    def make() -> Callable:
        counter = load(path)
        return lambda texts: list(zip(*[counter.count(t or "") for t in texts], strict=True))

    return map_texts(docs, [("n_tokens", "bigint", pa.int64()), ("score", "double", pa.float64())], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op3_unigram_counts": query}
ORACLES: dict = {}
