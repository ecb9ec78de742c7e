"""Operator 9: SentencePiece BPE encoding and decoding by a table of each prefix's last token.

Byte-pair encoding has, for each prefix of a text, one encoding, and so one last token. The table is
filled from left to right: an automaton lists all pieces that end at a place, longest first, and the one
that is compatible with the last token of the prefix before it is the prefix's last token. Two tokens are
compatible if, with their merges taken back step by step in the order opposite to the one they were made
in, no merge across their border would have come first. Then ids are read backwards. The time is linear in
the text, whatever its words' lengths.

Characters outside the vocabulary stand alone and fall back to their UTF-8 bytes. Runs of spaces are cut
apart beforehand: those pieces all have one score, lower than all others', so the leftmost grow first, to
the longest there is. Units (a space and what follows it) are encoded once and kept in a bounded dict.

Defined results: a null text is encoded like the empty one, to the end id alone; repeated rows and ids are
encoded one by one; a very long text is encoded whole, unit by unit, and ties between merges go to the left one, as in
the library; only doc_id and text are read, so other columns can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .texts import hold, map_texts

SPACE = "▁"
#: Units kept by a worker, and the longest that is kept.
CACHE_UNITS, CACHE_CHARS = 500_000, 48
#: Pairs of tokens whose compatibility a worker keeps.
FIT_PAIRS = 2_000_000
_LOADED: dict[str, PieceBpe] = {}


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; types: 1 normal, 2 unknown, 3 control, 6 byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 6 if sp.is_byte(i) else 1
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class PieceBpe:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.end = next(i for i, (p, _, k) in enumerate(pieces) if k == 3 and p == "</s>")
        order = sorted({s for _, s, k in pieces if k == 1}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = [place[s] if k == 1 else -1 for _, s, k in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == 1}
        runs = {len(p): i for p, i in self.ids.items() if len(p) > 1 and set(p) == {SPACE}}
        self.space, self.runs, self.longest_run = self.ids[SPACE], runs | {1: self.ids[SPACE]}, max([1, *runs])
        self.parts: dict[int, tuple[int, int]] = {}
        auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1 and i not in runs.values():
                tree = self.merge_tree(p)
                if tree is None:
                    continue  # no text is encoded to this piece
                self.parts[i] = tree
            if i not in runs.values():
                auto.add_word(p, (i, len(p)))
        auto.make_automaton()
        self.auto = auto
        self.fits: dict[int, bool] = {}
        self.units: dict[str, tuple[str, int, str]] = {}
        self.names = [f" {i}" for i in range(len(pieces))]
        self.decoded = {i: p.replace(SPACE, " ") for i, (p, _, k) in enumerate(pieces) if k == 1}

    def merge_tree(self, p: str) -> tuple[int, int] | None:
        """The two tokens that the last merge of this piece's own encoding joins; None if that isn't the piece."""
        got = self.merged([*p])
        if len(got) != 1:
            return None
        return self._last

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair encoding, best score first and leftmost of equals: for short strings, and as the check of tests."""
        ids, rank = self.ids, self.rank
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or rank[i] < best):
                    best, at = rank[i], k
            if best is None:
                return symbols
            self._last = (ids.get(symbols[at], -1), ids.get(symbols[at + 1], -1))
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2:]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when the text of both is encoded."""
        ids, text, rank, parts = self.ids, self.text, self.rank, self.parts
        undo_a = undo_b = 1 << 60  # when the token left, right of the border went on to be merged
        while True:
            i = ids.get(text[a] + text[b])
            if i is not None and rank[i] < undo_a and rank[i] <= undo_b:
                return False  # on equal ranks the left merge comes first
            ra = rank[a] if a in parts else -1
            rb = rank[b] if b in parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb or (ra == rb and b not in parts):
                undo_a, a = ra, parts[a][1]
            else:
                undo_b, b = rb, parts[b][0]

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a string without runs of spaces."""
        n = len(unit)
        last = [-1] * (n + 1)  # the last token of each prefix; -1: a character outside the vocabulary
        first = [0] * (n + 1)  # where that token begins
        fits, test, full = self.fits, self.compatible, -1
        for e, (i, size) in self.auto.iter(unit):
            if e == full:
                continue  # this prefix's last token is known
            s = e + 1 - size
            before = last[s]
            if before >= 0:
                key = before << 20 | i
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > FIT_PAIRS:
                        fits.clear()
                    ok = fits[key] = test(before, i)
                if not ok:
                    continue
            full = e
            last[e + 1] = i
            first[e + 1] = s
        out: list[int] = []
        e = n
        while e:
            i = last[e]
            if i >= 0:
                out.append(i)
                e = first[e]
            else:
                e -= 1
                out.extend([self.byte[x] for x in reversed(unit[e].encode("utf-8", "replace"))])
        out.reverse()
        return out

    def spaces(self, n: int) -> list[int]:
        """A run of spaces: the leftmost grow to the longest piece there is."""
        out = [self.runs[self.longest_run]] * (n // self.longest_run)
        n %= self.longest_run
        while n:
            k = max(x for x in self.runs if x <= n)
            out.append(self.runs[k])
            n -= k
        return out

    def _lines(self, unit: str) -> list[int]:
        """A line end is outside the vocabulary, so that lines are encoded apart."""
        if "\n" in self.ids or "\n" not in unit:
            return self.encode_unit(unit)
        out: list[int] = []
        for k, x in enumerate(unit.split("\n")):
            if k:
                out.append(self.byte[10])
            if x:
                out.extend(map(int, (self.units.get(x) or self.unit(x))[0].split()))
        return out

    def _told(self, ids: list[int]) -> tuple[str, int, str]:
        """(ids as text with a space before each, their number, decoded text)."""
        names, texts = self.names, self.decoded
        try:
            text = "".join([texts[i] for i in ids])
        except KeyError:  # bytes
            text = self.decode(ids, first=False)
        return "".join([names[i] for i in ids]), len(ids), text

    def unit(self, x: str) -> tuple[str, int, str]:
        got = self.units.get(x)
        if got is None:
            got = self._told(self._lines(x))
            if len(x) <= CACHE_CHARS and "\n" not in x:
                if len(self.units) >= CACHE_UNITS:
                    self.units.clear()
                self.units[x] = got
        return got

    def _units(self, text: str) -> list[tuple[str, int, str]]:
        """The units of a whole text; a run of spaces is told with the unit after it."""
        if not text:
            return []
        parts = text.replace(" ", SPACE).split(SPACE)
        get, make = self.units.get, self.unit
        if "" not in parts:
            return [get(u) or make(u) for u in [SPACE + p for p in parts]]
        out, run = [], 0
        for p in parts:
            run += 1
            if p:
                one = make(SPACE + p)
                if run > 1:
                    ids = [*map(int, one[0].split())]
                    alone = ids[0] == self.space  # nothing is merged with the last space of the run
                    one = self._told(self.spaces(run) + ids[1:] if alone else self.spaces(run - 1) + ids)
                out.append(one)
                run = 0
        if run:
            out.append(self._told(self.spaces(run)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for u in self._units(text) for i in u[0].split()]

    def decode(self, ids, first: bool = True) -> str:
        """Text of ids: control ids give nothing, byte pieces are put together, the space put before a text goes."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            k = self.kind[i]
            if k == 6:
                raw.append(int(self.text[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if k == 1:
                out.append(self.text[i].replace(SPACE, " "))
            elif k == 2:
                out.append(" ⁇ ")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if first and text.startswith(" ") else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, sha256 of their decimals, sha256 of the decoded text."""
        units = self._units(text)
        ids = "".join([u[0] for u in units]) + f" {self.end}"
        decoded = "".join([u[2] for u in units])
        decoded = decoded[1:] if decoded.startswith(" ") else decoded
        return sum([n for _, n, _ in units]) + 1, hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def load(path: str) -> PieceBpe:
    """One table for each model file and worker process; it outlives tasks."""
    hold("pieces", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(read_pieces(path))
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) with the end id."""
    def make() -> Callable:
        bpe = load(path)
        return lambda texts: [[[*bpe.encode(t or ""), bpe.end] for t in texts]]

    return map_texts(docs, [("ids", "array<int>", pa.list_(pa.int32()))], make)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    def make() -> Callable:
        bpe = load(path)
        return lambda texts: list(zip(*[bpe.digests(t or "") for t in texts], strict=True))

    return map_texts(docs, [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op9_piece_bpe": query}
ORACLES: dict = {}
