"""Cutting of long sections: paragraphs are put together up to a size, with an overlap, and what is much too long is cut at sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

_GAP, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")
#: Where an overlap may begin: marks, how far after the wanted place they are looked for, how far before it they may be.
_BREAKS = ((("\n\n",), 100, 200), ((". ", "! ", "? "), 50, 100), (("\n",), 50, 100), ((" ",), 20, 50))


def break_point(text: str, want: int) -> int:
    """The best place near ``want`` for a piece to begin."""
    for marks, after, before in _BREAKS:
        at = max(text.rfind(m, 0, want + after) for m in marks)
        if at > want - before:
            return at + len(marks[0])
    return want


def _located(text: str, parts: list[str]) -> Iterator[tuple[int, str]]:
    """Parts with their places, each looked for after the one before."""
    cursor = 0
    for part in parts:
        at = text.find(part, cursor)
        at = cursor if at < 0 else at
        yield at, part
        cursor = at + len(part)


def _paragraph_pieces(text: str, size: int, overlap: int, paragraphs: bool) -> Iterator[tuple[int, str]]:
    parts = [p.strip() for p in (_GAP.split(text) if paragraphs else [text])]
    held, begin = "", 0
    for at, part in _located(text, [p for p in parts if p]):
        if not held:
            held, begin = part, at
        elif len(held) + 2 + len(part) <= size:
            held = f"{held}\n\n{part}"
        else:
            yield begin, held
            if 0 < overlap < len(held):
                back = break_point(held, len(held) - overlap)
                held, begin = f"{held[back:]}\n\n{part}", begin + back
            else:
                held, begin = part, at
    if held:
        yield begin, held


def _sentence_pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    held, begin = "", 0
    for at, part in _located(text, _SENTENCE.split(text)):
        if held and len(held) + len(part) > size:  # the space between isn't counted
            yield begin, held
            held = ""
        held, begin = (f"{held} {part}", begin) if held else (part, at)
    if held:
        yield begin, held


def pieces(text: str, size: int, overlap: int, paragraphs: bool = True) -> list[tuple[int, str]]:
    """(place, text) of the chunks of a section longer than ``size``."""
    out: list[tuple[int, str]] = []
    for begin, piece in _paragraph_pieces(text, size, overlap, paragraphs):
        if len(piece) > size * 1.5:
            out.extend((begin + at, part) for at, part in _sentence_pieces(piece, size))
        else:
            out.append((begin, piece))
    return out


def simple_pieces(text: str, size: int, overlap: int = 100) -> list[str]:
    """Slices of at most ``size`` characters that end at a break beyond their half, each beginning ``overlap`` before the last's end.

    An overlap that could stop all progress (a half of the size or more) raises ValueError.
    """
    if len(text) <= size:
        return [text]
    if overlap >= size // 2:
        raise ValueError("the overlap must be below half of the size")
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            marks = ("\n\n", "\n", ". ", " ")
            found = ((text.rfind(m, start, end), len(m)) for m in marks)
            end = next((at + n for at, n in found if at > start + size // 2), end)
        out.append(text[start:end])
        start = end - overlap
    return out
