"""Scalar functions on texts, numbers and dates, as column expressions."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import TEXT_DATES

MIDDLE = "\n...[truncated]...\n"


def hash_id(text: Column, prefix: str = "") -> Column:
    short = F.substring(F.sha2(text, 256), 1, 12)
    return F.concat(F.lit(prefix + "_"), short) if prefix else short


def truncate(text: Column, size: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - len(suffix)), F.lit(suffix)))


def truncate_middle(text: Column, size: int) -> Column:
    keep = (size - 20) // 2
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, keep), F.lit(MIDDLE), F.right(text, F.lit(keep))))


def truncate_reading(text: Column, most: int = 10_000) -> Column:
    """What is read of a section: one longer than ``most`` by its two halves of that."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(MIDDLE), F.right(text, F.lit(half))))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sample(text: Column, most: int = 6000) -> Column:
    """Head and tail of a longer text, cut at ends of sentences where there are some within 200 characters."""
    half = (most - 30) // 2
    wide = F.substring(text, 1, half + 200)
    # place of the last end of a sentence, from the front (0: none)
    ends = F.greatest(*[F.when(F.instr(F.reverse(wide), f" {m}") > 0, F.length(wide) - F.instr(F.reverse(wide), f" {m}")).otherwise(0) for m in ".?!"])
    head = F.when(ends - 1 > half // 2, F.substring(wide, F.lit(1), ends)).otherwise(F.substring(text, 1, half))
    late = F.substring(text, F.greatest(F.length(text) - half - 200, F.lit(0)) + 1, F.length(text))
    stop = F.instr(late, ". ") - 1
    tail = F.when((stop > 0) & (stop < 400), F.substring(late, stop + 3, F.length(late))).otherwise(F.right(text, F.lit(half)))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(_stripped(head), F.lit("\n\n...[content truncated]...\n\n"), _stripped(tail)))


def clean(text: Column) -> Column:
    """Line ends as line feeds, three or more of them as two, blanks in lines as one space, ends stripped."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(F.regexp_replace(t, "\n{3,}", "\n\n"), "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \\t\\x0B\\f]+", " ")))
    return F.btrim(F.array_join(lines, "\n"), F.lit(" \n"))


def sentences(text: Column, most: int = 5) -> Column:
    return F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, most)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def count_tokens(text: Column, count=None) -> Column:
    """Tokens by a function from texts to numbers (a tokenizer's), run on the executors; without one the estimate."""
    if count is None:
        return estimate_tokens(text)
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else count(t)), T.LongType())(text)


def parse_date(text: Column, formats=TEXT_DATES) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.btrim(text), F.lit(f)) for f in formats])


def int_to_roman(n: Column) -> Column:
    """1 to 3999 as a numeral, others as decimals."""
    units = [F.array(*[F.lit(x) for x in row]) for row in (
        ["", "M", "MM", "MMM"],
        ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
        ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
        ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
    )]
    digit = [F.floor(n / p) % (10 if p < 1000 else 4) for p in (1000, 100, 10, 1)]
    return F.when((n < 1) | (n > 3999), n.cast("string")).otherwise(F.concat(*[F.element_at(u, d.cast("int") + 1) for u, d in zip(units, digit, strict=True)]))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def highlight(text: Column, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Each term's occurrences, whatever their case, replaced by the term between marks; one term after the other."""
    safe = lambda s: re.sub(r"([\\$])", r"\\\1", s)
    return reduce(lambda t, x: F.regexp_replace(t, f"(?iu)\\Q{x}\\E", safe(before + x + after)), terms, text)


@F.pandas_udf(T.StringType())
def format_number(x: pd.Series) -> pd.Series:
    """Two decimals with a suffix of thousands: binary rounding, which no built-in function has."""
    def one(v: float) -> str | None:
        if v is None or v != v:
            return None
        for limit, sign in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(v) >= limit:
                return f"{v / limit:.2f}{sign}"
        return f"{v:.2f}"

    return x.map(one)


def repaired_json(text: str | None) -> str:
    """JSON out of a model's answer: a fenced block, stray commas, words of Python; else the widest object, then the widest list; else {}."""
    if not text:
        return "{}"
    block = re.search(r"```(?:json)?\s*([\s\S]*?)```", text)
    body = (block[1] if block else text).strip()
    body = re.sub(r",\s*([}\]])", r"\1", body)
    for python, js in (("None", "null"), ("True", "true"), ("False", "false")):
        body = body.replace(python, js)
    tries = [body] + [body[body.find(a):body.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= body.find(a) < body.rfind(b)]
    for t in tries:
        try:
            return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        except json.JSONDecodeError:
            continue
    return "{}"


@F.pandas_udf(T.StringType())
def two_places(x: pd.Series) -> pd.Series:
    """A number with two decimals, rounded as its binary value is."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.2f}")


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repaired_json)


def cache_key(family: str, *parts: Column) -> Column:
    """index:{doc}, llm:{model}:{hash of the prompt}, search:{doc}:{hash of the query}."""
    return F.concat_ws(":", F.lit(family), *parts)


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
