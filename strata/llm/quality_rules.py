"""Operator 1: quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets integer features. Per language and source a log-linear histogram of each feature
(256 steps to each power of two, so a relative error below 1/256) is counted: a quantile sketch that
merges by adding counts, so the sketches of a language and of the corpus are sums of those of their
sources. A fence is the quartile, plus or minus ``reach`` times its distance from the median, plus what
``few`` occurrences make in a document as short as the shortest twentieth (the 5 % quantile of the words,
lines or characters that the feature is counted over): so a feature that most documents of a group lack
has a fence above nothing, and it is wide where documents are short. No fence holds a constant.
Fences come from the sketches of the document's language and source; from the language's where that has
fewer than ``least_rows`` rows, then from the corpus'. They are joined back and documents beyond go.

Defined results: a null or empty text has no words and fails the base rule; a null language or source
is a group of its own (null-safe join); repeated rows and ids are judged one by one; a value at its fence
is kept; very long texts are counted whole, in one row's arrays; only needed columns are read, and
``filter_documents`` renames the others while it works, so that no name clashes; an empty table gives no
rows. A document's windows are compared by 64-bit hashes of their words, within the document only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_SPLIT, cut, documents, fresh, text_or_empty

SYMBOLS = "#*$%&|<>"
UPPER = "[A-ZÀ-ÖØ-Þ]"
#: Feature (per thousand of what it is counted over): the count, what it is counted over, whether both sides are fenced,
#: how many occurrences come together (a repeated window has five words).
METRICS = {"symbols": ("n_symbols", "n_words", False, 1), "dup_lines": ("n_dup_lines", "n_lines", False, 1), "repeats": ("n_repeat_words", "n_words", False, 5),
           "word_length": ("word_chars", "n_words", True, 1), "upper": ("n_upper", "word_chars", False, 1)}
#: What features are counted over has sketches too.
SIZES = ("n_words", "n_lines", "word_chars")
#: Quantiles that fences are made of, in twentieths.
QUANTILES = {"q05": 1, "q25": 5, "q50": 10, "q75": 15}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


@dataclass(frozen=True)
class QualityParams:
    reach: int = 9
    few: int = 3
    least_rows: int = 100
    #: Up to so many groups the table of fences is broadcast; beyond, it is joined by a shuffle.
    broadcast_groups: int = 20_000


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds COUNTS (long); two steps, so that the words are made once for all of them."""
    t, words, lines, hs, n, m, bits, packed, at = (fresh(docs, x) for x in ("t", "words", "lines", "hs", "n", "m", "bits", "packed", "at"))
    own = docs.columns
    df = docs.withColumn(t, text_or_empty())
    df = df.withColumn(words, F.expr(f"filter(split(`{t}`, '{WORD_SPLIT}'), w -> w != '')".replace("\\", "\\\\")))
    df = df.withColumn(lines, F.expr(rf"filter(split(`{t}`, '\n'), x -> length(translate(x, ' \t\n\u000b\f\r', '')) > 0)"))
    df = df.withColumn(n, F.size(words)).withColumn(m, F.greatest(F.size(words) - 4, F.lit(0)))
    five = ", ".join(f"`{words}`[i + {k}]" for k in range(5))
    df = df.withColumn(hs, F.expr(f"if(`{m}` > 0, transform(sequence(0, `{m}` - 1), i -> xxhash64({five})), array())"))
    df = df.withColumn(bits, F.length(F.bin(F.col(m).cast("long"))))
    # hash above, place below: one sort of plain longs brings equal windows together
    df = df.withColumn(packed, F.expr(f"if(size(array_distinct(`{hs}`)) = `{m}`, cast(array() as array<bigint>), sort_array(transform(`{hs}`, (h, i) -> shiftleft(h, `{bits}`) | i)))"))
    place = lambda j: f"cast(`{packed}`[{j}] & (shiftleft(1L, `{bits}`) - 1) as int)"
    same = lambda a, b: f"(shiftright(`{packed}`[{a}], `{bits}`) = shiftright(`{packed}`[{b}], `{bits}`) and `{hs}`[{place(a)}] = `{hs}`[{place(b)}])"
    df = df.withColumn(at, F.expr(
        f"if(size(`{packed}`) = 0, cast(array() as array<int>), sort_array(transform(filter(sequence(0, size(`{packed}`) - 1), "
        f"j -> (j > 0 and {same('j - 1', 'j')}) or (j < `{m}` - 1 and {same('j', 'j + 1')})), j -> {place('j')})))"))
    size = f"size(`{at}`)"
    return df.select(
        *own,
        F.col(n).cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(f"if({size} = 0, 0L, 5L + aggregate(sequence(0, {size} - 1), 0L, (s, k) -> s + if(k + 1 < {size}, least(5, `{at}`[k + 1] - `{at}`[k]), 0)))").alias("n_repeat_words"),
        (F.length(t) - F.length(F.regexp_replace(t, UPPER, ""))).cast("long").alias("n_upper"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def _metrics() -> dict[str, Column]:
    return {k: F.expr(f"(1000 * {count}) div greatest({over}, 1)") for k, (count, over, _, _) in METRICS.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _bucket(v: str) -> str:
    step = f"greatest(length(bin({v})) - 9, 0)"
    return f"shiftleft(shiftright({v}, {step}), {step})"


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketches of documents that pass the base rule."""
    ms = _metrics() | {k: F.col(k) for k in SIZES}
    wide = counted.filter(~base_failed()).select("lang", "source", *[c.alias(k) for k, c in ms.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in ms)
    return wide.select("lang", "source", F.expr(f"stack({len(ms)}, {stack}) as (metric, v)")).withColumn("bucket", F.expr(_bucket("v"))).groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sk: DataFrame, by: list[str]) -> DataFrame:
    """The sketches merged to ``by``, then (by, metric, total, QUANTILES)."""
    merged = sk.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "metric")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    first = lambda q: F.min(F.when(20 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    return run.groupBy(*by, "metric").agg(F.max("total").alias("total"), *[first(n).alias(q) for q, n in QUANTILES.items()])


def _fence_columns(params: QualityParams) -> dict[str, str]:
    """lo_<metric>, hi_<metric> from the quantiles of a group's features and sizes, as SQL of aggregates by metric."""
    at = lambda q, k: f"max(CASE WHEN metric = '{k}' THEN {q} END)"
    out = {}
    for k, (_, over, both, together) in METRICS.items():
        slack = f"CAST(floor({1000 * params.few * together} / greatest({at('q05', over)}, 1)) AS BIGINT)"
        out[f"lo_{k}"] = f"{at('q25', k)} - {params.reach} * ({at('q50', k)} - {at('q25', k)}) - {slack}" if both else "CAST(NULL AS BIGINT)"
        out[f"hi_{k}"] = f"{at('q75', k)} + {params.reach} * ({at('q75', k)} - {at('q50', k)}) + {slack}"
    return out


def fences(counted: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row for each (lang, source): lo_<metric>, hi_<metric>."""
    sk = cut(sketches(counted), "sketches")  # as many rows as groups have steps, not documents

    def wide(by: list[str], tag: str) -> DataFrame:
        return _quantiles(sk, by).groupBy(*by).agg(F.max("total").alias(f"total{tag}"), *[F.expr(e).alias(f"{c}{tag}") for c, e in _fence_columns(params).items()])

    own, lang, whole = wide(["lang", "source"], "_own"), wide(["lang"], "_lang").withColumnRenamed("lang", "lang_"), wide([], "_all")
    groups = counted.select("lang", "source").distinct()  # groups without a passing document have fences too
    one = own.withColumnsRenamed({"lang": "l_", "source": "s_"})
    df = groups.join(one, F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")), "left")
    df = df.join(lang, F.col("lang").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    big = lambda tag: F.coalesce(F.col(f"total{tag}"), F.lit(0)) >= params.least_rows
    pick = lambda c: F.when(big("_own"), F.col(f"{c}_own")).when(big("_lang"), F.col(f"{c}_lang")).otherwise(F.col(f"{c}_all")).alias(c)
    return df.select("lang", "source", *[pick(c) for c in _fence_columns(params)])


def judge(counted: DataFrame, fence: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Adds base_failed and kept to a counted table, by a join with the fences."""
    names = {c: f"__f_{c}" for c in fence.columns}
    f = cut(fence.withColumnsRenamed(names), "fences")
    if f.count() <= params.broadcast_groups:
        f = F.broadcast(f)
    own = counted.columns
    ms = _metrics()
    df = counted.withColumns({f"__m_{k}": c for k, c in ms.items()})
    df = df.join(f, df["lang"].eqNullSafe(f["__f_lang"]) & df["source"].eqNullSafe(f["__f_source"]), "left")
    inside = F.lit(True)
    for name, (_, _, both, _) in METRICS.items():
        inside &= F.coalesce(F.col(f"__m_{name}") <= F.col(f"__f_hi_{name}"), F.lit(True))
        if both:
            inside &= F.coalesce(F.col(f"__m_{name}") >= F.col(f"__f_lo_{name}"), F.lit(True))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & inside).select(*own, "base_failed", "kept")


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    counted = cut(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "counts")
    return judge(counted, fences(counted, params), params).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The counts are written beside the rows, so that they
    are made once and the verdict reads them (else the optimizer would put them into the filter again and again)."""
    aside = {c: f"__col_{i}" for i, c in enumerate(docs.columns) if c not in ("lang", "source", "text")}
    counted = cut(with_counts(docs.toDF(*[aside.get(c, c) for c in docs.columns])), "counted")
    judged = judge(counted, fences(counted, params), params)
    return judged.filter("kept").select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def _oracle() -> str:
    ws = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    step = "greatest(length(bin(v)) - 9, 0)"
    p = QualityParams()
    value = lambda k: f"(1000 * {METRICS[k][0]}) // greatest({METRICS[k][1]}, 1)"
    unions = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {value(k) if k in METRICS else k} AS v FROM judged_base WHERE NOT base_failed" for k in (*METRICS, *SIZES))
    quantiles = ", ".join(f"min(CASE WHEN 20 * upto >= {n} * total THEN bucket END) AS {q}" for q, n in QUANTILES.items())
    columns = _fence_columns(p)

    def level(name: str, by: str) -> str:
        cols = f"{by}, " if by else ""
        fences = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        return (f"{name}_c AS (SELECT {cols}metric, bucket, CAST(sum(n) AS BIGINT) AS n FROM sk GROUP BY {cols}metric, bucket), "
                f"{name}_r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {cols}metric ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY {cols}metric) AS BIGINT) AS total FROM {name}_c), "
                f"{name}_q AS (SELECT {cols}metric, max(total) AS total, {quantiles} FROM {name}_r GROUP BY {cols}metric), "
                f"{name} AS (SELECT {cols}max(total) AS total, {fences} FROM {name}_q {f'GROUP BY {by}' if by else ''})")

    pick = lambda c: f"CASE WHEN coalesce(o.total, 0) >= {p.least_rows} THEN o.{c} WHEN coalesce(l.total, 0) >= {p.least_rows} THEN l.{c} ELSE a.{c} END"
    inside = " AND ".join(f"coalesce({value(k)} <= {pick('hi_' + k)}, true)" + (f" AND coalesce({value(k)} >= {pick('lo_' + k)}, true)" if both else "") for k, (_, _, both, _) in METRICS.items())
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {ws}, '')) > 0) AS ls FROM base),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS at FROM d, range(5) r(o)) GROUP BY rid),
counted AS (SELECT base.rid, doc_id, lang, source, len(ws) AS n_words, length(translate(t, {ws}, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '{UPPER}', '', 'g')) AS n_upper, len(ls) AS n_lines
  FROM base JOIN w USING (rid) LEFT JOIN rw ON rw.rid = base.rid),
judged_base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
sk AS (SELECT lang, source, metric, (v >> {step}) << {step} AS bucket, count(*) AS n FROM ({unions}) GROUP BY ALL),
{level("own", "lang, source")}, {level("lng", "lang")}, {level("al", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM judged_base j LEFT JOIN own o ON j.lang IS NOT DISTINCT FROM o.lang AND j.source IS NOT DISTINCT FROM o.source LEFT JOIN lng l ON j.lang IS NOT DISTINCT FROM l.lang CROSS JOIN al a"""


QUERIES = {"op1_quality_rules": query}
ORACLES = {"op1_quality_rules": _oracle()}
