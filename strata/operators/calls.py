"""Calls of a model as table operations: each prompt is asked once, its response is kept in a cache and joined back;
parts of a long input are asked one by one and their responses combined; results as JSON and back.

A model is a function from a list of prompts to a list of responses of the same length; it runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, short_hash
from ..sources.cache import TTL, ParquetCache
from ..sources.stage import staged
from ..streaming.incremental import ProgressReporter

Model = Callable[[list[str]], list[str]]
CITATION = "node_id string, node_title string, excerpt string, char_range array<bigint>"
QA_RESULT = f"question string, answer string, confidence double, citations array<struct<{CITATION.replace(' string', ': string').replace(' array', ': array')}>>, reasoning_trace array<string>, nodes_visited array<string>"


def asked(prompts: DataFrame, model: Model, batch: int = 20) -> DataFrame:
    """(key, prompt, response) of a table (key, prompt); a call has at most ``batch`` prompts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k:k + batch][["key", "prompt"]].copy()
                part["response"] = model(part["prompt"].tolist())
                yield part

    return prompts.select("key", "prompt").mapInPandas(run, "key string, prompt string, response string")


def memoised(rows: DataFrame, model: Model, cache: ParquetCache, name: str = "model", prompt: str = "prompt") -> DataFrame:
    """Adds response and cached to ``rows``: prompts with a live entry are looked up, each other one is asked once and put
    into the cache for an hour. A null prompt has no response."""
    keyed = rows.withColumn("key", F.when(F.col(prompt).isNotNull(), cache_key("llm", F.lit(name), short_hash(F.col(prompt)))))
    distinct = staged(keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(prompt).alias("prompt")), "prompts")
    known = staged(cache.get_many(distinct.select("key")), "known")
    new = staged(asked(distinct.join(known.filter("hit"), "key", "left_anti"), model), "responses")
    cache.set_many(new.select("key", F.col("response").alias("value")), TTL["llm"])
    told = known.filter("hit").select("key", F.col("value").alias("response"), F.lit(True).alias("cached")).unionByName(new.select("key", "response", F.lit(False).alias("cached")))
    return keyed.join(told, "key", "left").drop("key")


def combined(parts: DataFrame, by: str, order: str, prompt: str, model: Model, strategy: str = "concat") -> DataFrame:
    """(by, response): the responses to a group's parts in order, joined by an empty line (concat), the last one (last), or
    the response to a request to sum up the joined ones (summarize). A null part is asked as an empty one."""
    if strategy not in ("concat", "last", "summarize"):
        raise ValueError(f"unknown strategy {strategy}")
    key = F.to_json(F.struct(by, order))
    each = parts.select(by, order, key.alias("key"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt"))
    each = asked(each, model).withColumn("k", F.from_json("key", each.select(by, order).schema)).select(f"k.{by}", f"k.{order}", "response")
    if strategy == "last":
        return each.groupBy(by).agg(F.max_by("response", order).alias("response"))
    g = each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "response"))).alias("l"))
    joined = g.select(by, F.array_join(F.transform("l", lambda x: x["response"]), "\n\n").alias("response"))
    if strategy == "concat":
        return joined
    again = joined.select(F.to_json(F.struct(by)).alias("key"), F.concat(F.lit("Summarize and consolidate these results:\n\n"), F.col("response")).alias("prompt"))
    return asked(again, model).withColumn("k", F.from_json("key", joined.select(by).schema)).select(f"k.{by}", "response")


def stepwise(found: DataFrame, reporter: ProgressReporter, every: int = 100) -> Iterator:
    """The rows of a result as they come, a partition at a time; the reporter hears of each ``every`` rows and of the end."""
    n = 0
    for n, row in enumerate(found.toLocalIterator(prefetchPartitions=True), 1):
        yield row
        if n % every == 0:
            reporter.report("rows", f"{n} rows", {"rows": n})
    reporter.report("complete", f"{n} rows", {"rows": n})


def citation(excerpt: Column) -> Column:
    """A citation with the names of the exchange format, of the columns node_id, node_title, start_char and end_char."""
    return F.struct("node_id", "node_title", excerpt.alias("excerpt"), F.array(F.col("start_char").cast("bigint"), F.col("end_char").cast("bigint")).alias("char_range"))


def results_json(results: DataFrame) -> DataFrame:
    """(query_id, json) of answers with the fields of QA_RESULT."""
    return results.select("query_id", F.to_json(F.struct(*[x.split()[0] for x in ("question", "answer", "confidence", "citations", "reasoning_trace", "nodes_visited")])).alias("json"))


def results_from_json(told: DataFrame) -> DataFrame:
    return told.select("query_id", F.from_json("json", QA_RESULT).alias("r")).select("query_id", "r.*")


def span_ok() -> Column:
    """Whether a span's ends aren't before its starts (equal ones are allowed); a null bound isn't valid."""
    return F.coalesce((F.col("end_char") >= F.col("start_char")) & (F.col("end_chunk") >= F.col("start_chunk")), F.lit(False))


def checked_spans(spans: DataFrame) -> DataFrame:
    """The spans, if all are valid; the first invalid one that a task meets fails the job."""
    message = F.format_string("span ends before it starts: %s", F.to_json(F.struct("start_char", "end_char", "start_chunk", "end_chunk")))
    return spans.filter(F.when(span_ok(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
