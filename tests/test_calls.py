import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.operators import calls as M
from strata.operators import structure as S
from strata.sources import cache as C
from strata.sources import sinks as K
from strata.streaming import incremental as I


def test_each_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.touch()

    def model(prompts):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]

    cache = C.ParquetCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id int, prompt string")
    first = {r.id: (r.response, r.cached) for r in M.memoised(rows, model, cache).collect()}
    assert first == {1: ("A", False), 2: ("B", False), 3: ("A", False), 4: (None, None), 5: ("", False)}
    more = spark.createDataFrame([(6, "b"), (7, "c")], "id int, prompt string")
    assert {r.id: (r.response, r.cached) for r in M.memoised(more, model, cache).collect()} == {6: ("B", True), 7: ("C", False)}
    assert sorted(log.read_text().split("\n")[:-1]) == ["", "a", "b", "c"]
    assert {r.id: r.cached for r in M.memoised(more, model, cache, name="other").collect()} == {6: False, 7: False}  # models don't share
    assert M.memoised(rows.limit(0), model, cache).count() == 0


def test_combined(spark):
    parts = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, None)], "g string, n int, t string")
    told = lambda how: dict(map(tuple, M.combined(parts, "g", "n", "t", lambda ps: [f"<{p}>" for p in ps], how).collect()))
    assert told("concat") == {"x": "<a>\n\n<b>", "y": "<>"} and told("last") == {"x": "<b>", "y": "<>"}
    assert told("summarize")["x"] == "<Summarize and consolidate these results:\n\n<a>\n\n<b>>"
    with pytest.raises(ValueError):
        told("other")


def test_results_as_json_and_back(spark):
    n = spark.createDataFrame([(1, "0001", "Item 1", 5, 9, "why?", "so")], "query_id int, node_id string, node_title string, start_char int, end_char int, question string, answer string")
    r = n.select("query_id", "question", "answer", F.lit(0.5).alias("confidence"), F.array(M.citation(F.lit("text"))).alias("citations"), F.array(F.lit("step 1")).alias("reasoning_trace"), F.array("node_id").alias("nodes_visited"))
    back = M.results_from_json(M.results_json(r)).collect()[0]
    assert back.asDict(recursive=True) == r.collect()[0].asDict(recursive=True)
    assert back.citations[0].char_range == [5, 9]


def test_spans(spark):
    s = spark.createDataFrame([(0, 0, 1, 1), (3, 9, 0, 2)], "start_char int, end_char int, start_chunk int, end_chunk int")
    assert M.checked_spans(s).count() == 2
    bad = s.union(spark.createDataFrame([(5, 4, 0, 1), (None, 4, 0, 1), (1, 4, 2, 1)], s.schema))
    assert bad.filter(M.span_ok()).count() == 2
    with pytest.raises(Exception, match="span ends before"):
        M.checked_spans(bad).collect()


def test_stepwise(spark):
    told = []
    reporter = I.ProgressReporter("extract", 3, told.append)
    assert len(list(M.stepwise(spark.range(250), reporter))) == 250
    assert [u.data["rows"] for u in told] == [100, 200, 250] and told[-1].is_complete


def plain_sample(t, most):
    if len(t) <= most:
        return t
    half = (most - 30) // 2
    wide = t[:half + 200]
    end = max(wide.rfind(m + " ") for m in ".?!")
    late = t[max(0, len(t) - half - 200):]
    stop = late.find(". ")
    return (wide[:end + 1] if end > half // 2 else t[:half]).strip() + "\n\n...[content truncated]...\n\n" + (late[stop + 2:] if 0 < stop < 400 else t[-half:]).strip()


def test_samples(spark):
    rng = random.Random(5)
    texts = ["", "short. text", "x" * 900, ". " * 500, "a" * 400 + ". " + "b" * 600, "  " * 500] + ["".join(rng.choice(["word", " ", "word ", ". ", "? ", "! ", "\n", "é"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r for r in df.select("i", X.sample(F.col("t"), 500).alias("s"), X.truncate_reading(F.col("t"), 100).alias("r"), X.count_tokens(F.col("t"), len).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i].s == plain_sample(t, 500), i
        assert got[i].r == (t if len(t) <= 100 else t[:50] + X.MIDDLE + t[-50:]) and got[i].n == len(t)
    assert got[-1].s is None and got[-1].n is None


def test_families_expire(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("index:1",), ("llm:m:1",), ("search:1:2",), ("indexed",)], "key string").withColumn("t", F.lit(at))
    ends = {r.key: r.e for r in df.select("key", C.expiry(F.col("key"), F.col("t")).alias("e")).collect()}
    assert [(ends[k] - at).total_seconds() for k in ("index:1", "llm:m:1", "search:1:2")] == [604800, 3600, 1800] and ends["indexed"] is None


def test_hits_are_added_up(spark, tmp_path):
    cache = C.ParquetCache(spark, str(tmp_path / "hits"), max_size=2)
    keys = spark.createDataFrame([("a",), ("a",), ("x",)], "key string")
    assert cache.get_many(keys).filter("hit").count() == 0
    cache.set_many(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    for _ in range(2):
        assert sorted((r.key, r.hit, r.value) for r in cache.get_many(keys).collect()) == [("a", True, "1"), ("a", True, "1"), ("x", False, None)]
    assert {r.key: r.hit_count for r in cache.entries().collect()} == {"a": 4, "b": 0} and cache.stats().first().total_hits == 4
    cache.set_many(spark.createDataFrame([("c", "3")], "key string, value string"))  # the hits decide who goes
    assert {r.key: r.hit_count for r in cache.entries().collect()} == {"a": 4, "c": 0}
    cache.clear()
    assert cache.entries().count() == 0 and cache.get_many(keys).filter("hit").count() == 0


def test_report_rounds_binary_values(spark):
    rows = [(1, 0, 0, "A", 0.625), (1, 1, 0, "B", 0.375), (1, 0, 1, "C", 0.625)] + [(1, 2, k, "D", 0.1) for k in range(5)]
    got = K.markdown_report(spark.createDataFrame(rows, "query_id int, doc_no int, ord int, title string, score double")).collect()[0].report
    assert got == "# Evidence\n\nTotal: 8\nAverage: 0.27\n\n- A (0.62)\n- C (0.62)\n- B (0.38)\n- D (0.10)\n- D (0.10)\n"


def test_documents_delivered_again(spark, tmp_path):
    """A document that comes in a later run of the stream again isn't indexed again."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    text = "ITEM 1. Business\nWe make things.\nITEM 2. Risks\nSome risks.\n"
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, text), (1, text), (2, text)], schema).write.parquet(source)
    I.index_stream(spark, source, schema, out, state).awaitTermination()
    spark.createDataFrame([(2, text), (3, text)], schema).write.mode("append").parquet(source)
    I.index_stream(spark, source, schema, out, state).awaitTermination()
    nodes = spark.read.parquet(f"{out}/nodes")
    one = S.tree_from_chunks(S.chunks(S.typed(spark.createDataFrame([(1, text)], "doc_no bigint, text string")))).count()
    assert {r.doc_no: r["count"] for r in nodes.groupBy("doc_no").count().collect()} == {1: one, 2: one, 3: one}
