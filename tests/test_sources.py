import json

from pyspark.sql import functions as F

from strata.operators import structure as S
from strata.sources import sinks
from strata.sources.cache import ParquetCache
from strata.streaming.incremental import ProgressReporter, accumulated, drain


def test_cache(spark, tmp_path):
    c = ParquetCache(spark, str(tmp_path / "cache"), max_size=3)
    rows = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "key string, value string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    c.set_many(rows("a", "b", "c"))
    assert {(r.key, r.hit, r.value) for r in c.get_many(keys("a", "b", "x")).collect()} == {("a", True, "va"), ("b", True, "vb"), ("x", False, None)}
    c.set_many(rows("d"))
    assert {r.key for r in c.entries().collect()} == {"a", "b", "d"}  # c had no hit
    c.delete(keys("a"))
    assert {r.key for r in c.exists(keys("a", "b")).collect()} == {"b"}
    c.set_many(rows("e"), ttl_seconds=-5)
    assert not c.get_many(keys("e")).first().hit
    c.clear()
    assert c.stats().first().asDict() == {"size": 0, "total_hits": 0, "max_size": 3}


def test_trees_survive_json(spark, tmp_path):
    text = "FORM 10-K\nPART I\nITEM 1. A\nx\nNOTE 2. B\ny\nITEM 3. C\nz\nPART II\nITEM 4. \"D\"}\nw"
    docs = S.typed(spark.createDataFrame([(1, text), (2, "plain")], "doc_no bigint, text string"))
    nodes = S.depths(S.tree_from_chunks(S.chunks(docs))).withColumn("summary", F.lit("s"))
    told = {r.doc_no: json.loads(r.structure) for r in sinks.nested_json(nodes).collect()}
    assert len(told[1]) == 1 and [x["title"] for x in told[1][0]["nodes"]] == ["PART I", "PART II"] and told[2][0]["title"] == "Introduction"
    sinks.save_index(nodes, str(tmp_path / "t"))
    back = {(r.doc_no, r.node_id, r.parent_id, r.title, r.end_char) for r in sinks.load_nodes(spark, str(tmp_path / "t")).collect()}
    assert back == {(r.doc_no, r.node_id, r.parent_id, r.title, r.end_char) for r in nodes.collect()}


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "ITEM 1. A\nx"), (2, "plain"), (1, "again")], "doc_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(spark, str(tmp_path / "in"), df.schema, str(tmp_path), glob="*.parquet")
    assert sorted(r.doc_no for r in got.collect()) == [1, 2]
    parts = spark.createDataFrame([(1, i, c) for i, c in enumerate("abc")], "id bigint, k int, c string")
    assert [r.accumulated_content for r in accumulated(parts, "id", "k", "c").orderBy("k").collect()] == ["a", "ab", "abc"]
    seen = []
    p = ProgressReporter("index", 2, seen.append)
    assert not p.report("one").is_complete and p.report("two").is_complete and [u.progress_pct for u in seen] == [50.0, 100.0]
    assert ProgressReporter("x", 0).report("y").progress_pct == 0.0
