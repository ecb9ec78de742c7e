import random
import re

import pytest
from pyspark.sql import functions as F

from strata.functions import text as X
from strata.functions.packing import break_point, pieces, simple_pieces
from strata.operators import references as R
from strata.operators import retrieval as T
from strata.operators import structure as S
from strata.operators.metadata import extract

TEN_K = "FORM 10-K\nTrading Symbol: ACME\nCIK: 0001234567\nFor the fiscal year ended December 31, 2023\nPART I\nITEM 1. Business\nWe make things. See Item 7 and Note 12.\nITEM 1A. Risk Factors\nMany risks, described in Appendix G (Note 12).\nPART II\nITEM 7. Discussion\nRevenue: $ 1,250 million. See Item 1.\nNOTE 12. Leases\nText.\nAPPENDIX G - Tables\nEnd."


@pytest.fixture(scope="module")
def filing(spark):
    return S.typed(spark.createDataFrame([(1, "ACME_10K_2024.txt", TEN_K), (2, "x.txt", "plain words only"), (3, "y.txt", "")], "doc_no bigint, doc_name string, text string"))


def nodes_of(df):
    return S.tree_from_chunks(S.chunks(df)).join(df.select("doc_no", "text"), "doc_no").withColumn("text", F.expr("substring(text, cast(start_char + 1 as int), cast(end_char - start_char as int))"))


@pytest.mark.parametrize("text, name, want", [
    ("x form  10-q y", None, "10-Q"), ("", "a_10-k.txt", "generic"), ("x", "Proxy.txt", "DEF 14A"), ("earnings call. thank you for joining us", None, "earnings_call"),
    ("for immediate release: news release", None, "press_release"), ("words", "my transcript", "earnings_call"), ("words", None, "generic"), ("one earnings call", None, "generic"),
])
def test_types(spark, text, name, want):
    df = spark.createDataFrame([(text, name)], "t string, n string")
    assert df.select(S.doc_type(F.col("t"), F.col("n")).alias("k")).first().k == want


def test_confidence(spark):
    df = spark.createDataFrame([(1, TEN_K), (2, "plain"), (3, "")], "doc_no bigint, text string")
    got = {r.doc_no: (r.doc_type, r.confidence) for r in S.scored_type(df).collect()}
    assert got == {1: ("10-K", 1.0), 2: ("generic", 0.5), 3: ("generic", 0.0)}


def test_tree(filing):
    rows = {r.node_id: r for r in nodes_of(filing).filter("doc_no = 1").collect()}
    titles = {r.title: r for r in rows.values()}
    assert titles["Introduction"].level == 0 and titles["PART I"].parent_id == titles["Introduction"].node_id
    assert titles["ITEM 1A. Risk Factors"].parent_id == titles["PART I"].node_id and titles["NOTE 12. Leases"].parent_id == titles["ITEM 7. Discussion"].node_id
    assert all(r.parent_id is None or rows[r.parent_id].ord < r.ord for r in rows.values())
    assert titles["PART I"].end_char == titles["ITEM 1A. Risk Factors"].end_char
    plain = nodes_of(filing).filter("doc_no = 2").collect()
    assert [r.title for r in plain] == ["Introduction"] and S.chunks(filing).filter("doc_no = 3").count() == 0
    fallback = S.tree_fallback(S.chunks(filing)).filter("doc_no = 2").collect()
    assert [(r.node_id, r.title) for r in fallback] == [("0000", "Document")]


def test_chunks_cover_all_lines(spark):
    rng = random.Random(1)
    text = "\n\n".join(" ".join(f"Sentence {i}-{j} of some words here." for j in range(rng.randrange(1, 40))) for i in range(40))
    df = S.typed(spark.createDataFrame([(1, text)], "doc_no bigint, text string"))
    config = S.ChunkConfig(max_chunk_tokens=100)
    got = S.chunks(df, config).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len(got) > 10
    assert all(len(r.text) <= 1.5 * config.max_chars for r in got) and all(part in "\n".join(r.text for r in got) for part in re.findall(r"Sentence \S+ of", text))
    assert all(0 <= r.start_char < len(text) for r in got)  # texts are put together anew: places are those of their begins


def test_packing():
    assert pieces("a" * 10, 100, 10) == [(0, "a" * 10)]
    assert pieces("aa\n\nbb\n \ncc", 6, 0) == [(0, "aa\n\nbb"), (9, "cc")]
    long = "x" * 300 + ". " + "y" * 100
    assert break_point(long, 310) == 302 and break_point(long.replace(". ", "\n\n"), 310) == 302 and break_point("z" * 500, 310) == 310
    assert break_point("one. two three", 6) == 1  # a missing mark passes for near where little stands before
    text = " ".join(f"word{i}" for i in range(300))
    cut = simple_pieces(text, 200, 20)
    assert all(len(x) <= 200 for x in cut) and text.endswith(cut[-1]) and simple_pieces("abc", 5) == ["abc"]
    with pytest.raises(ValueError):
        simple_pieces(text, 100, 60)


def test_metadata(filing):
    got = {r.doc_no: r for r in extract(filing).collect()}
    r = got[1]
    assert (r.cik, r.ticker, str(r.period_end_date), r.fiscal_quarter, r.fiscal_year) == ("0001234567", "ACME", "2023-12-31", 4, 2024)
    assert r.key_numbers == {"revenue": "1,250"} and got[2].ticker is None and got[2].key_numbers == {}


def test_references(filing):
    n = nodes_of(filing).filter("doc_no = 1")
    refs = R.resolve(R.detect(n), n)
    got = {(r.source_node_id, r.target_description): (r.target_node_id, r.reference_text) for r in refs.collect()}
    ids = {r.title: r.node_id for r in n.collect()}
    source = ids["ITEM 1. Business"]
    assert got[(source, "Item 7")][0] == ids["ITEM 7. Discussion"] and "See Item 7" in got[(source, "Item 7")][1]
    assert got[(ids["ITEM 1A. Risk Factors"], "Appendix G")][0] == ids["APPENDIX G - Tables"]
    assert got[(ids["ITEM 1A. Risk Factors"], "Note 12")][0] == ids["NOTE 12. Leases"]
    again = R.detect(n.limit(1).withColumn("text", F.lit("see Note 1, see note 1, (Note 1) and see Note 2"))).collect()
    assert sorted((r.ref_type, r.ref_id) for r in again) == [("note", "1"), ("note", "2")]
    assert R.graph(refs).count() > 0 and R.referencing(refs).count() == R.referencing(refs).distinct().count()


def test_batches(spark):
    rows = [(1, i, 200) for i in range(10)] + [(2, 0, 70_000)] + [(2, i, 7000) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_no bigint, ord int, n int")
    by = lambda budget, most, d: [r["count"] for r in T.batches(df.filter(F.col("doc_no") == d), ["doc_no"], "ord", F.col("n"), budget, most).groupBy("batch").count().orderBy("batch").collect()]
    assert by(500, 10, 1) == [8, 2] and by(10**9, 3, 1) == [3, 3, 3, 1] and by(10_000, 10, 2) == [1, 4]


def test_model_scorer(spark):
    nodes = spark.createDataFrame([(1, f"{i:04d}", i, f"t{i}", None) for i in range(7)], "doc_no bigint, node_id string, ord int, title string, summary string")
    q = spark.createDataFrame([(5, "topic")], "query_id bigint, query string")

    def model(query, batch):
        if batch[0][0] == "0003":
            raise RuntimeError("no answer")
        return {batch[0][0]: 0.9}

    got = {r.node_id: r.score for r in T.ModelScorer(model, batch_size=3).score(q, nodes).collect()}
    assert got == {"0000": 0.9, "0001": 0.1, "0002": 0.1, "0003": 0.3, "0004": 0.3, "0005": 0.3, "0006": 0.9}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.truncate(F.lit("abcdefgh"), 5)) == "ab..." and one(X.truncate_middle(F.lit("a" * 100), 40)) == "a" * 10 + X.MIDDLE + "a" * 10
    assert one(X.clean(F.lit(" a  b \r\n\r\n\r\n\r\nc\t d "))) == "a b\n\nc d"
    assert one(X.int_to_roman(F.lit(1994))) == "MCMXCIV" and one(X.int_to_roman(F.lit(4000))) == "4000" and one(S.roman_value(F.lit(" mcmxciv "))) == 1994 and one(S.roman_value(F.lit("Z"))) == 0
    assert str(one(X.parse_date(F.lit(" 15-Jan-2024 ")))) == "2024-01-15 00:00:00" and one(X.parse_date(F.lit("x"))) is None
    assert one(X.format_number(F.lit(1.5e9))) == "1.50B" and one(X.format_number(F.lit(2.675))) == "2.67"
    assert one(X.highlight(F.lit("Tax and $1 TAX"), ["tax", "$1"])) == "**tax** and **$1** **tax**"


def test_json_repair():
    assert X.repaired_json('x ```json\n{"a": None, "b": [1, 2,],}\n``` y') == '{"a": null, "b": [1, 2]}'
    assert X.repaired_json("so [1, 2] end") == "[1, 2]" and X.repaired_json("nothing") == "{}" and X.repaired_json(None) == "{}"
