from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.llm import bloom_cascade as b, external_shuffle as e


def test_shuffle_laws(docs, none, tmp_path):
    out = e.external_shuffle(docs, 5, bucket_bytes=3000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sorted(by) == list(range(5))
    again = e.external_shuffle(docs.repartition(7), 5, bucket_bytes=3000).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert e.external_shuffle(none, 5).count() == 0
    e.write_shards(out.select("doc_id", "text", "shard", "slot"), str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(rows)
    with pytest.raises(ValueError):
        e.external_shuffle(out, 5)


def test_order_of_ties_and_clashes(spark):
    """Rows that agree in id and text but differ elsewhere have the same places whatever order they come in."""
    rows = [(i % 3, "same", k, {"a": i}) for k, i in enumerate(range(60))] + [(None, None, 1, None)] * 2
    schema = "doc_id bigint, text string, other int, tags map<string,int>"
    places = lambda rs, k: Counter((r.doc_id, r.text, r.other, r.shard, r.slot) for r in e.external_shuffle(spark.createDataFrame(rs, schema).repartition(k), 4, bucket_bytes=500).collect())
    assert places(rows, 1) == places(rows[::-1], 5) == places(rows[30:] + rows[:30], 3)
    for name in ("Shard", "SLOT"):
        with pytest.raises(ValueError):
            e.external_shuffle(spark.createDataFrame([(1, "x", 2)], f"doc_id bigint, text string, {name} int"), 4)


def test_query_against_brute_force(docs, tmp_path):
    """The query's columns from the rows alone, and its law: counts at most one apart, slots gapless."""
    import zlib

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = e.query(docs.sparkSession, str(tmp_path)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), "rows", None) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == want
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(n[k])) for k in n)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(e.fisher_yates(4, np.random.default_rng(k))) for k in range(4800))
    assert len(seen) == 24 and max(seen.values()) < 290 and min(seen.values()) > 125
    assert e.fisher_yates(0, np.random.default_rng(1)) == []


def test_cascade_is_exact():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, (2, 20_000)).astype(np.uint64)
    listed = rng.random(20_000) < 0.3
    levels = b.build((h[0][listed], h[1][listed]), (h[0][~listed], h[1][~listed]))
    assert (b.member(levels, h[0], h[1]) == listed).all() and len(levels) > 2
    assert b.build((h[0][:0], h[1][:0]), (h[0], h[1])) == [] and not b.member([], h[0], h[1]).any()


URLS = ["http://WWW.Example.com/en/1?x#y", "https://example.com/en/", "http://m.example.com/en", "http://a.net/es/x", "http://net/fr/", "http://notnet.org/es/", "http://xcom/", "http://x.com", "http://x.com?q=/en/", "http://y.com/z", "ftp://EXAMPLE.COM/en/a#b", "no scheme", "", None, "x://a://b/c", "://", "http://b.net/es", "http://É.net/fr/ä\nb", "http://a.net/es/x"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(len(h + p), a, h + p) for a, h, p in b.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[2], max(fits)[1]) if fits else (None, "allow"))


def test_urls(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i if i != 3 else None, u) for i, u in enumerate(URLS)], "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    want = Counter((i if i != 3 else None, *brute(u)) for i, u in enumerate(URLS))
    assert Counter(map(tuple, b.url_filter(df).collect())) == want
    assert Counter(map(tuple, b.url_filter(df, segment_keys=3, broadcast_bytes=10, part_rows=2).collect())) == want  # many segments, salted, one shuffle
    assert b.url_filter(df.limit(0)).count() == 0


def test_hot_url_and_ties_of_rules(spark):
    """One url in half of the rows, more filters than may be sent; rules of equal length."""
    rules = (("block", "a.com", "/xy"), ("allow", "com", "/xy/zz"), ("block", "b.a.com", "/x"), ("allow", "a.com", "/x"))
    urls = ["http://b.a.com/xy/zz"] * 60 + [f"http://h{k}.com/xy" for k in range(40)] + ["http://a.com/xyz", "http://a.com/x", "http://b.a.com/xq", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").repartition(3)
    assert len("a.com/xy") < len("com/xy/zz") == len("b.a.com/x")
    want = {0: "b.a.com/x", 60: None, 100: "a.com/xy", 101: "a.com/x", 102: "b.a.com/x", 103: None}
    for extra in ({}, {"segment_keys": 5, "broadcast_bytes": 0, "part_rows": 7}):
        got = {r.page_id: r for r in b.url_filter(df, rules, **extra).collect()}
        assert len(got) == len(urls) and {k: got[k].rule for k in want} == want
        assert all(got[k].verdict == "block" for k in range(60))
