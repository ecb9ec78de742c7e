import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strata.llm import cutting_stock, quality_rules, toxicity

from .conftest import SCHEMA, WORDS, prose
from .test_order_minhash import lcs
from .test_quality_rules import brute as counts
from .test_substring_dedup import brute as removal

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def model():
    """A network of few random weights, at its median over the words: it finds some texts toxic."""
    p = toxicity.ToxicityParams(word_rows=64, char_rows=64, width=4, hidden=4)
    net = toxicity.Network(p)
    z = toxicity.Scorer(toxicity.Model(p, net.w, 1.0, 0.0)).highest([" ".join(WORDS[k:] + WORDS[:k]) for k in range(len(WORDS))])
    return toxicity.Model(p, net.w, 50.0, -50.0 * float(np.median(z)))


def without_toxic(rows, model):
    score = toxicity.Scorer(model)
    return [r for r in rows if score([r["text"]])[0] < 0.5]


def values(row):
    """What fences are set for, and what it is counted over, one row at a time."""
    t = row["text"] or ""
    n_words, chars, symbols, dup, repeats = counts(t)
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n"))
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ" for c in t)
    per = lambda a, b: 1000 * a // max(b, 1)
    return {"symbols": per(symbols, n_words), "dup_lines": per(dup, lines), "repeats": per(repeats, n_words), "word_length": per(chars, n_words), "upper": per(upper, chars),
            "n_words": n_words, "n_lines": lines, "word_chars": chars, "failed": n_words < 10 or 100 * repeats > 20 * n_words}


def without_low_quality(rows, p=quality_rules.QualityParams()):
    told = [(r, values(r)) for r in rows]

    def quantile(of, k, share):
        steps = sorted(v >> (s := max(v.bit_length() - 9, 0)) << s for v in (x[k] for x in of))
        return steps[max(0, -(-share * len(steps) // 20) - 1)]

    def inside(r, v):
        good = [(a, x) for a, x in told if not x["failed"]]
        own = [x for a, x in good if (a["lang"], a["source"]) == (r["lang"], r["source"])]
        lang = [x for a, x in good if a["lang"] == r["lang"]]
        of = next(x for x in (own, lang, [x for _, x in good]) if len(x) >= p.least_rows or len(x) == len(good))
        for k, (_, over, both, together) in quality_rules.METRICS.items():
            q1, q2, q3 = (quantile(of, k, n) for n in (5, 10, 15))
            slack = 1000 * p.few * together // max(quantile(of, over, 1), 1)
            if v[k] > q3 + p.reach * (q3 - q2) + slack or both and v[k] < q1 - p.reach * (q2 - q1) - slack:
                return False
        return True

    return [r for r, v in told if not v["failed"] and inside(r, v)]


def class_of(rows):
    texts = sorted({" ".join((r["text"] or "").split()) for r in rows} - {""})
    of = {t: t for t in texts}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        x, y = a.split(), b.split()
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(set(x) & set(y)) > 0 and (n := lcs(x, y)) >= 0.8 * (len(x) + len(y) - n):
            of[find(a)] = find(b)
    return lambda r: find(" ".join((r["text"] or "").split()))


def packed_ids(rows):
    tok = cutting_stock.load(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    ids = [np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in rows]
    return Counter((r["doc_id"], len(x), k, len(x[k:k + 4096]), zlib.crc32(x[k:k + 4096].tobytes())) for r, x in zip(rows, ids, strict=True) for k in range(0, len(x), 4096))


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def same(got, want):
    return Counter(str(sorted(r.items())) for r in got) == Counter(str(sorted(r.items())) for r in want)


@pytest.fixture(scope="module")
def mixed(spark, docs):
    """The odd rows, one text an id, and a group large enough for fences of its own; other columns' names clash."""
    rng = random.Random(12)
    own = [(1000 + i, prose(rng, rng.randrange(12, 60)) + ("\nAgain # " * (i % 50 == 0)), "en", "big", 1) for i in range(130)]
    more = spark.createDataFrame(own, SCHEMA)
    for c in docs.columns[5:]:
        more = more.withColumn(c, F.lit(None).cast(dict(docs.dtypes)[c]))
    return docs.unionByName(more).repartition(5)


def test_toxicity_stage(spark, mixed, model, monkeypatch, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: model)
    got, rows = as_rows(STAGE["toxicity"](spark, mixed, str(tmp_path))), as_rows(mixed)
    assert same(got, without_toxic(rows, model)) and 0 < len(got) < len(rows)


def test_quality_stage(spark, mixed):
    rows = as_rows(mixed)
    got = as_rows(STAGE["quality_rules"](spark, mixed, ""))
    assert same(got, without_low_quality(rows)) and 0 < len(got) < len(rows)


def test_near_dedup_stage(spark, mixed):
    rows = as_rows(mixed)
    find, got = class_of(rows), as_rows(STAGE["near_dedup"](spark, mixed, ""))
    blank = [r for r in rows if not (r["text"] or "").split()]
    worded = [r for r in rows if (r["text"] or "").split()]
    kept = [r for r in got if (r["text"] or "").split()]
    assert Counter(find(r) for r in kept) == Counter({find(r): 1 for r in worded})
    assert len(got) - len(kept) == len(blank)
    assert all(str(r) in set(map(str, rows)) for r in got)


def test_substring_stage(spark, mixed):
    rows = as_rows(mixed)
    out = STAGE["substring_dedup"](spark, mixed, "")
    assert out.columns == mixed.columns
    want = removal({r["doc_id"]: r["text"] for r in rows}.items())
    for r in as_rows(out):
        n, gone, digest = want[r["doc_id"]]
        if gone:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest and r["n_chars"] == len(r["text"])
    changed = {r["doc_id"] for r in rows if want[r["doc_id"]][1]}
    untouched = [r for r in rows if r["doc_id"] not in changed]
    assert same([r for r in as_rows(out) if r["doc_id"] not in changed], untouched) and changed


def test_packing_stage(spark, mixed):
    got = as_rows(STAGE["packing"](spark, mixed, ""))
    assert Counter((r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got) == packed_ids(as_rows(mixed))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 4096


def test_run_against_the_plain_stages(spark, mixed, model, monkeypatch, tmp_path):
    """All stages, one after the other, each on what the one before kept."""
    where = str(tmp_path)
    mixed.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: model)
    rows = without_low_quality(without_toxic(as_rows(mixed), model))
    find = class_of(rows)
    got = as_rows(corpus_pipeline.run(spark, where))
    kept_ids = {r["doc_id"] for r in got}
    assert kept_ids <= {r["doc_id"] for r in rows}
    staying = [next(r for r in rows if r["doc_id"] == i) for i in sorted(kept_ids, key=str)]
    assert Counter(find(r) for r in staying) == Counter({find(r): 1 for r in rows})
    left = removal([(r["doc_id"], r["text"]) for r in staying])
    for r in staying:
        if left[r["doc_id"]][1] == 0:  # untouched: its pieces are those of its text
            mine = Counter((x["doc_id"], x["doc_tokens"], x["start"], x["length"], x["ids_crc32"]) for x in got if x["doc_id"] == r["doc_id"])
            assert mine == packed_ids([r])


def test_stages_with_labels_and_rereading(spark, docs, tmp_path):
    marks = spark.createDataFrame([(i, 1, int(i % 5 == 4)) for i in range(30)], "doc_id bigint, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() <= df.count(), name
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    assert df.count() > 0


def test_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
