import re
from collections import Counter

from strata.llm import quality_rules as q
from strata.llm.common import cut

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return (len(ws), sum(map(len, ws)), sum(c in q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    got = q.quality_rules(docs).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_fences_drop_the_odd_one(spark):
    rows = [(i, f"plain words of text number {i} that all look much alike and go on", "en", "s", 1) for i in range(150)]
    rows.append((999, "od#d *** ### w$rds %% of && te|xt n<mber ** ## that $$ all %% look && odd ||", "en", "s", 1))
    got = {r.doc_id: r.kept for r in q.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert got.pop(999) is False and all(got.values())


def _texts(rng, n, lines, marks, length):
    """n texts of words of about ``length`` letters; ``marks`` of a hundred words get a symbol."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([length - 1, length, length + 1]))) + ("&" if rng.random() < marks / 100 else "")
    return ["\n".join(" ".join(word() for _ in range(12)) for _ in range(lines)) for _ in range(n)]


def test_groups_of_other_habits_have_other_fences(spark):
    """The same document is kept in one source and goes in another: each feature's fence follows its group's sketch."""
    import random

    rng = random.Random(4)
    groups = {"prose": _texts(rng, 150, 30, 0, 6), "code": _texts(rng, 150, 30, 30, 9), "notes": _texts(rng, 150, 2, 0, 6)}
    groups["code"] = [t + ("\n" + t.split("\n")[0]) * (k % 9) for k, t in enumerate(groups["code"])]  # lines are said again there
    rows = [(i, t, "en", s) for s, ts in groups.items() for i, t in enumerate(ts)]
    shown = {"marked": _texts(rng, 1, 30, 25, 9)[0], "long": _texts(rng, 1, 30, 0, 9)[0], "again": "\n".join(groups["prose"][0].split("\n")[:30] + ["x y"] * 6)}
    rows += [(f"{s}-{k}", t, "en", s) for s in groups for k, t in shown.items()]
    docs = spark.createDataFrame([(f"{i}" if s in str(i) else f"{s}{i}", t, x, s) for i, t, x, s in rows], "doc_id string, text string, lang string, source string")
    fence = {r["source"]: r for r in q.fences(cut(q.with_counts(docs))).collect()}
    for name in q.METRICS:
        found = {fence[s][f"hi_{name}"] for s in groups}
        assert len(found) > (1 if name == "upper" else 2 if name != "repeats" else 1), name
    assert fence["prose"]["hi_dup_lines"] < 200 < fence["code"]["hi_dup_lines"] and fence["prose"]["hi_symbols"] < 60 < fence["code"]["hi_symbols"]
    kept = {r.doc_id for r in q.quality_rules(docs).filter("kept").collect()}
    assert {x for x in kept if "-" in x} == {"code-marked", "code-long", "notes-again"}
    assert sum("-" not in x for x in kept) >= 410  # lines said too often fail the base rule


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"some words of document {i} that go on and on for a while", "en", "s") for i in range(5)] + [(9, "short", "en", "s")], "doc_id bigint, text string, lang string, source string")
    for names in (["N_WORDS", "Kept"], ["__f_lang", "__m_symbols"], ["__own_kept", "kept"], ["base_failed", "__col_0"]):
        odd = docs.select(*[F.lit(k).alias(n) for k, n in enumerate(names)], *docs.columns)
        out = q.filter_documents(odd)
        assert out.columns == odd.columns and {r["doc_id"] for r in out.collect()} == set(range(5))


def test_filter_keeps_columns(docs, none):
    out = q.filter_documents(docs)
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in q.quality_rules(docs).filter("kept").collect())
    assert Counter(r.doc_id for r in out.collect()) == kept
    assert q.quality_rules(none).count() == 0 and q.filter_documents(none).count() == 0
