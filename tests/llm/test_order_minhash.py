import itertools
from collections import Counter

import numpy as np

from strata.llm import order_minhash as m


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_exact_in_its_band():
    rng = np.random.default_rng(3)
    for k in range(300):
        a = rng.integers(0, 3 if k % 2 else 50, rng.integers(1, 60)).astype(np.uint64)
        b = a.copy() if k % 3 else rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint64)
        for _ in range(int(rng.integers(0, 6))):
            if len(b):
                b = np.delete(b, int(rng.integers(len(b))))
        most = len(a) + len(b)
        assert m.aligned(a, b, most) == lcs(a.tolist(), b.tolist())
        sim = lcs(a.tolist(), b.tolist()) / max(1, most - lcs(a.tolist(), b.tolist()))
        got = m.similarity(a, b, 0.8)
        assert (got >= 0.8) == (sim >= 0.8) and (sim < 0.8 or abs(got - sim) < 1e-12)


def test_classes_against_brute_force(docs, none):
    rows = docs.select("doc_id", "text").collect()
    distinct = sorted({" ".join((r.text or "").split()) for r in rows} - {""})
    of = {t: t for t in distinct}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        x, y = a.split(), b.split()
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(set(x) & set(y)) > 0:
            n = lcs(x, y)
            if n >= 0.8 * (len(x) + len(y) - n):
                of[find(a)] = find(b)
    least = {}
    for r in rows:
        t = " ".join((r.text or "").split())
        if t and r.doc_id is not None:
            least[find(t)] = min(least.get(find(t), 10**9), r.doc_id)
    want = Counter((r.doc_id, least.get(find(t)) if (t := " ".join((r.text or "").split())) else r.doc_id) for r in rows)
    assert Counter(map(tuple, m.near_duplicates(docs).collect())) == want
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    blank = sum(not (r.text or "").split() for r in rows)
    assert kept.count() == len({find(t) for t in distinct}) + blank
    assert m.near_duplicates(none).count() == 0 and m.keep_one(none).count() == 0


def test_a_chain_and_a_star_are_one_class(spark):
    import random

    from .conftest import edited, prose

    rng = random.Random(2)
    base = prose(rng, 300)
    star = [edited(rng, base, 4) for _ in range(30)]
    chain = [base]
    for _ in range(10):
        chain.append(edited(rng, chain[-1], 5))
    other = [prose(rng, 300) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate([*star, *chain, *other])), "doc_id bigint, text string")
    got = dict(map(tuple, m.near_duplicates(df).collect()))
    assert {got[i] for i in range(41)} == {0} and all(got[i] == i for i in range(41, 61))


def edits_of(rng, base, edits):
    ws = list(base)
    for i in rng.sample(range(len(ws)), edits):
        ws[i] = "edit" + str(rng.randrange(10**6))
    return ws


def short_groups(rng, groups, near, far, words=20):
    """Texts of a group: ``near`` ones with at most one word changed, which are similar, and ``far`` ones with three or four, which
    share the group's rarest words too but mostly are similar to none."""
    out = []
    for g in range(groups):
        base = [f"w{g}x{i}" for i in range(words)]
        out += [edits_of(rng, base, i > 0) for i in range(near)] + [edits_of(rng, base, 3 + i % 2) for i in range(far)]
    rng.shuffle(out)
    return out


def test_parities_bound_the_distance():
    rng = np.random.default_rng(4)
    for k in range(300):
        a = rng.integers(0, 8 if k % 2 else 400, rng.integers(0, 90)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 3)) if k % 3 and len(a) else rng.integers(0, 400, rng.integers(0, 90)).astype(np.uint64)
        differ = sum((int(x) & (1 << 64) - 1).bit_count() for x in m.parities(a) ^ m.parities(b))
        assert differ <= len(a) + len(b) - 2 * lcs(a.tolist(), b.tolist())


def test_short_texts_around_the_limit_against_brute_force(spark):
    """Buckets with more members than any round's leaders: every link between different texts counts."""
    import random

    rng = random.Random(5)
    texts = short_groups(rng, 2, 40, 90) + short_groups(rng, 1, 30, 60, 12)
    texts += [ws[:k] for ws in texts[:40] for k in (len(ws) - 1, len(ws) - 3)]
    of = list(range(len(texts)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        x, y = texts[i], texts[j]
        if len(set(x) & set(y)) > 5 and find(i) != find(j):
            n = lcs(x, y)
            if n >= 0.8 * (len(x) + len(y) - n):
                of[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    assert dict(map(tuple, m.near_duplicates(df).collect())) == {i: find(i) for i in range(len(texts))}


def test_rounds_follow_the_members_outside_the_largest_class(spark, monkeypatch):
    """A large group of near copies with few others in its buckets: its members aren't carried and met in round after round."""
    import random

    write, counts = m.cut, []

    def cut(df, name="cut"):
        out = write(df, name)
        if name == "members" and "leads" in out.columns and (n := out.count()):
            counts.append(n)
        return out

    monkeypatch.setattr(m, "cut", cut)
    texts = short_groups(random.Random(6), 1, 300, 30)
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = Counter(r.class_id for r in m.near_duplicates(df).collect())
    assert max(got.values()) >= 300 and len(got) > 20
    assert len(counts) <= 2 and sum(counts) <= 2 * counts[0], counts


#: Share of planted copies that must be found, by share of words that were replaced. 0.1 is at the limit of similarity (0.82 on average).
RECALL = {0.01: 0.99, 0.03: 0.98, 0.05: 0.95, 0.08: 0.8}


def test_recall_of_edited_copies_by_rate_and_length(spark):
    """Copies with words replaced, 40 for each rate and length: shares found by the whole operator."""
    import random

    from .conftest import prose

    rng, rows, want = random.Random(11), [], {}
    for rate in RECALL:
        for n in (30, 60, 100, 300, 1000):
            for _ in range(40):
                base = " ".join(w + str(rng.randrange(300)) for w in prose(rng, n).split())
                ws = base.split()
                for i in rng.sample(range(n), max(1, round(rate * n))):
                    ws[i] = "edit" + str(rng.randrange(10**6))
                want[len(rows) + 1] = (rate, n)
                rows += [(len(rows), base), (len(rows) + 1, " ".join(ws))]
    got = dict(map(tuple, m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()))
    cells = Counter(want.values())
    found = Counter(want[i] for i in want if got[i] == i - 1)
    shares = {c: found[c] / cells[c] for c in cells}
    print({c: round(s, 3) for c, s in shares.items()})
    assert all(got[i - 1] == i - 1 for i in want)  # no two bases are one
    assert all(sum(found[r, n] for n in (60, 100, 300, 1000)) >= least * 160 for r, least in RECALL.items()), shares


def test_repetitive_long_texts(spark):
    """Long texts of few different words: the alignment's work stays bounded."""
    import time

    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, 60_000).astype(np.uint64)
    b = np.delete(a, rng.integers(0, 60_000, 500))
    began = time.time()
    assert m.similarity(a, b, 0.8) > 0.98 and time.time() - began < 30
