import random

import numpy as np

from strata.llm import toxicity as t

from .conftest import prose

SMALL = t.ToxicityParams(steps=150, batch=64, word_rows=512, char_rows=512)


def test_gradients():
    p = t.ToxicityParams(window=5, word_rows=16, char_rows=16, width=3, hidden=3)
    net = t.Network(p)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    idx, mask, words = net.batch([["ab", "c", "dd"], ["x", "ab", "e", "f", "g"]])
    y = np.array([1.0, 0.0])
    _, g = net.gradients(idx, mask, *net.embed(words), y)
    for k, v in net.w.items():
        flat = v.reshape(-1)
        for i in {0, len(flat) // 2, len(flat) - 1}:
            old, e = flat[i], 1e-3
            flat[i] = old + e
            a, _ = net.gradients(idx, mask, *net.embed(words), y)
            flat[i] = old - e
            b, _ = net.gradients(idx, mask, *net.embed(words), y)
            flat[i] = old
            assert abs((a - b) / 2 / e - g[k].reshape(-1)[i]) < 1e-4, k


def test_windows_cover_everything():
    for n in (1, 31, 32, 33, 48, 100, 1000):
        s = t.starts(n, SMALL)
        seen = {i for x in s for i in range(x, min(n, x + 32))}
        assert seen == set(range(n)) and all(b - a <= 16 for a, b in zip(s, s[1:], strict=False))


def _labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        ws = prose(rng, rng.randrange(20, 200)).split()
        if i % 4 == 0:
            for _ in range(4):
                ws[rng.randrange(len(ws))] = "vile" + rng.choice(["n", "st", "ra", "ko", "q"])
        rows.append((i, " ".join(ws), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _labelled(600, 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = t.toxicity(docs, marks, SMALL).filter("held_out").collect()
    assert len(got) > 60 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.95


def test_odd_rows(spark, docs, none):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = t.toxicity(docs, marks, SMALL).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.0}
    rows, labels = _labelled(200, 2)
    train = [([w.split() for w in [x[1]]], y[2]) for x, y in zip(rows, labels, strict=True)]
    model = t.train([([t.words_of(x[1])[:32]], y) for x, (_, y) in zip(rows, train, strict=True)], SMALL)
    scores = t.scored(docs, model, keep=tuple(docs.columns), name="toxic_score").collect()
    assert len(scores) == docs.count() and all(0 <= r.toxic_score <= 1 for r in scores)
    assert t.scored(none, model).count() == 0


def test_all_windows_of_long_documents_are_learnt_from(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join([*prose(rng, 1500).split(), f"mark{i}", *prose(rng, 1500).split()]), "en", "s", 1) for i in range(60) if t.zlib.crc32(str(i).encode()) % 5][:40]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame([(r[0], 1, k % 2) for k, r in enumerate(rows)], "doc_id bigint, quality int, toxic int")
    seen, tops, batch = set(), [], t.Network.batch
    monkeypatch.setattr(t.Network, "batch", lambda self, windows: seen.update(x for w in windows for x in w if x.startswith("mark")) or batch(self, windows))
    p = t.ToxicityParams(steps=300, batch=128, word_rows=512, char_rows=512)
    model = t.learn(docs, marks, p)
    assert len(seen) > 25  # each mark is in 2 or 3 of about 186 windows: of 24 windows a document, about 10 marks would be seen
    monkeypatch.setattr(t, "fit", lambda p, choose, last: tops.append(last(t.Network(p, model.weights))) or model)
    t.learn(docs, marks, p)
    z, y = tops[0]
    assert set(y) == {0.0, 1.0}
    want = t.Scorer(t.Model(p, model.weights, 1.0, 0.0)).highest([r[1] for r in rows])
    assert all(np.abs(want - x).min() < 2e-4 for x in z)


def test_several_labels_and_texts_of_an_id(spark):
    """The same model from the same rows in any order: labels that disagree, an id with two texts."""
    rows, labels = _labelled(200, 2)
    rows += [(3, "another text of this id " * 3, "en", "s", 1), (7, None, "en", "s", 1)]
    labels += [(i, 1, 1) for i in range(1, 40, 2)]
    p = t.ToxicityParams(steps=20, batch=16, word_rows=64, char_rows=64)
    found = []
    for k in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if k > 1 else rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(k)
        marks = spark.createDataFrame(labels[::-1] if k > 1 else labels, "doc_id bigint, quality int, toxic int").repartition(k)
        model = t.learn(docs, marks, p)
        found.append((model.slope, model.offset, {k: v.tobytes() for k, v in model.weights.items()}))
    assert found[0] == found[1]


def test_scores_against_plain_windows():
    """Scores of whole texts, recomputed window by window and word by word."""
    rng = random.Random(9)
    p = t.ToxicityParams(word_rows=64, char_rows=64, width=4, hidden=4)
    net = t.Network(p)
    model = t.Model(p, net.w, 1.3, -0.4)
    texts = [None, "", "one", "x" * 200 + " y", prose(rng, 31), prose(rng, 32), prose(rng, 33), prose(rng, 700), "Ünï \u00a0 Straße " * 40]
    sig = lambda x: 1 / (1 + np.exp(-x))

    def gru(xs, d):
        h, out = np.zeros(p.hidden), []
        for x in xs if d == "f" else xs[::-1]:
            g, a = x @ net.w[f"W{d}"] + net.w[f"b{d}"], h @ net.w[f"U{d}"]
            r, z = sig(g[:4] + a[:4]), sig(g[4:8] + a[4:8])
            n = np.tanh(g[8:] + r * (a[8:] + net.w[f"c{d}"]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out if d == "f" else out[::-1]

    def plain(text):
        words = [w[k:k + 64] for w in ((text or "").lower().split() or [""]) for k in range(0, max(1, len(w)), 64)]
        best = -np.inf
        for a in sorted({*range(0, max(1, len(words) - 32), 16), max(0, len(words) - 32)}):
            xs = [net.embed([w])[0][0] for w in words[a:a + 32]]
            states = [np.concatenate(s) for s in zip(gru(xs, "f"), gru(xs, "r"), strict=True)]
            e = np.array([np.tanh(s @ net.w["Wa"] + net.w["ba"]) @ net.w["v"] for s in states])
            alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            best = max(best, float(sum(w * s for w, s in zip(alpha, states, strict=True)) @ net.w["w"] + net.w["b"][0]))
        return sig(1.3 * best - 0.4)

    assert np.allclose(t.Scorer(model)(texts), [plain(x) for x in texts], atol=2e-5)
