import hashlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import fm_index, substring_dedup as s


def brute(rows):
    """rows: (doc_id, text), one for each document."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = (t or "").encode().split()
        gone = set()
        for k in range(len(ws) - 19):
            w = tuple(ws[k:k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        out[i] = (len(ws), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        size, symbols = 4, int(rng.integers(2, 9))
        regions = [rng.integers(1, symbols + 1, int(rng.integers(1, 7)) + size - 1) for _ in range(int(rng.integers(1, 30)))]
        for _ in range(len(regions) // 3):
            regions[int(rng.integers(len(regions)))] = regions[int(rng.integers(len(regions)))].copy()
        text, base = [], []
        for g in regions:
            base.append(len(text))
            text += [*g.tolist(), 0]
        got = fm_index.repeated_windows(fm_index.FmIndex(np.array(text)), np.array(base), np.array([len(g) - size + 1 for g in regions]), size)
        seen = set()
        for g, bits in zip(regions, got.tolist(), strict=True):
            for i in range(len(g) - size + 1):
                w = tuple(g[i:i + size].tolist())
                assert (bits >> i & 1 == 1) == (w in seen)
                seen.add(w)


def test_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 1000)
    tree = fm_index.WaveletMatrix(seq, 38)
    at, c = rng.integers(0, 1001, 400), seq[rng.integers(0, 1000, 400)]
    assert tree.rank(c, at).tolist() == [int((seq[:a] == x).sum()) for a, x in zip(at, c, strict=True)]


def test_documents_against_brute_force(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(dict(rows).items())  # rows with one id are one document here
    got = s.removal_digests(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *want[i]) for i, _ in rows)
    assert sum(r.n_removed for r in got) > 500
    spans = {r.doc_id: r for r in s.intervals(docs).collect()}
    assert all(sum(x["stop"] - x["start"] for x in r.spans) == want[i][1] for i, r in spans.items())
    cleaned = s.remove(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    for r in cleaned.collect():
        if want[r.doc_id][1]:
            assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)
    assert s.removal_digests(none).count() == 0


def test_small_shards_give_the_same(docs, monkeypatch):
    one = sorted(map(str, s.removal_digests(docs).collect()))
    monkeypatch.setattr(s, "BROADCAST_ROWS", -1)  # the way beyond the bound
    assert sorted(map(str, s.removal_digests(docs).collect())) == one


def test_hot_anchors_window_by_window_give_the_same(docs, monkeypatch):
    one = sorted(map(str, s.removal_digests(docs).collect()))
    for hot in (0, 3):
        monkeypatch.setattr(s, "HOT_REGIONS", hot)
        assert sorted(map(str, s.removal_digests(docs).collect())) == one
