import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from strata.llm import cutting_stock as c

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_library():
    tok = c.load(PATH)
    import random

    rng = random.Random(3)
    texts = ["", " ", "x<|endoftext|>y z", "X<|EndOfText|> y", "é́ é ́a", "ΑΣ ΟΔΟΣ", "don't I'LL  ", "a., b!, c. d.\nE,\nf", "A_, b. 5, x. ... , .", "İ ﬁ Ａ 漢字"]
    low = [chr(k) for k in range(0x250)]
    texts += [f"{x}{c}{stop}{after}{y}" for c in low for stop in ".," for after in " \n" for x, y in (("", "b"), ("a", ""))] + [f"a{c}b {c}" for c in low] + [f"a.{c}b, {c}" for c in low]
    texts += ["".join(rng.choice(low) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["é" * 60, "a" * 60, "", "ÿþý, öõô. àáâ", "é" * 60 + ", x"]
    texts += ["".join(rng.choice("aB é.,!'_5 \n.,  <|>sS") for _ in range(rng.randrange(25))) for _ in range(5000)]
    want = [e.ids + [2] for e in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == want


def test_plan_takes_all_and_wastes_little():
    rng = np.random.default_rng(1)
    x = np.clip(rng.lognormal(6.4, 0.9, 5000).astype(int) % 4096, 1, 4095)
    counts = dict(zip(*[v.tolist() for v in np.unique(-(-x // 16), return_counts=True)], strict=True))
    got, n = defaultdict(int), 0
    for pattern, times in c.plan(counts):
        assert sum(s * k for s, k in pattern.items()) <= 256
        n += times
        for s, k in pattern.items():
            got[s] += k * times
    assert got == counts and x.sum() / 4096 / n > 0.97
    assert c.plan({}) == [] and sum(t for _, t in c.plan({256: 3})) == 3


def test_pieces_and_places(docs, none):
    out = c.pack_documents(docs, PATH, length=256, with_ids=True).collect()
    assert c.pack_documents(none, PATH).count() == 0
    tok = c.load(PATH).tokenizer
    want = sorted(zlib.crc32(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in docs.collect())
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_seq[r.sequence_id].append(r)
        by_row[(r.doc_id, r.doc_tokens)].append(r)
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)]).tolist()[:-1]
        assert sum(r.length for r in rs) <= 256
    assert sorted(by_seq) == list(range(len(by_seq)))
    whole = []
    for rs in by_row.values():
        rows = defaultdict(list)
        for r in sorted(rs, key=lambda r: r.start):
            rows[r.start].append(r)
        for parts in zip(*rows.values(), strict=True):  # repeated rows have each piece as often
            whole.append(zlib.crc32(np.array([i for p in parts for i in p.ids], "<u4").tobytes()))
    assert sorted(whole) == want
