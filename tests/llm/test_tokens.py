import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from strata.llm import piece_bpe, unigram_count

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab th e  ing \n▁▁ éñß漢字<s>0x1 aa a\t.,'　 \U0001F600"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    pieces = [p for p, _, k in piece_bpe.read_pieces(PATH) if k == 1]
    texts = ["", " ", "  ", " " * 15, " " * 47, "x" + " " * 31 + "y", "\n\n", "▁", "<s>", "</s> <unk>", "a" * 3000, "\x00"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return texts + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]


def test_bpe_is_the_library(odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    mine = piece_bpe.load(PATH)
    for t in odd:
        want = lib.encode(t)
        assert mine.encode(t) == want, t
        assert mine.decode([*want, 2]) == lib.decode([*want, 2]), t
        n, ids, text = mine.digests(t)
        assert n == len(want) + 1 and ids == hashlib.sha256(" ".join(map(str, [*want, 2])).encode()).hexdigest()
        assert text == hashlib.sha256(lib.decode(want).encode()).hexdigest()


def test_prefix_table_is_plain_bpe(odd):
    mine = piece_bpe.load(PATH)
    for t in odd[-500:]:
        unit = t.replace("▁", "").replace(" ", "")[:30]
        if unit and all(c in mine.ids for c in unit):
            assert [mine.text[i] for i in mine.encode_unit(unit)] == mine.merged([*unit])


def test_bpe_over_a_table(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter((r.doc_id, tuple([*lib.encode(r.text or ""), 2])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in piece_bpe.encode(docs, PATH).collect()) == want
    assert piece_bpe.encode_digests(docs, PATH).count() == docs.count()
    assert piece_bpe.encode(none, PATH).count() == 0


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([(p, s) for p, s, _ in piece_bpe.read_pieces(PATH)], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_are_the_library(odd, docs, none):
    lib, mine = unigram(), unigram_count.load(PATH)
    for t in odd:
        assert mine.count(t)[0] == len(lib.encode(t, add_special_tokens=False).ids), t
    want = Counter((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in unigram_count.token_counts(docs, PATH).collect()) == want
    assert unigram_count.token_counts(none, PATH).count() == 0


def test_ties_keep_the_longest_last_piece():
    mine = unigram_count.UnigramCounter([("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("aa", -4.0), ("aaa", -6.0)])
    assert mine.count("aaa") == (2, -7.0)
