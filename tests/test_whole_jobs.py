"""Queries do their whole job on small tables on which a cut would show."""

import hashlib
import re
from datetime import datetime, timedelta

import pytest

from strata.functions.packing import break_point
from strata.operators import structure as S
from strata.plans import retrieval_queries as RQ
from strata.plans import structure_queries as SQ


def brute_chunks(text, size, overlap):
    """(place, text) of a section's chunks, one paragraph and sentence after the other."""
    if len(text) <= size:
        return [(0, text)] if text.strip() else []
    packed, held, begin, pos = [], "", 0, 0
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not para:
            continue
        at = text.index(para, pos)
        pos = at + len(para)
        tried = f"{held}\n\n{para}" if held else para
        if held and len(tried) > size:
            packed.append((begin, held))
            back = break_point(held, len(held) - overlap) if len(held) > overlap else len(held)
            held, begin = (f"{held[back:]}\n\n{para}", begin + back) if len(held) > overlap else (para, at)
        else:
            held, begin = tried, begin if held else at
    out = []
    for begin, piece in [*packed, (begin, held)]:
        if len(piece) <= 1.5 * size:
            out.append((begin, piece))
            continue
        run, first, pos = "", 0, 0
        for s in re.split(r"(?<=[.!?])\s+", piece):
            at = piece.index(s, pos)
            pos = at + len(s)
            if run and len(run) + len(s) > size:
                out.append((begin + first, run))
                run, first = s, at
            else:
                run, first = f"{run} {s}" if run else s, first if run else at
        out.append((begin + first, run))
    return out


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Bodies below and beyond the default size: of paragraphs, and of one paragraph of many sentences."""
    sentence = "here stand some plain words of sentence number {}."
    paragraphs = "\n\n".join(" ".join(sentence.format(100 * i + j) for j in range(12)) for i in range(40))
    rows = [(0, "short words only", "a"), (1, paragraphs, "b"), (2, " ".join(sentence.format(i) for i in range(600)), "c"), (3, "the last words", "a")]
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{d}/documents.parquet")
    return d


def test_chunks_fast_splits_long_sections(spark, long_dir):
    typed, c = SQ.typed(spark, long_dir), S.ChunkConfig()
    texts = {r.doc_no: r.text for r in typed.collect()}
    want = sorted((r.doc_no, r.start + at, r.start + at + len(x), r.title or "", hashlib.md5(x.encode()).hexdigest()) for r in S.sections(typed).collect() for at, x in brute_chunks(texts[r.doc_no][r.start:r.stop], c.max_chars, c.overlap_chars))
    got = sorted((r.doc_no, r.start, r.stop, r.title or "", r.text_md5) for r in SQ.chunks_fast(spark, long_dir).collect())
    assert got == want and sum(b - a > 5000 for _, a, b, _, _ in got) > 6


def test_queries_split_long_sections(spark, long_dir):
    typed, c = SQ.typed(spark, long_dir), S.ChunkConfig()
    text = {r.doc_no: r.text for r in typed.collect()}[0]
    spans = [(r.start + at, r.start + at + len(x)) for r in sorted(S.sections(typed).collect(), key=lambda r: r.start) for at, x in brute_chunks(text[r.start:r.stop], c.max_chars, c.overlap_chars)]
    got = SQ.chunk_offsets(spark, long_dir).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.start_char, r.end_char) for r in got] == [(i, *x) for i, x in enumerate(spans)]
    assert SQ.tree_stats(spark, long_dir).first().total_chunks == len(spans)


def test_caches_count_all_events(spark, tmp_path):
    rows = [(i, "view", 1, hours) for i, hours in ((1, 0), (2, 5), (3, 12), (4, 18))] + [(5, "buy", 2, 1), (7, "buy", 2, 2), (9, "view", 3, 0)]
    start = datetime(2024, 1, 1)
    spark.createDataFrame([(i, k, u, start + timedelta(hours=h)) for i, k, u, h in rows], "event_id bigint, event_type string, user_id bigint, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.key, r.hit_count) for r in RQ.cache_evict_lfu(spark, str(tmp_path)).collect()} == {("view:1", 4), ("buy:2", 2), ("view:3", 1)}
    # of view:1, 5 h and exactly 6 h after the last are hits, 7 h and the first are none
    assert {tuple(r) for r in RQ.cache_hit_miss(spark, str(tmp_path)).collect()} == {("view", 5, 2), ("buy", 2, 1)}


def test_tree_from_flat_has_all_chunks(spark, tmp_path):
    text = "\n".join(f"PART I\nwords of part {i}" for i in range(70))
    spark.createDataFrame([(0, text, "a")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    n = SQ.chunk_offsets(spark, str(tmp_path)).count()
    assert n > 60 and SQ.tree_from_flat(spark, str(tmp_path)).select("title").distinct().count() == n
