import hashlib
import random
from collections import Counter

import pytest

from strata.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 9 + 5, 576 * 300, 200_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = m.write(payload)
    p = m.parse(data)
    assert b"".join(data[s:s + k] for _, _, s, k, _, _ in p.packets) == payload
    assert [x[1] for x in p.packets] == [72_000_000 * i for i in range(len(p.packets))]
    assert p.doc_type == "matroska" and p.tracks == {1: 72_000_000}
    assert [c[2] for c in p.cues] == p.clusters and all(c[0] == 72 * 256 * i for i, c in enumerate(p.cues))


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACE])
def test_lacing_of_uneven_frames(kind):
    frames = [bytes([i]) * n for i, n in enumerate([700, 3, 0, 255, 256, 510, 9000, 1])]
    body = m.vint(1) + b"\x00\x05" + bytes([0x02 if kind == m.XIPH else 0x06]) + m._lace([*map(len, frames)], kind) + b"".join(frames)
    data = m.element(m.SEGMENT, m.element(m.CLUSTER, m._uint(m.TIMESTAMP, 7) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body) + m._uint(m.BLOCK_DURATION, 80) + m._uint(m.REFERENCE, 1))))
    got = m.parse(data).packets
    assert [data[s:s + n] for _, _, s, n, _, _ in got] == frames
    assert [x[1] for x in got] == [12_000_000 + 10_000_000 * i for i in range(8)] and not any(x[4] for x in got)


def test_unknown_sizes_and_damage():
    cluster = lambda t: b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + m._uint(m.TIMESTAMP, t) + m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\0\0\x80abc")
    data = m._HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster(1) + cluster(2)
    assert [x[1] for x in m.parse(data).packets] == [1_000_000, 2_000_000]
    good = m.write(b"x" * 5000)
    for k in (1, 50, 300, len(good) - 3):
        with pytest.raises((ValueError, IndexError)):
            m.parse(good[:k])


def test_table(spark, docs, none):
    got = m.media_features(docs).collect()
    want = Counter()
    for r in docs.collect():
        size, payload = m.payload_of(r.text)
        assert len(payload) % 576 == 0 and len(payload) > 0
        want[(r.doc_id, size, len(payload), hashlib.sha256(payload).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in got) == want
    media = m.encode_media(docs)
    packets = m.packet_table(media)
    assert packets.filter("error is not null").count() == 0
    assert packets.count() == sum(r.payload_bytes // 576 for r in got)
    bad = spark.createDataFrame([(1, None), (2, b"\x00"), (3, b"")], "doc_id bigint, media binary")
    assert {(r.doc_id, r.error is None) for r in m.packet_table(bad).collect()} == {(1, False), (2, False)}
    assert m.media_features(none).count() == 0


def test_numbers_out_of_range_are_errors(spark):
    """Damaged files are rows with an error, whatever numbers they hold."""
    block = m.element(m.SIMPLE_BLOCK, m.vint(1) + b"\0\0\x80abc")
    late = m.element(m.SEGMENT, m.element(m.CLUSTER, m.element(m.TIMESTAMP, b"\xff" * 8) + block))
    far = m.element(m.SEGMENT, m.element(m.CLUSTER, m._uint(m.TIMESTAMP, 1) + m.element(m.SIMPLE_BLOCK, m.vint(1 << 40) + b"\0\0\x80abc")))
    slow = m.element(m.SEGMENT, m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m._uint(m.TRACK_NUMBER, 1) + m.element(m.DEFAULT_DURATION, b"\xff" * 8))) + m.element(m.CLUSTER, m._uint(m.TIMESTAMP, 1) + block))
    good = m.write(b"y" * 1200)
    rng = random.Random(5)
    noise = [bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in good) for _ in range(200)] + [rng.randbytes(rng.randrange(60)) for _ in range(200)]
    files = [late, far, slow, good, *noise]
    got = m.packet_table(spark.createDataFrame(list(enumerate(files)), "doc_id bigint, media binary").repartition(3)).collect()
    assert {r.doc_id for r in got if r.error is not None} >= {0, 1, 2} and [r.size for r in got if r.doc_id == 3] == [576, 576, 48]


def test_cues_that_lead_astray():
    data = m.write(b"z" * 576 * 600)
    p = m.parse(data)
    assert len(p.cues) == 3 and m.astray(p) == 0
    p.cues[1] = (p.cues[1][0], 1, p.cues[1][2] + 1)
    assert m.astray(p) == 1


def test_features_against_plain_values(docs):
    """Each column of the query from the payload and the stored bytes alone."""
    import zlib

    texts = {(r.doc_id, r.text) for r in docs.collect()}
    got = Counter(map(tuple, m.media_features(docs).select("doc_id", "tail_crc32", "media_bytes", "media_sha256", "feature").distinct().collect()))
    want = Counter()
    for key, text in texts:
        payload = (text or "").encode()
        payload += b"\xff" * (-len(payload) % 576 or (0 if payload else 576))
        data, n = m.write(payload), len(payload) // 576
        rest = [min(8, n - j) for k in range(0, n, 256) for j in range(k, min(k + 256, n), 8)]
        laced = [0, 0, 0, 0]
        for j, c in enumerate(rest):
            laced[0 if c == 1 else {0: m.FIXED, 1: m.EBML_LACE, 2: m.XIPH}[j % 3]] += c
        table, at = b"", 0
        for k in range(n):
            at = data.index(payload[576 * k:576 * k + 576], at)
            c, j = rest[k // 8], k // 8
            table += __import__("struct").pack("<qqqq?b", 1, 72_000_000 * k, at, 576, True, 0 if c == 1 else {0: m.FIXED, 1: m.EBML_LACE, 2: m.XIPH}[j % 3])
            at += 576
        line = f"type=matroska;tracks=1;packets={n};lacing={','.join(map(str, laced))};clusters={-(-n // 256)};cues={-(-n // 256)};astray=0;last_ns={72_000_000 * (n - 1)};bytes={len(payload)};table={zlib.crc32(table):08x}"
        want[(key, zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), line)] += 1
    assert got == want
