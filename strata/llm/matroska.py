"""Operator 6: Matroska media columns, parsed to packet tables.

``write`` stores a payload losslessly as one track of 8-bit PCM samples: frames laced into simple blocks (fixed
size, EBML and Xiph lacing in turn), clusters, and cues that point to each cluster. ``parse`` reads any Matroska
file of known or unknown element sizes: variable-length ids and sizes, nested masters, block groups, the four
kinds of lacing, cues. A packet has its track, timestamp (ns), byte range in the file, key-frame flag and lacing.

Defined results: a null text is stored like the empty one (576 bytes of 255); equal texts give equal files;
``packet_table`` gives no packets and an error text for a null or damaged file and never raises; repeated rows
are handled one by one; other columns aren't read; an empty table gives no rows.
Very long texts are held a few times over (payload, file, its parts), one at a time; copies of a text have equal values;
ties don't arise, as packets keep the file's order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .texts import map_texts

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, TRACK_ENTRY, TRACK_NUMBER, DEFAULT_DURATION = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
XIPH, FIXED, EBML_LACE = 1, 2, 3

FRAME, RATE, LACED, BLOCKS = 576, 8000, 8, 32


# ---- writing -------------------------------------------------------------------------------------------------

def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A size: seven bits a byte, the first byte's leading zeros give the width; all ones is kept for 'unknown'."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(i: int, body: bytes) -> bytes:
    return _id(i) + vint(len(body)) + body


def _uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(sizes: list[int], kind: int) -> bytes:
    """Number of frames less one, then the sizes of all but the last."""
    head = bytes([len(sizes) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == EBML_LACE:
        out = [vint(sizes[0])]
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out.append(vint(b - a + (1 << 7 * w - 1) - 1, w))
        return head + b"".join(out)
    return head


_HEAD = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_DURATION = FRAME * 1_000_000_000 // RATE  # ns of a frame: 72 ms


def write(payload: bytes) -> bytes:
    """A Matroska file whose one track's frames are the payload, FRAME bytes each (the last may be shorter)."""
    frames = [payload[i:i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, _uint(SCALE, 1_000_000) + element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"strata") + element(0x5741, b"strata"))
    audio = element(0xE1, element(0xB5, struct.pack(">d", RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(0x73C5, 1) + _uint(0x83, 2) + _uint(0x9C, 1) + _uint(DEFAULT_DURATION, _DURATION) + element(0x86, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    ms = _DURATION // 1_000_000
    for k in range(0, len(frames), LACED * BLOCKS):
        parts = [_uint(TIMESTAMP, k * ms)]
        for j in range(k, min(k + LACED * BLOCKS, len(frames)), LACED):
            group = frames[j:j + LACED]
            kind = 0 if len(group) == 1 else (FIXED, EBML_LACE, XIPH)[j // LACED % 3]
            if kind == FIXED and len({*map(len, group)}) > 1:
                kind = XIPH
            lace = _lace([*map(len, group)], kind) if kind else b""
            flags = 0x80 | {0: 0, XIPH: 0x02, FIXED: 0x04, EBML_LACE: 0x06}[kind]
            parts.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (j - k) * ms, flags) + lace + b"".join(group)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, k * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


# ---- reading -------------------------------------------------------------------------------------------------

@dataclass
class Parsed:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, int] = field(default_factory=dict)  # number: default duration in ns
    #: (track, timestamp ns, start, size, key frame, lacing)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # place after the segment's head
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, place of the cluster


def read_vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place); -1 for the size 'unknown'. keep: the length marker is part of an id."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    w = 9 - data[at].bit_length()
    if at + w > end:
        raise ValueError(f"a variable-length number is cut off at {at}")
    n = int.from_bytes(data[at:at + w], "big")
    if not keep:
        n ^= 1 << 7 * w
        if n == (1 << 7 * w) - 1:
            n = -1
    return n, at + w


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end of the body) of the elements in a range."""
    while at < end:
        i, at = read_vint(data, at, end, keep=True)
        size, at = read_vint(data, at, end)
        if size < 0:  # ends where an element begins that can't be inside
            stop = at
            if i == SEGMENT:
                stop = end
            else:
                while stop < end:
                    j, k = read_vint(data, stop, end, keep=True)
                    if j in TOP or j == i:
                        break
                    n, k = read_vint(data, k, end)
                    stop = k + n
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {i:x} ends at {stop}, beyond {end}")
        yield i, at, stop
        at = stop


def _block(data: bytes, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, lacing, frames' byte ranges)."""
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise ValueError("a block is cut off")
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, rel, flags, 0, [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed-size lacing doesn't divide the block")
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    else:
        for k in range(n - 1):
            first = at
            v, at = read_vint(data, at, end)
            w = at - first
            sizes.append(v if not k else sizes[-1] + v - ((1 << 7 * w - 1) - 1))
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a laced frame has a negative size")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, rel, flags, kind, out


def parse(data: bytes) -> Parsed:
    out = Parsed()
    number = lambda a, b: int.from_bytes(data[a:b], "big")

    def put(rel_to: int, a: int, b: int, key: bool | None, lasts: int = 0) -> None:
        track, rel, flags, kind, frames = _block(data, a, b)
        each = lasts * out.scale // len(frames) if lasts else out.tracks.get(track, 0)
        began = (rel_to + rel) * out.scale
        if track >= 1 << 31 or not 0 <= each < 1 << 53 or abs(began) + each * len(frames) >= 1 << 63:
            raise ValueError("a track number or timestamp is out of range")
        for k, (s, n) in enumerate(frames):
            out.packets.append((track, began + k * each, s, n, bool(flags & 0x80) if key is None else key, kind))

    for i, a, b in elements(data, 0, len(data)):
        if i == EBML:
            for j, c, d in elements(data, a, b):
                if j == DOC_TYPE:
                    out.doc_type = data[c:d].rstrip(b"\0").decode("ascii", "replace")
        elif i == SEGMENT:
            begin = a  # of the element, where its id stands
            for j, c, d in elements(data, a, b):
                if j == INFO:
                    for k, e, f in elements(data, c, d):
                        if k == SCALE:
                            out.scale = number(e, f)
                elif j == TRACKS:
                    for k, e, f in elements(data, c, d):
                        if k == TRACK_ENTRY:
                            own = {x: number(g, h) for x, g, h in elements(data, e, f) if x in (TRACK_NUMBER, DEFAULT_DURATION)}
                            out.tracks[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
                elif j == CLUSTER:
                    out.clusters.append(begin - a)
                    time = 0
                    for k, e, f in elements(data, c, d):
                        if k == TIMESTAMP:
                            time = number(e, f)
                        elif k == SIMPLE_BLOCK:
                            put(time, e, f, None)
                        elif k == BLOCK_GROUP:
                            own = {x: (g, h) for x, g, h in elements(data, e, f)}
                            if BLOCK in own:
                                put(time, *own[BLOCK], REFERENCE not in own, number(*own[BLOCK_DURATION]) if BLOCK_DURATION in own else 0)
                elif j == CUES:
                    for k, e, f in elements(data, c, d):
                        if k == CUE_POINT:
                            own = {x: (g, h) for x, g, h in elements(data, e, f)}
                            if CUE_TIME in own and CUE_POSITIONS in own:
                                pos = {x: number(g, h) for x, g, h in elements(data, *own[CUE_POSITIONS])}
                                out.cues.append((number(*own[CUE_TIME]), pos.get(CUE_TRACK, 0), pos.get(CUE_CLUSTER, 0)))
                begin = d
    return out


def astray(p: Parsed) -> int:
    """How many cues name a place where no cluster begins, or a track that there isn't."""
    begins = set(p.clusters)
    return sum(at not in begins or track not in p.tracks for _, track, at in p.cues)


def feature(p: Parsed) -> str:
    """A line on a packet table: counts, cues that lead astray, range of timestamps, lacing, a checksum of the whole table."""
    flat = zlib.crc32(b"".join(struct.pack("<qqqq?b", *x) for x in p.packets))
    laced = "".join(str(sum(x[5] == k for x in p.packets)) + "," for k in range(4))
    last = max((x[1] for x in p.packets), default=-1)
    return f"type={p.doc_type};tracks={len(p.tracks)};packets={len(p.packets)};lacing={laced[:-1]};clusters={len(p.clusters)};cues={len(p.cues)};astray={astray(p)};last_ns={last};bytes={sum(x[3] for x in p.packets)};table={flat:08x}"


# ---- operators -----------------------------------------------------------------------------------------------

def payload_of(text: str | None) -> tuple[int, bytes]:
    """Size of the UTF-8, and it with bytes 255 up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (FRAME * max(1, -(-len(raw) // FRAME)) - len(raw))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary) of every text."""
    return map_texts(docs, [("media", "binary", pa.binary())], lambda: lambda texts: [[write(payload_of(t)[1]) for t in texts]])


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each packet: key, packet, track, timestamp_ns, start, size, key_frame, lacing, error.
    A file that can't be read, or whose numbers are out of range, has one row with its error; one without packets has none."""
    kind = dict(media.dtypes)[key]
    schema = f"`{key}` {kind}, packet bigint, track int, timestamp_ns bigint, start bigint, size bigint, key_frame boolean, lacing int, error string"
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
    names = [key, "packet", "track", "timestamp_ns", "start", "size", "key_frame", "lacing", "error"]

    def table(data: bytes | None) -> list[pa.Array]:
        try:
            if data is None:
                raise ValueError("no file")
            packets = parse(data).packets
            cols = [range(len(packets)), *(zip(*packets, strict=True) if packets else [()] * 6), [None] * len(packets)]
            return [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
        except (ValueError, IndexError, OverflowError) as e:  # pyarrow's own errors are ValueErrors
            return [pa.array([None if k < 7 else str(e)], t) for k, t in enumerate(types)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                cols = table(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(cols[0]), pa.int64())), *cols], names=names)

    return media.select(key, column).mapInArrow(run, schema)


def _digest(text: str | None) -> tuple:
    size, payload = payload_of(text)
    media = write(payload)
    got = parse(media)
    view = memoryview(media)
    back = b"".join([view[s:s + n] for _, _, s, n, _, _ in got.packets])
    return size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(got)


def media_features(docs: DataFrame) -> DataFrame:
    columns = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()),
               ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]

    def make() -> Callable:
        return lambda texts: list(zip(*[_digest(t) for t in texts], strict=True))

    return map_texts(docs, columns, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))


QUERIES = {"op6_matroska": query}
ORACLES: dict = {}
