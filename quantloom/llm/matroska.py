"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues, as packet tables.

`mux` stores a byte payload as 8-bit PCM frames in a Matroska file, `parse` reads any Matroska bytes into
`Media` (tracks, packets, cues), `packet_table` is the DataFrame operator with a row for each packet, and
`media_features` does the round trip of a text column. Everything is narrow: no shuffle, and a task holds
one slice of rows.

Defined cases: a null or empty text is a payload of 64 zero bytes; a null media value has no packet rows;
damaged media gives one row whose `error` is set; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_or_empty

# Element IDs of the Matroska specification (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
LACING = ("none", "xiph", "fixed", "ebml")

RATE = 8000  # samples (bytes) a second of the stored track
FRAME_SIZES = (512, 256, 768, 1024)
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 4, 16


def encode_size(n: int, width: int = 0) -> bytes:
    """An EBML size of the least width that holds it (all ones are left for "unknown")."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def encode_signed(n: int) -> bytes:
    """The signed difference of EBML lacing: biased by half the range of its width."""
    width = next(w for w in range(1, 9) if abs(n) <= (1 << 7 * w - 1) - 1)
    return encode_size(n + (1 << 7 * width - 1) - 1, width)


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + encode_size(len(data)) + data


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frame count and sizes of a laced block, then the frames."""
    if kind == 0:
        return frames[0]
    head = bytearray([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if kind == 1:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == 3 and len(sizes) > 1:  # the size of the last frame, and so of a single one, isn't stored
        head += encode_size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            head += encode_signed(b - a)
    return bytes(head) + b"".join(frames)


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """A Matroska file with one 8-bit PCM track: frames of changing sizes, laced in all four ways, in
    clusters that a cue each points to."""
    frames, at, i = [], 0, 0
    while at < len(payload):
        n = FRAME_SIZES[i % len(FRAME_SIZES)]
        frames.append((at, payload[at : at + n]))
        at, i = at + n, i + 1
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    track = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate))), element(TRACKS, element(TRACK_ENTRY, track))]
    place, cues, block_no, k = sum(map(len, parts)), [], 0, 0
    while k < len(frames):
        start = frames[k][0] * 1000 // rate
        body = [unsigned(TIMESTAMP, start)]
        for _ in range(BLOCKS_PER_CLUSTER):
            if k >= len(frames) or (when := frames[k][0] * 1000 // rate - start) > 30_000:
                break
            kind = block_no % 4
            group = [x for _, x in frames[k : k + (FRAMES_PER_BLOCK if kind else 1)]]
            if kind == 2:  # only frames of one size can share a block of this kind
                group = group[:1] if len(group) < 2 or len(group[0]) != len(group[1]) else group[:2]
            block = b"\x81" + struct.pack(">h", when)
            if block_no % 8 == 5:
                took = sum(map(len, group)) * 1000 // rate
                body.append(element(BLOCK_GROUP, element(BLOCK, block + bytes([kind << 1 if kind != 2 else 4]) + lace(group, kind)) + unsigned(BLOCK_DURATION, took)))
            else:
                flags = 0x80 | (0, 2, 4, 6)[kind]
                body.append(element(SIMPLE_BLOCK, block + bytes([flags]) + lace(group, kind)))
            k, block_no = k + len(group), block_no + 1
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, place))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Packet:
    track: int
    cluster: int
    block: int
    frame: int
    timestamp_ns: int
    offset: int
    size: int
    lacing: str
    keyframe: bool


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bit_depth: int = 0
    default_duration: int = 0


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, place of the cluster in the file
    clusters: list[int] = field(default_factory=list)  # places in the file


class Damaged(ValueError):
    """The bytes are not well-formed Matroska."""


def _vint(buf: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    if at >= end:
        raise Damaged(f"element cut off at {at}")
    first = buf[at]
    if not first:
        raise Damaged(f"bad length byte at {at}")
    width = 9 - first.bit_length()
    if at + width > end:
        raise Damaged(f"element cut off at {at}")
    n = int.from_bytes(buf[at : at + width], "big")
    return (n if keep else n ^ (1 << 7 * width)), width


def _elements(buf: bytes, at: int, end: int, parent: int = 0):
    """(id, place, data start, data end) of each child; an unknown size lasts to the next element that
    can't be inside it."""
    while at < end:
        ident, w = _vint(buf, at, end, True)
        n, s = _vint(buf, at + w, end, False)
        start = at + w + s
        if n == (1 << 7 * s) - 1:
            if ident == SEGMENT:
                stop = end
            elif ident == CLUSTER:
                stop = _unknown_end(buf, start, end)
            else:
                raise Damaged(f"unknown size of element {ident:X} at {at}")
        else:
            stop = start + n
        if stop > end:
            raise Damaged(f"element {ident:X} at {at} ends after its parent")
        yield ident, at, start, stop
        at = stop


def _unknown_end(buf: bytes, at: int, end: int) -> int:
    while at < end:
        ident, w = _vint(buf, at, end, True)
        if ident in TOP_LEVEL or ident in (SEGMENT, EBML):
            return at
        n, s = _vint(buf, at + w, end, False)
        at += w + s + n
    return end


def _uint(buf: bytes, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def _float(buf: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise Damaged(f"float of {b - a} bytes at {a}")
    return struct.unpack(">f" if b - a == 4 else ">d", buf[a:b])[0] if b > a else 0.0


def _frames(buf: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Place and size of each frame of a block whose header ends at `at`."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise Damaged(f"laced block cut off at {at}")
    count, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise Damaged(f"lace sizes cut off at {at}")
                n, at = n + buf[at], at + 1
                if buf[at - 1] != 255:
                    break
            sizes.append(n)
    elif kind == 3:
        for i in range(count - 1):
            n, w = _vint(buf, at, end, False)
            sizes.append(n if i == 0 else sizes[-1] + n - ((1 << 7 * w - 1) - 1))
            at += w
    else:
        if (end - at) % count:
            raise Damaged(f"frames of a fixed-size lace don't fill the block at {at}")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lace sizes exceed the block at {at}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(buf: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file. Raises Damaged where it isn't one."""
    m, seen = Media(), False
    for ident, _, a, b in _elements(buf, 0, len(buf)):
        if ident == EBML:
            seen = True
            m.doc_type = next((buf[c:d].rstrip(b"\0").decode("ascii", "replace") for i, _, c, d in _elements(buf, a, b) if i == DOC_TYPE), "matroska")
        elif ident == SEGMENT:
            _segment(buf, a, b, m)
    if not seen:
        raise Damaged("no EBML header")
    return m


def _segment(buf: bytes, start: int, end: int, m: Media) -> None:
    for ident, place, a, b in _elements(buf, start, end):
        if ident == INFO:
            for i, _, c, d in _elements(buf, a, b):
                if i == TIMESTAMP_SCALE:
                    m.scale = _uint(buf, c, d)
                elif i == DURATION:
                    m.duration = _float(buf, c, d)
        elif ident == TRACKS:
            for i, _, c, d in _elements(buf, a, b):
                if i == TRACK_ENTRY:
                    t = _track(buf, c, d)
                    m.tracks[t.number] = t
        elif ident == CLUSTER:
            m.clusters.append(place)
            _cluster(buf, a, b, m)
        elif ident == CUES:
            for i, _, c, d in _elements(buf, a, b):
                if i == CUE_POINT:
                    m.cues += _cue(buf, c, d, start)


def _track(buf: bytes, a: int, b: int) -> Track:
    t = Track()
    for i, _, c, d in _elements(buf, a, b):
        if i == TRACK_NUMBER:
            t.number = _uint(buf, c, d)
        elif i == TRACK_TYPE:
            t.kind = _uint(buf, c, d)
        elif i == CODEC_ID:
            t.codec = buf[c:d].rstrip(b"\0").decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            t.default_duration = _uint(buf, c, d)
        elif i == AUDIO:
            for j, _, e, f in _elements(buf, c, d):
                if j == SAMPLING_FREQUENCY:
                    t.rate = _float(buf, e, f)
                elif j == CHANNELS:
                    t.channels = _uint(buf, e, f)
                elif j == BIT_DEPTH:
                    t.bit_depth = _uint(buf, e, f)
    return t


def _cue(buf: bytes, a: int, b: int, segment: int) -> list[tuple[int, int, int]]:
    when, spots = 0, []
    for i, _, c, d in _elements(buf, a, b):
        if i == CUE_TIME:
            when = _uint(buf, c, d)
        elif i == CUE_TRACK_POSITIONS:
            got = {j: _uint(buf, e, f) for j, _, e, f in _elements(buf, c, d)}
            spots.append((got.get(CUE_TRACK, 0), segment + got.get(CUE_CLUSTER_POSITION, 0)))
    return [(when, t, p) for t, p in spots]


def _cluster(buf: bytes, start: int, end: int, m: Media) -> None:
    base, no, block = 0, len(m.clusters) - 1, 0
    for i, _, a, b in _elements(buf, start, end):
        if i == TIMESTAMP:
            base = _uint(buf, a, b)
        elif i == SIMPLE_BLOCK:
            _block(buf, a, b, m, base, no, block, None)
            block += 1
        elif i == BLOCK_GROUP:
            inner = {j: (c, d) for j, _, c, d in _elements(buf, a, b)}
            if BLOCK in inner:
                _block(buf, *inner[BLOCK], m, base, no, block, REFERENCE_BLOCK not in inner)
                block += 1


def _block(buf: bytes, a: int, b: int, m: Media, base: int, cluster: int, block: int, key: bool | None) -> None:
    track, w = _vint(buf, a, b, False)
    if a + w + 3 > b:
        raise Damaged(f"block cut off at {a}")
    when, flags = struct.unpack(">hB", buf[a + w : a + w + 3])
    kind = flags >> 1 & 3
    t = m.tracks.get(track)
    for k, (at, n) in enumerate(_frames(buf, a + w + 3, b, kind)):
        if k == 0:
            ns = (base + when) * m.scale
        if abs(ns) >= 1 << 63:
            raise Damaged(f"time of the block at {a} is beyond 64 bits of nanoseconds")
        m.packets.append(Packet(track, cluster, block, k, ns, at, n, LACING[kind], bool(flags & 0x80) if key is None else key))
        if t and t.default_duration:
            ns += t.default_duration
        elif t and t.bit_depth >= 8 and t.rate > 0:  # frames of PCM say how long they last
            last = n * 1_000_000_000 / (t.rate * max(1, t.channels) * (t.bit_depth // 8))
            ns += round(last) if last < 1 << 63 else 1 << 63


def track_bytes(buf: bytes, m: Media, track: int = 1) -> bytes:
    return b"".join([buf[p.offset : p.offset + p.size] for p in m.packets if p.track == track])


def feature(m: Media) -> str:
    """Clusters, packets, cues that hit a cluster, lacing kinds, time span and byte range in one line."""
    kinds = {k: 0 for k in LACING}
    for p in m.packets:
        kinds[p.lacing] += 1
    places = set(m.clusters)
    last = max(m.packets, key=lambda p: (p.timestamp_ns, p.offset), default=None)
    return ";".join(
        [f"type={m.doc_type}", f"tracks={len(m.tracks)}", f"clusters={len(m.clusters)}", f"packets={len(m.packets)}", f"cues={sum(c[2] in places for c in m.cues)}/{len(m.cues)}"]
        + [f"{k}={n}" for k, n in kinds.items()]
        + [f"largest={max((p.size for p in m.packets), default=0)}", f"last_ns={last.timestamp_ns if last else 0}", f"duration_ms={m.duration:.3f}", f"key={sum(p.keyframe for p in m.packets)}"]
    )


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def packet_table(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each packet of each media value: key, track, codec, cluster, block, frame, timestamp_ns,
    byte_offset, byte_size, lacing, keyframe, error."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        names = ("key", "track", "codec", "cluster", "block", "frame", "timestamp_ns", "byte_offset", "byte_size", "lacing", "keyframe", "error")

        def rows(cols):
            out = []
            for k, data in zip(cols["key"], cols["media"], strict=True):
                if data is None:
                    continue
                try:
                    m = parse(bytes(data))
                except Damaged as e:
                    out.append((k, *[None] * 10, str(e)))
                    continue
                out += [(k, p.track, m.tracks[p.track].codec if p.track in m.tracks else None, p.cluster, p.block, p.frame, p.timestamp_ns, p.offset, p.size, p.lacing, p.keyframe, None) for p in m.packets]
            return dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

        return rows

    schema = f"key {kind}, track bigint, codec string, cluster int, block int, frame int, timestamp_ns bigint, byte_offset bigint, byte_size bigint, lacing string, keyframe boolean, error string"
    return map_rows(df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media")), make, schema, 64).withColumnRenamed("key", key)


def to_media(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "media") -> DataFrame:
    """Key and the Matroska bytes that store the padded UTF-8 text."""
    kind = df.schema[key].dataType.simpleString()
    make = lambda: lambda cols: {"key": cols["key"], "media": [mux(padded(t.encode())) for t in cols["text"]]}
    return map_rows(df.select(F.col(key).alias("key"), text_or_empty(text).alias("text")), make, f"key {kind}, media binary", 64).toDF(key, out)


def media_features(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, packets:
    the text stored as Matroska, parsed again, and digested from what was read back."""

    def make():
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets")

        def rows(cols):
            out = []
            for k, text in zip(cols["doc_id"], cols["text"], strict=True):
                data = text.encode()
                payload = padded(data)
                media = mux(payload)
                m = parse(media)
                back = track_bytes(media, m)
                if back != payload:
                    raise ValueError(f"the media of document {k} doesn't give its {len(payload)} bytes back")
                out.append((k, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(m), len(m.packets)))
            return dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}

        return rows

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, packets bigint"
    return map_rows(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), make, schema)
