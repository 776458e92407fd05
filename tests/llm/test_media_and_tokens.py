"""Matroska round trips, SentencePiece and prefix counts against the library."""

import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import matroska as mk
from quantloom.llm import piece_bpe, tokencount

MODEL = piece_bpe.loaded(piece_bpe.default_model())


@given(st.binary(max_size=9000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    p = mk.padded(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data)
    m = mk.parse(mk.mux(p))
    assert mk.track_bytes(mk.mux(p), m) == p
    assert all(a.offset + a.size <= b.offset for a, b in zip(m.packets, m.packets[1:], strict=False))
    assert len(m.cues) == len(m.clusters) and all(c[2] in m.clusters for c in m.cues)


def test_round_trip_of_every_length():
    data = random.Random(6).randbytes(20_032)
    for n in range(64, len(data) + 1, 64):
        m = mk.parse(media := mk.mux(data[:n]))
        assert mk.track_bytes(media, m) == data[:n]
        assert sum(p.size for p in m.packets) == n


def test_foreign_layouts():
    """Unknown sizes, voids, all lacing kinds with odd sizes, negative times and reference blocks."""
    u, e = mk.unsigned, mk.element
    head = e(mk.EBML, e(mk.DOC_TYPE, b"webm"))
    track = e(mk.TRACKS, e(mk.TRACK_ENTRY, u(mk.TRACK_NUMBER, 2) + u(mk.TRACK_TYPE, 1) + e(mk.CODEC_ID, b"V_X") + u(mk.DEFAULT_DURATION, 40_000_000)))
    frames = [b"a" * 300, b"b" * 255, b"c", b"d" * 600]
    blocks = b"".join(e(mk.SIMPLE_BLOCK, b"\x82" + struct.pack(">hB", -1, k << 1) + mk.lace(frames, k)) for k in (1, 3))
    blocks += e(mk.SIMPLE_BLOCK, b"\x82" + struct.pack(">hB", 3, 4) + mk.lace([b"xy", b"zw"], 2))
    blocks += e(mk.BLOCK_GROUP, e(mk.BLOCK, b"\x82" + struct.pack(">hB", 4, 0) + b"q") + e(mk.REFERENCE_BLOCK, b"\xff"))
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\xff" + u(mk.TIMESTAMP, 10) + e(0xEC, b"\0" * 5) + blocks
    data = head + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + track + cluster + e(mk.CUES, b"")
    m = mk.parse(data)
    got = [data[p.offset : p.offset + p.size] for p in m.packets]
    assert got == frames + frames + [b"xy", b"zw", b"q"]
    assert [p.timestamp_ns for p in m.packets[:3]] == [9_000_000, 49_000_000, 89_000_000]
    assert m.packets[-1].keyframe is False and m.doc_type == "webm" and m.tracks[2].codec == "V_X"
    for cut in (3, 20, 60, len(data) - 700):
        with pytest.raises(mk.Damaged):
            mk.parse(data[:cut] + b"\0")


def test_damaged_media():
    """Whatever is done to the bytes, parsing gives packets inside them with times and tracks of 64 bits, or says Damaged."""
    r, e, u = random.Random(31), mk.element, mk.unsigned
    whole, parsed, damaged = mk.mux(r.randbytes(9_024)), 0, 0
    odd = [e(mk.EBML, b"") + e(mk.SEGMENT, e(mk.INFO, e(mk.DURATION, b"12345")))]
    odd += [e(mk.EBML, b"") + e(mk.SEGMENT, e(mk.INFO, u(mk.TIMESTAMP_SCALE, 1 << 60)) + e(mk.CLUSTER, u(mk.TIMESTAMP, 1 << 40) + e(mk.SIMPLE_BLOCK, b"\x81\0\0\0x")))]
    tiny = e(mk.AUDIO, e(mk.SAMPLING_FREQUENCY, struct.pack(">d", 5e-324)) + u(mk.CHANNELS, 1) + u(mk.BIT_DEPTH, 8))
    odd += [e(mk.EBML, b"") + e(mk.SEGMENT, e(mk.TRACKS, e(mk.TRACK_ENTRY, u(mk.TRACK_NUMBER, 1) + tiny)) + e(mk.CLUSTER, e(mk.SIMPLE_BLOCK, b"\x81\0\0\x04" + mk.lace([b"ab", b"cd"], 2))))]
    for case in range(3000 + len(odd)):
        data = bytearray(whole)
        for _ in range(r.randrange(1, 4)):
            at = r.choice([r.randrange(len(data)), r.randrange(300)])
            data[at] = r.randrange(256)
        data = odd[case - 3000] if case >= 3000 else bytes(data[: r.choice([len(data), r.randrange(len(data))])])
        try:
            m = mk.parse(data)
        except mk.Damaged:
            damaged += 1
            continue
        parsed += 1
        assert all(0 <= p.offset <= p.offset + p.size <= len(data) and abs(p.timestamp_ns) < 1 << 63 and 0 <= p.track < 1 << 63 for p in m.packets)
        assert mk.feature(m)
    assert parsed > 200 and damaged > 200
    for data in odd:
        with pytest.raises(mk.Damaged):
            mk.parse(data)


def test_media_operators(spark):
    rows = [(1, "x" * 5000), (2, None), (3, ""), (None, "ä" * 40), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as n_bytes", "1 as media_bytes")
    got = mk.media_features(df).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.n_bytes): r for r in got}
    media = {(r.doc_id, bytes(r.media)) for r in mk.to_media(df).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = by[i, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert any(i == k and (len(m), hashlib.sha256(m).hexdigest()) == (r.media_bytes, r.media_sha256) and payload[:64] in m for k, m in media)
    assert by[2, 0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() == by[3, 0].payload_sha256
    assert by[None, 80].payload_bytes == 128
    media = mk.to_media(df)
    table = mk.packet_table(media.unionByName(spark.createDataFrame([(9, b"junk"), (10, None), (11, mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(mk.INFO, mk.element(mk.DURATION, b"12345"))))], "doc_id bigint, media binary")))
    assert table.filter("doc_id = 1").selectExpr("sum(byte_size)").first()[0] == 5056
    assert table.filter("doc_id = 9").first().error and "float" in table.filter("doc_id = 11").first().error and table.filter("doc_id = 10").count() == 0
    assert mk.media_features(df.limit(0)).count() == 0


ALPHABET = ["a", "e", "n", " ", "  ", "\n", "\t", "▁", ".", ",", "12", "²", "ñ", "😀", "中", "́", "the", "ing", "<s>", "</s>", "<unk>", "<0x41>", "**", "'", "\x00", "�", " ", "\r"]


@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys(text):
    ids = MODEL.encode(text)
    assert ids == MODEL.library.encode(text)
    assert MODEL.decode(ids) == MODEL.library.decode(ids)
    counter = tokencount.counter(piece_bpe.default_model())
    assert counter.prefixes(text) == [len(MODEL.library.encode(text[:i])) for i in range(len(text) + 1)]
    for budget in (0, 1, 3, 7):
        best = max(i for i in range(len(text) + 1) if len(MODEL.library.encode(text[:i])) <= budget)
        assert counter.longest_prefix(counter.tables(text), budget) == best


@given(st.lists(st.integers(0, 31999), max_size=12))
@settings(max_examples=200, deadline=None)
def test_decoding_any_ids(ids):
    ids = [i for i in ids if i > 2]
    assert MODEL.decode(ids) == MODEL.library.decode(ids)


def test_token_operators(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choices("abc de.\n", k=r.choice([0, 5, 300])))) for i in range(40)] + [(None, None), (7, "again"), (8, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "'x' as ids")
    got = {(x.doc_id, x.n_tokens, x.ids_sha256) for x in piece_bpe.encode_documents(df).collect()}
    lib = {(i, len(k := MODEL.library.encode(t or "")), hashlib.sha256(",".join(map(str, k)).encode()).hexdigest()) for i, t in rows}
    assert got == lib
    counts = {(x.doc_id, x.n_bytes): x for x in tokencount.count_documents(df).collect()}
    assert {(k[0], v.n_tokens) for k, v in counts.items()} == {(i, n) for i, n, _ in lib}
    long = counts[8, 25000]
    assert long.over_limit and len(MODEL.library.encode(("word " * 5000)[: long.fit_chars])) <= 4096 < len(MODEL.library.encode(("word " * 5000)[: long.fit_chars + 2]))
    back = piece_bpe.decode_column(piece_bpe.encode_column(df.drop("ids", "n_tokens"), ("doc_id", "text")), "ids", ("text",)).filter("text is not null").collect()
    assert all(b.decoded == b.text for b in back)
    cut = {x.doc_id: x.n_tokens for x in tokencount.tokens_of_prefix(tokencount.prefix_tables(df.filter("doc_id < 7")), 10).collect()}
    assert cut == {i: len(MODEL.library.encode(t[:10])) for i, t in rows if i is not None and i < 7}
    assert piece_bpe.encode_documents(df.limit(0)).count() == 0 and tokencount.count_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        MODEL.check_chunks({"▁the": [1]})
