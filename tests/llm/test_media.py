import hashlib
import zlib

import pytest

from loomdex.llm import media
from tests.llm.cases import awkward


@pytest.mark.parametrize("n", [64, 128, 64 * 16, 64 * 256, 64 * 257, 64 * 1000])
def test_round_trip(n):
    payload = bytes((i * 7 + i // 64) % 256 for i in range(n))
    data = media.wrap(payload)
    found = media.probe(data)
    assert media.samples(data, found) == payload and found["codec"] == "raw " and found["handler"] == "vide"
    assert found["duration_s"] == n / 64 / media.TIMESCALE and found["keys"].tolist() == list(range(0, n // 64, media.KEY_EVERY))
    for k in found["keys"]:
        assert data[found["offsets"][k] : found["offsets"][k] + found["sizes"][k]] == payload[64 * k : 64 * k + 64]


def test_large_sizes_compact_sizes_and_all_keyframes():
    box = media._box
    import struct

    body = bytes(range(10)) + b"tail"
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    entry = box(b"mp4a", bytes(28))
    stbl = box(
        b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stts", struct.pack(">IIIIII", 0, 2, 1, 5, 2, 10)),
        box(b"stsc", struct.pack(">IIIIIIII", 0, 2, 1, 2, 1, 2, 1, 1)), box(b"stz2", struct.pack(">IBBBBI", 0, 0, 0, 0, 8, 3), bytes([3, 4, 3])),
        box(b"co64", struct.pack(">IIQQ", 0, 2, 16, 23)),
    )
    mdhd = box(b"mdhd", struct.pack(">IQQIQI", 1 << 24, 0, 0, 10, 25, 0))
    data = head + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl))))
    found = media.probe(data)
    assert found["offsets"].tolist() == [16, 19, 23] and found["sizes"].tolist() == [3, 4, 3] and found["keys"].tolist() == [0, 1, 2]
    assert found["duration_s"] == 2.5 and media.samples(data, found) == bytes(range(10))


def test_no_samples():
    import struct

    box, none = media._box, struct.pack(">II", 0, 0)
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), box(b"avc1", bytes(70))), *(box(k, none) for k in (b"stts", b"stsc", b"stco")), box(b"stsz", struct.pack(">III", 0, 0, 0)))
    mdhd = box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 90_000, 0, 0))
    found = media.probe(box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))))
    assert found["codec"] == "avc1" and len(found["offsets"]) == len(found["keys"]) == 0 and media.samples(b"", found) == b""


def fragmented():
    """A video track with samples in the table and two fragments, and an audio track in fragments alone."""
    import struct

    box, none = media._box, struct.pack(">II", 0, 0)
    empty = [*(box(k, none) for k in (b"stts", b"stsc", b"stco")), box(b"stsz", struct.pack(">III", 0, 0, 0))]
    table = lambda codec, rest: box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), box(codec, bytes(28))), *rest)
    head = box(b"ftyp", b"iso5" + bytes(4))
    first = box(b"mdat", b"AAABB")
    own = [box(b"stts", struct.pack(">IIII", 0, 1, 2, 10)), box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2, 1)), box(b"stco", struct.pack(">III", 0, 1, len(head) + 8)), box(b"stsz", struct.pack(">IIIII", 0, 0, 2, 3, 2)), box(b"stss", struct.pack(">III", 0, 1, 1))]

    def trak(number, kind, codec, rest):
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 10, 0, 0)), box(b"hdlr", struct.pack(">I4s4s12xB", 0, b"mhlr", kind, 0)), box(b"minf", table(codec, rest)))
        return box(b"trak", box(b"tkhd", struct.pack(">IIII", 7, 0, 0, number) + bytes(68)), mdia)

    trex = [box(b"trex", struct.pack(">IIIIII", 0, n, 1, d, z, f)) for n, d, z, f in ((1, 5, 4, 0x10000), (2, 20, 6, 0))]
    moov = box(b"moov", trak(1, b"vide", b"avc1", own), trak(2, b"soun", b"mp4a", empty), box(b"mvex", *trex))
    data = head + first + moov

    def moof(offset):
        video = box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), box(b"trun", struct.pack(">IIiIII", 0x205, 2, offset, 0, 7, 1)), box(b"trun", struct.pack(">II", 0, 1)))
        audio = box(b"traf", box(b"tfhd", struct.pack(">III", 0x20008, 2, 30)), box(b"trun", struct.pack(">IIi", 1, 2, offset + 12)))
        return box(b"moof", video, audio)

    size = len(moof(0))
    frag = moof(size + 8) + box(b"mdat", b"vvvvvvvwxxxxaaaaaabbbbbb")
    return data + frag, len(data) + size + 8, len(head) + 8


def test_fragments_and_all_tracks(spark):
    data, at, table = fragmented()
    video, audio = media.tracks(data)
    assert video["offsets"].tolist() == [table, table + 3, at, at + 7, at + 8] and video["sizes"].tolist() == [3, 2, 7, 1, 4] and video["keys"].tolist() == [0, 2]
    assert media.samples(data, video) == b"AAABBvvvvvvvwxxxx" and video["duration_s"] == (20 + 15) / 10
    assert media.samples(data, audio) == b"aaaaaabbbbbb" and audio["keys"].tolist() == [0, 1] and audio["duration_s"] == 6.0 and audio["codec"] == "mp4a"
    rows = spark.createDataFrame([(data, 1, 2), (data[:-3], 1, 2)], "media binary, probed int, probed_codec int")
    a, b = media.probe_media(rows).collect()
    assert a.probed_codec == 2 and [(t.codec, t.handler, t.n_samples) for t in a.probed.tracks] == [("avc1", "vide", 5), ("mp4a", "soun", 2)]
    assert [tuple(k) for k in a.probed.keyframes] == [(table, 3), (at, 7)] and b.probed.media_error and b.probed.tracks is None


def test_broken_media(spark):
    good = media.wrap(b"a" * 64)
    bad = [None, b"", b"abc", b"\0\0\0\x05moov", good[:-20], good.replace(b"stco", b"xxxx"), b"\0\0\0\x08moov" * 3, good[:40] + b"\xff" * 30 + good[70:]]
    deep = b""
    for _ in range(40):
        deep = media._box(b"moov", deep)
    rows = media.probe_media(spark.createDataFrame([(i, x, "y") for i, x in enumerate([good, *bad, deep])], "i int, media binary, codec string")).collect()
    assert len(rows) == len(bad) + 2
    for r in rows:
        assert (r.probed.codec == "raw ") == (r.probed.media_error is None) and r.codec == "y"
        assert r.i != 0 or r.probed.media_error is None
        assert r.i in (0, 8) or r.probed.media_error


def test_digest(spark):
    df = awkward(spark)
    rows = media.media_digest(df).collect()
    texts = sorted((r.doc_id or 0, (r.text or "").encode()) for r in df.collect())
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in rows)
    for (i, t), g in zip(texts, got, strict=True):
        payload = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        stored = media.wrap(payload)
        n = len(payload) // 64
        keys = range(0, n, media.KEY_EVERY)
        start = stored.index(b"mdat") + 4
        said = f"codec=raw;samples={n};duration_s={n / media.TIMESCALE:.3f};keyframes={len(keys)};first_last={start}+64,{start + 64 * keys[-1]}+64"
        assert g == (i, len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), said)
    assert media.media_digest(df.limit(0)).count() == 0
