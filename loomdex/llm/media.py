"""Media columns: ISO media containers walked box by box; sample tables decoded, payloads left alone.

``probe`` reads structure only (codec, duration, sample and keyframe byte ranges).
``wrap`` stores raw 8-bit frames in such a container, ``samples`` reads them back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Boxes that hold further boxes (fixed by the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
MAX_DEPTH = 16
FRAME = 64  # bytes of an 8x8 picture of 8-bit samples
KEY_EVERY = 16
FRAMES_PER_CHUNK = 256
TIMESCALE = 25


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first body byte, end) of each box in data[start:end]; ValueError where sizes don't fit."""
    at = start
    while at < end:
        if end - at < 8:
            raise ValueError(f"{end - at} bytes where a box was due")
        size, kind, body = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("large size cut off")
            size, body = int.from_bytes(data[at + 8 : at + 16], "big"), at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes does not fit")
        yield kind, body, at + size
        at += size


def _tree(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[bytes, int, int, list]]:
    if depth > MAX_DEPTH:
        raise ValueError("boxes nested too deeply")
    return [(k, b, e, _tree(data, b, e, depth + 1) if k in CONTAINERS else []) for k, b, e in boxes(data, start, end)]


def _find(tree: list, *path: bytes):
    for kind in path:
        node = next((n for n in tree if n[0] == kind), None)
        if node is None:
            return None
        tree = node[3]
    return node


def _table(data: bytes, node, dtype: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """Entries of a full box: version and flags, a count, then rows of big-endian numbers."""
    at = node[1] + skip
    count = int.from_bytes(data[at : at + 4], "big")
    width = np.dtype(dtype).itemsize * columns
    if at + 4 + count * width > node[2]:
        raise ValueError(f"table {node[0]!r} is cut off")
    return np.frombuffer(data, dtype, count * columns, at + 4).astype(np.int64).reshape(count, columns)


def _clock(data: bytes, node) -> tuple[int, int]:
    """Time scale and duration of mvhd or mdhd, in either version."""
    return struct.unpack_from(">16xIQ" if data[node[1]] == 1 else ">8xII", data, node[1] + 4)


def _sizes(data: bytes, stbl: list) -> np.ndarray:
    if node := _find(stbl, b"stsz"):
        fixed, count = struct.unpack_from(">II", data, node[1] + 4)
        if fixed * count > len(data):
            raise ValueError("more sample bytes than the file has")
        return np.full(count, fixed, np.int64) if fixed else _table(data, node, ">u4", skip=8)[:, 0]
    node = _find(stbl, b"stz2")
    if not node:
        raise ValueError("no sample sizes")
    bits, count = data[node[1] + 7], int.from_bytes(data[node[1] + 8 : node[1] + 12], "big")
    raw = np.frombuffer(data, np.uint8, -(-count * bits // 8), node[1] + 12)
    if bits == 4:
        raw = np.stack([raw >> 4, raw & 15], 1).ravel()
    elif bits == 16:
        raw = raw.view(">u2")
    return raw[:count].astype(np.int64)


def track(data: bytes, trak: list) -> dict:
    """One track: codec, duration in seconds, and byte ranges of its samples and keyframes."""
    stbl_node = _find(trak, b"mdia", b"minf", b"stbl")
    mdhd, hdlr = _find(trak, b"mdia", b"mdhd"), _find(trak, b"mdia", b"hdlr")
    if not stbl_node or not mdhd:
        raise ValueError("track without sample table")
    stbl = stbl_node[3]
    scale, _ = _clock(data, mdhd)
    stsd = _find(stbl, b"stsd")
    entry = next(boxes(data, stsd[1] + 8, stsd[2]), None) if stsd else None
    stts, stsc = _find(stbl, b"stts"), _find(stbl, b"stsc")
    if entry is None or not stts or not stsc:
        raise ValueError("sample table is incomplete")
    sizes, times = _sizes(data, stbl), _table(data, stts, ">u4", 2)
    chunks = _table(data, n, ">u4") if (n := _find(stbl, b"stco")) else _table(data, n, ">u8") if (n := _find(stbl, b"co64")) else None
    if chunks is None:
        raise ValueError("no chunk offsets")
    runs, chunks = _table(data, stsc, ">u4", 3), chunks[:, 0]
    per = np.zeros(len(chunks), np.int64)
    for (first, count, _), after in zip(runs, [*runs[1:, 0], len(chunks) + 1], strict=False):
        per[first - 1 : after - 1] = count
    if per.sum() != len(sizes) or times[:, 0].sum() != len(sizes):
        raise ValueError("sample counts disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    chunk = np.repeat(np.arange(len(chunks)), per)
    offsets = chunks[chunk] + before - before[np.minimum(first, max(len(sizes) - 1, 0))][chunk] if len(sizes) else np.zeros(0, np.int64)
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    stss = _find(stbl, b"stss")
    keys = _table(data, stss, ">u4")[:, 0] - 1 if stss else np.arange(len(sizes))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise ValueError("a keyframe number is out of range")
    return {
        "codec": entry[0].decode("latin-1"),
        "handler": data[hdlr[1] + 8 : hdlr[1] + 12].decode("latin-1") if hdlr else None,
        "duration_s": float((times[:, 0] * times[:, 1]).sum() / scale) if scale else 0.0,
        "offsets": offsets, "sizes": sizes, "keys": keys, "scale": scale,
    }


def _number(data: bytes, trak: list) -> int:
    """The track's number, by which fragments name it; 0 without a header."""
    tkhd = _find(trak, b"tkhd")
    return struct.unpack_from(">I", data, tkhd[1] + (20 if data[tkhd[1]] == 1 else 12))[0] if tkhd else 0


def _run(data: bytes, node, base: int, at: int, duration: int, size: int, flags: int) -> dict[str, np.ndarray]:
    """Samples of one trun: where they lie, durations, flags. Without an offset of its own it goes on at ``at``."""
    given, (count,), place = int.from_bytes(data[node[1] + 1 : node[1] + 4], "big"), struct.unpack_from(">I", data, node[1] + 4), node[1] + 8
    if given & 1:
        at, place = base + struct.unpack_from(">i", data, place)[0], place + 4
    first = None
    if given & 4:
        first, place = struct.unpack_from(">I", data, place)[0], place + 4
    columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
    if place + 4 * count * len(columns) > node[2] or count > len(data):
        raise ValueError("a fragment's run is cut off")
    rows = np.frombuffer(data, ">u4", count * len(columns), place).astype(np.int64).reshape(count, len(columns))
    column = lambda bit, other: rows[:, columns.index(bit)] if bit in columns else np.full(count, other, np.int64)
    sizes, kinds = column(0x200, size), column(0x400, flags).copy()
    if first is not None and count:
        kinds[0] = first
    return {"offsets": at + np.cumsum(sizes) - sizes, "sizes": sizes, "durations": column(0x100, duration), "kinds": kinds, "end": at + int(sizes.sum())}


def _fragments(data: bytes, tree: list, mvex: list) -> dict[int, list[dict]]:
    """Runs of samples in moof boxes, by track number. trex has what a fragment leaves out."""
    usual = {n[0]: n[1:] for n in (struct.unpack_from(">I4xIII", data, t[1] + 4) for t in mvex if t[0] == b"trex")}
    out: dict[int, list[dict]] = {}
    for node, begin in zip(tree, [0, *(n[2] for n in tree[:-1])], strict=True):
        if node[0] != b"moof":
            continue
        end = begin
        for traf in (n for n in node[3] if n[0] == b"traf"):
            tfhd = _find(traf[3], b"tfhd")
            if not tfhd:
                raise ValueError("a fragment without header")
            given, (number,), place = int.from_bytes(data[tfhd[1] + 1 : tfhd[1] + 4], "big"), struct.unpack_from(">I", data, tfhd[1] + 4), tfhd[1] + 8
            base = begin if given & 0x20000 or end == begin else end
            if given & 1:
                base, place = struct.unpack_from(">Q", data, place)[0], place + 8
            place += 4 * bool(given & 2)
            defaults = list(usual.get(number, (0, 0, 0)))
            for i, bit in enumerate((8, 0x10, 0x20)):
                if given & bit:
                    defaults[i], place = struct.unpack_from(">I", data, place)[0], place + 4
            end = base
            for trun in (n for n in traf[3] if n[0] == b"trun"):
                run = _run(data, trun, base, end, *defaults)
                end = run["end"]
                out.setdefault(number, []).append(run)
    return out


def tracks(data: bytes) -> list[dict]:
    """All tracks of a container, samples of fragments behind those of the sample table; ValueError if the bytes are not one."""
    try:
        tree = _tree(data, 0, len(data))
        moov = _find(tree, b"moov")
        traks = [n[3] for n in (moov[3] if moov else []) if n[0] == b"trak"]
        if not traks:
            raise ValueError("no track")
        mvex = _find(moov[3], b"mvex")
        pieces = _fragments(data, tree, mvex[3] if mvex else [])
        out = []
        for trak in traks:
            t = track(data, trak)
            for run in pieces.get(_number(data, trak), []):
                if len(run["sizes"]) and (run["offsets"].min() < 0 or run["end"] > len(data)):
                    raise ValueError("a sample lies outside the file")
                t["keys"] = np.r_[t["keys"], len(t["sizes"]) + np.flatnonzero(run["kinds"] & 0x10000 == 0)]
                t["offsets"], t["sizes"] = np.r_[t["offsets"], run["offsets"]], np.r_[t["sizes"], run["sizes"]]
                t["duration_s"] += float(run["durations"].sum() / t["scale"]) if t["scale"] else 0.0
            out.append(t)
        return out
    except (struct.error, IndexError) as e:
        raise ValueError(f"cut off: {e}") from e


def probe(data: bytes) -> dict:
    """The first track of a container; ValueError if the bytes are not one."""
    return tracks(data)[0]


def samples(data: bytes, found: dict) -> bytes:
    """The stored bytes, read through the sample table."""
    view = memoryview(data)
    offsets, sizes = found["offsets"], found["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1  # one read for neighbours
    starts, ends = np.r_[0, breaks], np.r_[breaks, len(offsets)] - 1
    return b"".join(view[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(starts, ends, strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def wrap(payload: bytes) -> bytes:
    """Frames of 64 8-bit samples (8x8 grey) as an uncompressed video track, every 16th frame a keyframe."""
    if len(payload) % FRAME or not payload:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // FRAME
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    mdat = _box(b"mdat", payload)
    start = len(head) + len(mdat) - len(payload)
    full, rest = divmod(n, FRAMES_PER_CHUNK)
    chunks = start + FRAME * FRAMES_PER_CHUNK * np.arange(full + bool(rest), dtype=np.int64)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    keys = np.arange(1, n + 1, KEY_EVERY)
    wide = chunks[-1] >= 2**32
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", struct.pack(">6xH16xHHIIIH32xHh", 1, 8, 8, 72 << 16, 72 << 16, 0, 1, 40, -1))
    stbl = _box(
        b"stbl",
        _box(b"stsd", struct.pack(">II", 0, 1), entry),
        _box(b"stts", struct.pack(">IIII", 0, 1, n, 1)),
        _box(b"stss", struct.pack(">II", 0, len(keys)), keys.astype(">u4").tobytes()),
        _box(b"stsc", struct.pack(">II", 0, len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        _box(b"stsz", struct.pack(">III", 0, FRAME, n)),
        _box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(b"minf", _box(b"vmhd", struct.pack(">I8x", 1)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
    mdia = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, TIMESCALE, n, 0, 0)), _box(b"hdlr", struct.pack(">I4s4s12xB", 0, b"mhlr", b"vide", 0)), minf)
    trak = _box(b"trak", _box(b"tkhd", struct.pack(">IIIIIII8xhhhH", 7, 0, 0, 1, 0, n, 0, 0, 0, 0, 0)[:-4], struct.pack(">HH", 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16)), mdia)
    mvhd = _box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, TIMESCALE, n, 0x10000, 0x100), matrix, struct.pack(">24xI", 2))
    return head + mdat + _box(b"moov", mvhd, trak)


def feature(found: dict, data: bytes) -> str:
    keys, offsets, sizes = found["keys"], found["offsets"], found["sizes"]
    spans = [f"{offsets[k]}+{sizes[k]}" for k in (*keys[:1], *keys[-1:])]
    return f"codec={found['codec'].strip()};samples={len(sizes)};duration_s={found['duration_s']:.3f};keyframes={len(keys)};first_last={','.join(spans)}"


SPANS = "array<struct<start:long,length:long>>"
FIELDS = f"codec string, handler string, duration_s double, n_samples long, keyframes {SPANS}, feature string, payload binary, media_error string, tracks array<struct<codec:string,handler:string,duration_s:double,n_samples:long,keyframes:{SPANS}>>"


def _probed(data: bytes | None, with_payload: bool) -> dict:
    """Null or broken media give nulls and the reason."""
    try:
        if data is None:
            raise ValueError("null")
        every = tracks(data)
    except ValueError as e:
        return {"media_error": str(e)}
    told = []
    for t in every:
        k = t["keys"]
        spans = [{"start": int(a), "length": int(b)} for a, b in zip(t["offsets"][k], t["sizes"][k], strict=True)]
        told.append({"codec": t["codec"], "handler": t["handler"], "duration_s": t["duration_s"], "n_samples": len(t["sizes"]), "keyframes": spans})
    return {**told[0], "feature": feature(every[0], data), "payload": samples(data, every[0]) if with_payload else None, "tracks": told}


def probe_media(df: DataFrame, media: str = "media", with_payload: bool = False) -> DataFrame:
    """``df`` plus a struct ``probed`` (FIELDS) for its binary column ``media``: the first track's figures, and those of all ``tracks``.

    A column ``probed`` of ``df`` gives way, others keep their names, whatever they are. Null, empty or broken media: nulls and ``media_error``. No shuffle; one row in, one row out;
    memory is that of one Arrow batch. Payload bytes are read back only if asked for.
    """
    from pyspark.sql.types import StructField, StructType

    probed_type = StructType.fromDDL(FIELDS)
    names = probed_type.names
    keep = [c for c in df.columns if c != "probed" or c == media]
    df = df.select(*keep)
    mark = "probed_"
    while any(c.lower().startswith(mark) for c in keep):
        mark = "_" + mark

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in probed_type.fields]
        for b in batches:
            for part in range(0, b.num_rows, 512):
                cut = b.slice(part, 512)
                rows = [_probed(x, with_payload) for x in cut.column(cut.schema.get_field_index(media)).to_pylist()]
                made = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in range(len(keep))), *made], [*keep, *(mark + n for n in names)])

    flat = df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(mark + f.name, f.dataType) for f in probed_type.fields)]))
    return flat.select(*keep, F.struct(*(F.col(mark + n).alias(n) for n in names)).alias("probed"))


def store_text(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty), zero-padded to 64 bytes, in a container. Repeated rows stay."""

    def run(batches):
        import pyarrow as pa

        from loomdex.llm.common import binary_column

        for b in batches:
            for part in range(0, b.num_rows, 512):
                cut = b.slice(part, 512)
                texts = [x or b"" for x in binary_column(cut, "text")]
                media = [wrap(x.ljust(max(FRAME, -(-len(x) // FRAME) * FRAME), b"\0")) for x in texts]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Texts stored, probed and read back; digests are taken by Spark's own functions.

    Null text counts as empty, and an empty text is stored as 64 zero bytes; repeated rows give repeated
    results, null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    p = probe_media(store_text(docs), with_payload=True)
    payload = F.col("probed.payload")
    return p.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("probed.feature").alias("feature"),
    )
