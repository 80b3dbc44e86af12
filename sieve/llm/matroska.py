"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues, parsed into packet tables.

The reader takes any Matroska bytes: known and unknown sizes, SimpleBlocks and BlockGroups, no lacing and Xiph, fixed
and EBML lacing.  Its packet table has a row per frame: track, timestamp in nanoseconds, byte range, whether a key
frame.  The writer stores bytes as 8-bit PCM samples in frames of ``FRAME`` samples, laced, with cues per cluster.

A payload is the text in UTF-8 and spaces up to a positive multiple of ``FRAME``.  Nulls: a null text is an empty one;
null ids and repeated rows come back as they are.  Bytes that are no Matroska, end early, or hold an element where the
format has none of its kind, give the packets before the damage and ``whole`` false.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, RATE, LACED, BLOCKS = 192, 8000, 64, 16
_SCALE = 1_000_000

# Element ids of the format.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, DEPTH, DEFAULT = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
#: Elements that hold others, and what holds them; 0 is the file.
_MASTERS = {SEGMENT: 0, INFO: SEGMENT, TRACKS: SEGMENT, ENTRY: TRACKS, AUDIO: ENTRY, CLUSTER: SEGMENT, GROUP: CLUSTER, CUES: SEGMENT, POINT: CUES, POSITIONS: POINT}
_TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


def vint(n: int, width: int = 0) -> bytes:
    """A size; all ones mean unknown, so the largest value of a width is left out."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + vint(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int, int]:
    """(value, place after it, width); value -1 for an unknown size.  Raises IndexError or ValueError at damage."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("variable-length integer")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw if keep_mark else raw & (1 << 7 * width) - 1
    return (-1 if not keep_mark and value == (1 << 7 * width) - 1 else value), at + width, width


def laced(frames: list[bytes], lacing: int) -> bytes:
    """What follows the flags of a block: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def frames_of(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == 0:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing")
        sizes = [(end - at) // n] * n
    elif lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            value, at, width = read_vint(data, at)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("lacing")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def mux(payload: bytes, *, frame: int = FRAME, rate: int = RATE, per_block: int = LACED, per_cluster: int = BLOCKS) -> bytes:
    """A Matroska file with the payload as one track of 8-bit samples; its length is a multiple of ``frame``."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(rate))) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT, frame * 10**9 // rate) + audio
    info = element(INFO, number(SCALE, _SCALE) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    body, cues = [info, element(TRACKS, element(ENTRY, entry))], []
    at = sum(map(len, body))
    step, block = frame * per_block * per_cluster, frame * per_block
    for start in range(0, len(payload), step):
        base = start * 1000 // rate
        blocks = [number(TIMESTAMP, base)]
        for b in range(start, min(start + step, len(payload)), block):
            part = payload[b : min(b + block, start + step)]
            n = len(part) // frame
            relative = struct.pack(">h", b * 1000 // rate - base)
            blocks.append(element(SIMPLE, b"\x81" + relative + (b"\x84" + bytes([n - 1]) if n > 1 else b"\x80") + part))
        cues.append(element(POINT, number(CUE_TIME, base) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = _SCALE
    duration: float = 0.0
    whole: bool = True


def demux(data: bytes) -> Media:
    """Tracks, packets (track, ns, start, end, key), cues (time, track, byte) and clusters of a file."""
    m, state = Media(), {"segment": 0, "cluster": 0, "track": {}, "cue": {}}

    def block(at: int, end: int, key: bool | None) -> None:
        track, at, _ = read_vint(data, at)
        relative, flags = struct.unpack_from(">hB", data, at)
        found = frames_of(data, at + 3, end, flags >> 1 & 3)
        start = (state["cluster"] + relative) * m.scale
        each = m.tracks.get(track, {}).get("default", 0)
        for i, (a, b) in enumerate(found):
            m.packets.append((track, start + i * each, a, b, bool(flags & 128) if key is None else key))

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            kind, after, _ = read_vint(data, at, True)
            if parent == CLUSTER and kind in _TOP and end == len(data):
                return at  # the end of a cluster of unknown size
            size, body, _ = read_vint(data, after)
            stop = len(data) if size < 0 else body + size
            if stop > len(data):
                m.whole, stop = False, len(data)
                if kind not in _MASTERS:
                    return stop
            value = data[body:stop] if kind not in _MASTERS and stop - body <= 64 else b""
            n = int.from_bytes(value, "big")
            if kind == SEGMENT:
                state["segment"] = body
            elif kind == CLUSTER:
                m.clusters.append(at - state["segment"])
            elif kind == TIMESTAMP:
                state["cluster"] = n
            elif kind == SCALE:
                m.scale = n
            elif kind == DURATION:
                m.duration = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
            elif kind in (ENTRY, POINT):
                state["track" if kind == ENTRY else "cue"] = {}
            elif kind in (NUMBER, TYPE, DEFAULT, CHANNELS, DEPTH):
                state["track"][{NUMBER: "number", TYPE: "type", DEFAULT: "default", CHANNELS: "channels", DEPTH: "depth"}[kind]] = n
            elif kind == CODEC:
                state["track"]["codec"] = value.decode("ascii", "replace")
            elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                state["cue"][kind] = n
            elif kind == SIMPLE:
                block(body, stop, None)
            elif kind == BLOCK:
                state["group"] = (body, stop)
            elif kind == REFERENCE:
                state["refers"] = True
            if kind == GROUP:
                state["refers"] = False
            if kind in _MASTERS:
                if _MASTERS[kind] != parent:
                    raise ValueError("element in a wrong place")  # so the depth is that of the format
                stop = walk(body, stop, kind)
            if kind == ENTRY:
                m.tracks[state["track"].get("number", 0)] = state["track"]
            elif kind == POINT:
                m.cues.append((state["cue"].get(CUE_TIME, 0), state["cue"].get(CUE_TRACK, 0), state["segment"] + state["cue"].get(CUE_CLUSTER, 0)))
            elif kind == GROUP and "group" in state:
                block(*state.pop("group"), not state["refers"])
            at = stop
        return at

    try:
        if not data.startswith(EBML.to_bytes(4, "big")):
            raise ValueError("no EBML head")
        walk(0, len(data), 0)
    except (IndexError, ValueError, struct.error):
        m.whole = False
    return m


def padded(text: str | bytes | None) -> tuple[int, bytes]:
    """(bytes of the text, payload)."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return len(raw), raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME))


def _mapped(df: DataFrame, row, schema: pa.Schema, ddl: str, many: bool = False) -> DataFrame:
    """``row`` over the values of each row, in runs of a few MiB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                out = []
                for values in zip(*(c.to_pylist() for c in batch.slice(i, 128).columns), strict=True):
                    out.extend(row(*values)) if many else out.append(row(*values))
                for j in range(0, len(out), 10_000):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[j : j + 10_000], strict=True), schema.types, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def store(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a Matroska file."""

    def row(doc_id: int | None, text: bytes | None) -> tuple:
        n, payload = padded(text)
        return doc_id, n, mux(payload)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return _mapped(rows, row, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]), "doc_id long, n_bytes long, media binary")


def packets(df: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: (doc_id, packet, track, ns, start, end, key, whole); none for null media."""

    def row(doc_id: int | None, media: bytes | None) -> list[tuple]:
        m = demux(media or b"")
        return [(doc_id, i, *p, m.whole) for i, p in enumerate(m.packets)]

    schema = pa.schema([("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("ns", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.bool_()), ("whole", pa.bool_())])
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return _mapped(rows, row, schema, "doc_id long, packet int, track int, ns long, start long, `end` long, key boolean, whole boolean", True)


def features(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored media.

    Everything but n_bytes is read back from the stored bytes.
    """

    def row(doc_id: int | None, n: int, media: bytes) -> tuple:
        m = demux(media)
        payload = b"".join(media[a:b] for _, _, a, b, _ in m.packets)
        reached = sum(1 for _, _, at in m.cues if media[at : at + 4] == CLUSTER.to_bytes(4, "big"))
        last = m.packets[-1][1] if m.packets else 0
        codecs = ",".join(t.get("codec", "") for t in m.tracks.values())
        feature = f"codecs={codecs};clusters={len(m.clusters)};cues={reached};packets={len(m.packets)};keys={sum(p[4] for p in m.packets)};last_ns={last};ms={m.duration:g};adler={zlib.adler32(payload)};whole={int(m.whole)}"
        return doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ddl.split(", ")])
    return _mapped(df.select("doc_id", "n_bytes", "media"), row, schema, ddl)
