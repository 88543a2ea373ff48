"""Media columns: Matroska files as a binary column, muxed and parsed in place.

Everything is an EBML element: an identifier and a size, both of variable length, then data.
The parser walks segment, tracks, cues and clusters and gives a packet table with track,
timestamp and byte range of every frame of a block, for all four ways of lacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, texts

# Element identifiers of the container format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

UNIT = 192
RATE = 8000
FRAME_MS = UNIT * 1000 // RATE
LACED, BLOCKS_PER_CLUSTER = 8, 64
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def vint(value: int, length: int | None = None) -> bytes:
    """A size of variable length; all ones are reserved for unknown sizes."""
    n = length or 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value and the place after it; None for an unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at byte {at}")
    n = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    if len(data) < at + n:
        raise ValueError("the data end inside a number")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int, track: int = 1, relative: int = 0, key: bool = True) -> bytes:
    """The data of a simple block that holds the frames."""
    head = vint(track) + struct.pack(">hB", relative, (0x80 if key else 0) | kind << 1)
    if kind == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def mux(payload: bytes, kind: int = FIXED) -> bytes:
    """A file with one track of 8-bit samples; the payload is a positive multiple of UNIT bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    frames = len(payload) // UNIT
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_MS)) + element(MUXING_APP, b"seqtide") + element(WRITING_APP, b"seqtide"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    for first in range(0, frames, LACED * BLOCKS_PER_CLUSTER):
        parts = [uint(TIMESTAMP, first * FRAME_MS)]
        for b in range(first, min(frames, first + LACED * BLOCKS_PER_CLUSTER), LACED):
            own = payload[b * UNIT : (b + LACED) * UNIT]
            split = [own[k : k + UNIT] for k in range(0, len(own), UNIT)]
            parts.append(element(SIMPLE_BLOCK, lace(split, kind if len(split) > 1 else NO_LACING, 1, (b - first) * FRAME_MS)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * FRAME_MS) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, offset, size, key frame, cluster); cues: (timestamp in ns, track, byte of the cluster)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


_PARENTS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS))
#: What a cluster of unknown size can hold.
_IN_CLUSTER = frozenset((TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, 0xA7, 0xAB, 0x5854, 0xEC, 0xBF))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, first byte of the data, byte after them) of the elements in a range, parents before what they hold."""
    while at < end:
        name, start = read_vint(data, at, keep_marker=True)
        size, start = read_vint(data, start)
        stop = end if size is None else start + size
        if stop > end:
            raise ValueError(f"the element at byte {at} is cut off")
        if size is None and name == CLUSTER:
            stop = start
            while stop < end:
                inner, k = read_vint(data, stop, keep_marker=True)
                if inner not in _IN_CLUSTER:
                    break
                length, k = read_vint(data, k)
                if length is None:
                    raise ValueError("a block of unknown size")
                stop = k + length
        yield name, start, stop
        if name in _PARENTS:
            yield from elements(data, start, stop)
        at = stop


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and byte ranges of the frames of a block."""
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, relative, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        size = (end - at) // n
        return track, relative, flags, [(at + k * size, size) for k in range(n)]
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            size += data[at]
            at += 1
        elif k == 0:
            size, at = read_vint(data, at)
        else:
            before = at
            step, at = read_vint(data, at)
            size = sizes[-1] + step - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, flags, out


def parse(data: bytes) -> Media:
    out, track, time, cue = Media(), {}, 0, [0, 0]
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0
    segment, group, refers = 0, 0, False
    for name, a, b in elements(data, 0, len(data)):
        if name == BLOCK_GROUP:
            group, refers = len(out.packets), False
        elif name == REFERENCE_BLOCK:  # before or after its block: what refers to others is no key frame
            refers = True
            out.packets[group:] = [(*p[:4], False, p[5]) for p in out.packets[group:]]
        elif name in (SIMPLE_BLOCK, BLOCK):
            who, relative, flags, spans = frames(data, a, b)
            step = out.tracks.get(who, {}).get("default_duration", 0)
            key, at = not refers if name == BLOCK else flags >= 0x80, (time + relative) * out.scale
            out.packets += [(who, at + k * step, x, size, key, len(out.clusters) - 1) for k, (x, size) in enumerate(spans)]
        elif name == TIMESTAMP:
            time = number(a, b)
        elif name == CLUSTER:
            out.clusters.append(a)
        elif name == SEGMENT:
            segment = a
        elif name == DOC_TYPE:
            out.doc_type = data[a:b].decode("ascii")
        elif name == TIMESTAMP_SCALE:
            out.scale = number(a, b)
        elif name == DURATION:
            out.duration = real(a, b)
        elif name == TRACK_ENTRY:
            track = {}
        elif name == TRACK_NUMBER:
            out.tracks[number(a, b)] = track
        elif name in (TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH):
            track[{TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration", CHANNELS: "channels", BIT_DEPTH: "bit_depth"}[name]] = number(a, b)
        elif name == CODEC_ID:
            track["codec"] = data[a:b].decode("ascii")
        elif name == SAMPLING:
            track["rate"] = real(a, b)
        elif name == CUE_TIME:
            cue = [number(a, b), 0]
        elif name == CUE_TRACK:
            cue[1] = number(a, b)
        elif name == CUE_CLUSTER:
            out.cues.append((cue[0] * out.scale, cue[1], segment + number(a, b)))
    return out


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track in the order of the file."""
    return b"".join([data[at : at + size] for who, _, at, size, _, _ in media.packets if who == track])


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def feature(payload: bytes, media: Media) -> str:
    """Packets, clusters, duration, and level, crossings and slope of the samples read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    ms = len(media.packets) * FRAME_MS
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={ms};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};slope={np.abs(np.diff(x)).mean():.4f}"


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with a binary column of Matroska files that hold the padded UTF-8 text as samples. Null or empty text: one unit of spaces."""
    small_batches(docs.sparkSession)
    docs = docs.drop(media_col)
    names = [*docs.columns, media_col]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([mux(padded(x)) for x in texts(batch, text_col)], pa.binary())], names=names)

    return docs.mapInArrow(fn, T.StructType([*docs.schema.fields, T.StructField(media_col, T.BinaryType())]))


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, track, timestamp_ns, offset, size, key, cluster. Null files have none; a broken file is an error."""
    small_batches(media.sparkSession)
    schema = T.StructType([media.schema[id_col], *(T.StructField(n, t) for n, t in (("track", T.LongType()), ("timestamp_ns", T.LongType()), ("offset", T.LongType()), ("size", T.LongType()), ("key", T.BooleanType()), ("cluster", T.IntegerType())))])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                rows = parse(data).packets if data is not None else []
                if rows:
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.bool_(), pa.int32()), strict=True))], names=schema.names)

    return media.select(id_col, media_col).mapInArrow(fn, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back, and digest both: see the columns. Rows are independent."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch):
                data = mux(padded(text))
                media = parse(data)
                back = samples(data, media)
                rows.append((len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(back, media)))
            columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fn, schema)
