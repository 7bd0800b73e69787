"""Matroska: EBML elements, clusters, lacing and cues as packet tables.

``mux`` stores a payload as 8-bit PCM frames in laced blocks; ``parse`` walks any
Matroska file by its variable-length elements and lists its packets with track,
timestamp and byte range; ``packet_table`` does so for a column of files.

Defined results: a null or empty text is stored as one frame of fill bytes; a
null file has no packets; a broken file has those packets that precede the break
and an error text; repeated rows get the same rows each; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples (bytes) in a frame, frames in a block, blocks in a cluster, samples a second.
FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, RATE = 576, 8, 32, 48_000
FILL = 255

# Fixed values of the Matroska format: element identifiers.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, AUDIO = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xB5, 0x9F, 0x6264, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, DEFAULT_DURATION, TRACK_UID = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x23E383, 0x73C5
MASTERS = {SEGMENT, TRACKS, TRACK_ENTRY, AUDIO, INFO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)


# ---------------------------------------------------------------- variable-length integers

def size_of(value: int, width: int = 0) -> bytes:
    """An element size; all ones are kept for an unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_size(data, at: int) -> tuple[int | None, int]:
    """Value (None: unknown size) and the position after it."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut within a number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def read_id(data, at: int) -> tuple[int, int]:
    if not data[at]:
        raise ValueError(f"no identifier at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"bad identifier at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def element(kind: int, body: bytes, width: int = 0) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_of(len(body), width) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


# ---------------------------------------------------------------- lacing

def lace(frames: list[bytes], kind: int) -> bytes:
    """Lace header and frames."""
    if kind == NO_LACING:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytearray([len(frames) - 1])
    if kind == XIPH:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif kind == EBML_LACING:
        head += size_of(sizes[0]) if len(sizes) > 1 else b""
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += size_of(n - before + (1 << 7 * width - 1) - 1, width)
    return bytes(head) + b"".join(frames)


def laced(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose lace header begins at ``at``."""
    if kind == NO_LACING:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing of an uneven length")
        sizes = [(end - at) // count] * count
    elif kind == XIPH:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:
        for k in range(count - 1):
            start = at
            n, at = read_size(data, at)
            n = (1 << 7 * (at - start)) - 1 if n is None else n
            sizes.append(n if not k else sizes[-1] + n - (1 << 7 * (at - start) - 1) + 1)
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames exceed their block")
    ranges = []
    for n in sizes:
        ranges.append((at, at + n))
        at += n
    return ranges


# ---------------------------------------------------------------- writing

def mux(payload: bytes, frame: int = FRAME, lacing: int = FIXED) -> bytes:
    """A file with one 8-bit PCM track; ``payload`` is a whole number of frames."""
    if not payload or len(payload) % frame:
        raise ValueError(f"a payload is a positive multiple of {frame} bytes")
    frames = len(payload) // frame
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    scale = 1_000_000_000 * frame // RATE  # a tick is a frame
    info = element(INFO, number(TIMESTAMP_SCALE, scale) + element(DURATION, np.float64(frames).astype(">f8").tobytes()))
    audio = element(AUDIO, element(SAMPLING, np.float64(RATE).astype(">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, scale) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    clusters, cues, position, view = [], [], len(info) + len(tracks), memoryview(payload)
    per_cluster = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER if lacing else BLOCKS_PER_CLUSTER
    for first in range(0, frames, per_cluster):
        parts, last = [number(TIMESTAMP, first)], min(frames, first + per_cluster)
        step = FRAMES_PER_BLOCK if lacing else 1
        for k in range(first, last, step):
            n = min(step, last - k)
            own = lacing if n > 1 else NO_LACING
            head_ = b"\x81" + (k - first).to_bytes(2, "big") + bytes([0x80 | own << 1])
            if own in (NO_LACING, FIXED):
                body = (bytes([n - 1]) if own else b"") + bytes(view[k * frame : (k + n) * frame])
            else:
                body = lace([bytes(view[j * frame : (j + 1) * frame]) for j in range(k, k + n)], own)
            parts.append(element(SIMPLE_BLOCK, head_ + body))
        clusters.append(element(CLUSTER, b"".join(parts), 8))
        cues.append(element(CUE_POINT, number(CUE_TIME, first) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, position))))
        position += len(clusters[-1])
    return head + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)), 8)


# ---------------------------------------------------------------- reading

@dataclass
class Media:
    #: (track, timestamp in ns, first byte, end byte, cluster, keyframe)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    #: track number -> {type, codec, rate, channels, bits, default duration in ns}
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (time in ns, track, cluster's byte position in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    error: str | None = None


def _int(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _children(data, at: int, end: int):
    """(identifier, first byte of the element, of its body, end); an unknown size ends at the parent's end or the next cluster-level element."""
    while at < end:
        start = at
        kind, at = read_id(data, at)
        n, at = read_size(data, at)
        stop = end if n is None else at + n
        if stop > end:
            raise ValueError(f"element {kind:x} at byte {start} exceeds its parent")
        if n is None and kind == CLUSTER:
            stop = at
            while stop < end:
                below, body = read_id(data, stop)
                if below in (CLUSTER, CUES, TRACKS, INFO, SEEK_HEAD):
                    break
                m, body = read_size(data, body)
                if m is None or body + m > end:
                    raise ValueError(f"element {below:x} at byte {stop} exceeds its parent")
                stop = body + m
        yield kind, start, at, stop
        at = stop


def _block(media: Media, data, at: int, end: int, time: int, cluster: int, keyframe: bool | None, duration: int | None = None) -> None:
    track, at = read_size(data, at)
    if at + 3 > end:
        raise ValueError("block without a head")
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    ranges = laced(data, at + 3, end, flags >> 1 & 3)
    step = media.tracks.get(track, {}).get("default_duration", 0) or (duration * media.scale // len(ranges) if duration else 0)
    start, key = (time + relative) * media.scale, bool(flags & 0x80) if keyframe is None else keyframe
    media.packets += [(track, start + k * step, a, b, cluster, key) for k, (a, b) in enumerate(ranges)]


def parse(data: bytes) -> Media:
    """Packets, tracks and cues of a file; stops at the first broken element and says why."""
    media = Media()
    try:
        if not data or read_id(data, 0)[0] != EBML:
            raise ValueError("no EBML head")
        for kind, _, at, end in _children(data, 0, len(data)):
            if kind == SEGMENT:
                _segment(media, data, at, end)
    except (ValueError, IndexError) as e:
        media.error = str(e)
    return media


def _segment(media: Media, data, base: int, end: int) -> None:
    for kind, start, at, stop in _children(data, base, end):
        if kind == INFO:
            for k, _, a, b in _children(data, at, stop):
                if k == TIMESTAMP_SCALE:
                    media.scale = _int(data, a, b)
        elif kind == TRACKS:
            for _, _, a, b in _children(data, at, stop):
                _track(media, data, a, b)
        elif kind == CLUSTER:
            media.clusters.append(start)
            time, n = 0, len(media.clusters) - 1
            for k, _, a, b in _children(data, at, stop):
                if k == TIMESTAMP:
                    time = _int(data, a, b)
                elif k == SIMPLE_BLOCK:
                    _block(media, data, a, b, time, n, None)
                elif k == BLOCK_GROUP:
                    inner = {x: (c, d) for x, _, c, d in _children(data, a, b)}
                    if BLOCK in inner:
                        _block(media, data, *inner[BLOCK], time, n, 0xFB not in inner, _int(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None)
        elif kind == CUES:
            for _, _, a, b in _children(data, at, stop):
                time, places = 0, []
                for k, _, c, d in _children(data, a, b):
                    if k == CUE_TIME:
                        time = _int(data, c, d)
                    elif k == CUE_TRACK_POSITIONS:
                        own = {x: _int(data, e, f) for x, _, e, f in _children(data, c, d)}
                        places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0)))
                media.cues += [(time * media.scale, track, base + position) for track, position in places]


def _track(media: Media, data, at: int, end: int) -> None:
    own = {"default_duration": 0}
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}
    for k, _, a, b in _children(data, at, end):
        if k in names:
            own[names[k]] = _int(data, a, b)
        elif k == CODEC_ID:
            own["codec"] = bytes(data[a:b]).decode("ascii", "replace")
        elif k == AUDIO:
            for x, _, c, d in _children(data, a, b):
                if x == SAMPLING:
                    own["rate"] = float(np.frombuffer(bytes(data[c:d]), ">f8" if d - c == 8 else ">f4")[0])
                elif x in (CHANNELS, BIT_DEPTH):
                    own["channels" if x == CHANNELS else "bits"] = _int(data, c, d)
    media.tracks[own.get("number", 0)] = own


def read_payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """The track's packets, one after another."""
    view = memoryview(data)
    return b"".join([view[a:b] for t, _, a, b, _, _ in media.packets if t == track])


# ---------------------------------------------------------------- columns

PACKETS = "key long, packet long, track long, timestamp_ns long, byte_start long, byte_end long, cluster long, keyframe boolean, error string"


def packet_table(files: DataFrame, key: str, data: str) -> DataFrame:
    """A row per packet of each file of column ``data``; a broken file ends with a row that has its error."""
    def run(batches):
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not blob.is_valid:
                    continue
                media = parse(blob.as_py())
                rows = [(k, n, *p, None) for n, p in enumerate(media.packets)]
                if media.error:
                    rows.append((k, len(rows), None, None, None, None, None, None, media.error))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 7, pa.bool_(), pa.string()), strict=True)], names=["key", "packet", "track", "timestamp_ns", "byte_start", "byte_end", "cluster", "keyframe", "error"])

    return files.select(F.col(key).cast("long").alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(run, PACKETS)


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """Shape and loudness of the stored track, from the packet table and the samples read back."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    mean = float((counts * np.arange(256)).sum()) / len(samples)
    last = max(t for _, t, *_ in media.packets)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};end_ns={last};peak={int(samples.max())};mean={mean:.3f};levels={int((counts > 0).sum())}"


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_file: bool = False) -> DataFrame:
    """Each text as a Matroska file, read back through its packet table; ``keep_file`` adds the file itself."""
    schema = MEDIA + (", media binary" if keep_file else "")

    def run(batches):
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = value.as_py().encode() if value.is_valid else b""
                file = mux(raw + bytes([FILL]) * ((-len(raw)) % FRAME if raw else FRAME))
                media = parse(file)
                payload = read_payload(file, media)
                rows.append((k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(file, media, payload), *([file] if keep_file else [])))
                if len(rows) == 500:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
