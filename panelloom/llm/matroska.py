"""Matroska columns: write and parse EBML, and give packet tables.

The parser walks variable-length elements (ids of 1 to 4 bytes, sizes of 1 to 8
bytes, unknown sizes of the segment and of clusters included) and understands
simple blocks and block groups with no, Xiph, fixed-size and EBML lacing, and
cues. It returns byte ranges, so payloads need not be copied.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, spread

# Element ids of the Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_FIELDS = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4282, b"matroska"), (0x4287, 4), (0x4285, 2))

PAD = 64
SAMPLE_RATE = 8000
FRAME = 512
LACED = 8
#: Block times are 16 bits of milliseconds, so a cluster must stay under 32 s.
CLUSTER_BLOCKS = 32


def _vint(n: int, width: int = 0) -> bytes:
    width = width or max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, int):
        value = value.to_bytes(max(1, -(-value.bit_length() // 8)), "big")
    elif isinstance(value, float):
        value = struct.pack(">d", value)
    elif isinstance(value, str):
        value = value.encode()
    return number.to_bytes(-(-number.bit_length() // 8), "big") + _vint(len(value)) + value


def lace(sizes: list[int], kind: int) -> bytes:
    """Header of the frames of a block. Kinds: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return b""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += _vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < 1 << (7 * w - 1))
            head += _vint(d + (1 << (7 * width - 1)) - 1, width)
    return head


def simple_block(track: int, at: int, frames: list[bytes], kind: int) -> bytes:
    return element(SIMPLE_BLOCK, _vint(track) + struct.pack(">hB", at, 0x80 | kind << 1) + lace([len(f) for f in frames], kind) + b"".join(frames))


def mux_pcm(payload: bytes) -> bytes:
    """A file with one track of 8-bit mono samples: eight frames of 64 ms to a
    block by fixed-size lacing, the uneven rest by EBML lacing, a cue for each cluster."""
    ms = 1000 / SAMPLE_RATE
    clusters, cues, span = [], [], FRAME * LACED
    head = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, len(payload) * ms) + element(MUXING_APP, "panelloom") + element(WRITING_APP, "panelloom"))
    head += element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, "A_PCM/INT/LIT") + element(AUDIO, element(RATE, float(SAMPLE_RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))))
    at = len(head)
    for c in range(0, len(payload), span * CLUSTER_BLOCKS):
        time = int(c * ms)
        parts = [element(TIMESTAMP, time)]
        for b in range(c, min(c + span * CLUSTER_BLOCKS, len(payload)), span):
            block = payload[b : b + span]
            frames = [block[i : i + FRAME] for i in range(0, len(block), FRAME)]
            kind = 0 if len(frames) == 1 else 2 if len(block) % FRAME == 0 else 3
            parts.append(simple_block(1, int(b * ms) - time, frames, kind))
        clusters.append(element(CLUSTER, b"".join(parts)))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return element(EBML, b"".join(element(n, v) for n, v in DOC_FIELDS)) + element(SEGMENT, b"".join([head, *clusters, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds; ``packets``: (track, timestamp in ticks, offset, length, keyframe, cluster)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    segment: int = 0


def _size(data: bytes, at: int) -> tuple[int | None, int]:
    first = data[at]
    width = 9 - first.bit_length() if first else 9
    if width > 8:
        raise ValueError(f"bad size at {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, ends_at: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end of the value) of the elements of a range. Of unknown size:
    up to the end of the range, or to the next element that ``ends_at`` names."""
    while at < end:
        width = 9 - data[at].bit_length()
        if width > 4:
            raise ValueError(f"bad element id at {at}")
        number = int.from_bytes(data[at : at + width], "big")
        if number in ends_at:
            return
        size, start = _size(data, at + width)
        stop = end if size is None else start + size
        if stop > end:
            raise ValueError(f"element at {at} reaches past its parent")
        if size is None and number == CLUSTER:
            stop = start
            for _, _, stop in elements(data, start, end, frozenset((CLUSTER, CUES, INFO, TRACKS))):
                pass
        yield number, start, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, [(offset, length)]) of a block."""
    track, at = _size(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track or 0, time, flags, [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == 2:
        each = (end - at) // n
        return track or 0, time, flags, [(at + i * each, each) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            first = at
            value, at = _size(data, at)
            size = (value or 0) if i == 0 else sizes[-1] + (value or 0) - ((1 << 7 * (at - first) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing reaches past its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track or 0, time, flags, out


def demux(data: bytes) -> Media:
    """Parse a whole file. Raises ValueError where it is not one, or cut off inside an element."""
    try:
        return _demux(data)
    except (IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"not a whole Matroska file: {e}") from e


def _demux(data: bytes) -> Media:
    media = Media()
    top = elements(data, 0, len(data))
    if next(top, (0, 0, 0))[0] != EBML:
        raise ValueError("no EBML header")
    for number, a, b in top:
        if number != SEGMENT:
            continue
        media.segment = a
        for kind, x, y in elements(data, a, b):
            if kind == INFO:
                for k, p, q in elements(data, x, y):
                    if k == TIMESTAMP_SCALE:
                        media.scale = _uint(data, p, q)
                    elif k == DURATION:
                        media.duration = _float(data, p, q)
            elif kind == TRACKS:
                for k, p, q in elements(data, x, y):
                    if k == TRACK_ENTRY:
                        entry: dict = {}
                        for n, s, t in elements(data, p, q):
                            if n == CODEC_ID:
                                entry["codec"] = data[s:t].decode()
                            elif n == AUDIO:
                                for m, u, v in elements(data, s, t):
                                    entry[m] = _float(data, u, v) if m == RATE else _uint(data, u, v)
                            elif n in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                                entry[n] = _uint(data, s, t)
                        media.tracks[entry[TRACK_NUMBER]] = entry
            elif kind == CLUSTER:
                base, index = 0, len(media.clusters)
                media.clusters.append(x)
                for k, p, q in elements(data, x, y):
                    if k == TIMESTAMP:
                        base = _uint(data, p, q)
                    elif k == BLOCK_GROUP:
                        for m, u, v in elements(data, p, q):
                            if m == BLOCK:
                                _add(media, data, u, v, base, index)
                    elif k == SIMPLE_BLOCK:
                        _add(media, data, p, q, base, index)
            elif kind == CUES:
                for k, p, q in elements(data, x, y):
                    time = 0
                    for n, s, t in elements(data, p, q):
                        if n == CUE_TIME:
                            time = _uint(data, s, t)
                        elif n == CUE_POSITIONS:
                            where = {m: _uint(data, u, v) for m, u, v in elements(data, s, t)}
                            media.cues.append((time, where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER, 0)))
    return media


def _add(media: Media, data: bytes, a: int, b: int, base: int, cluster: int) -> None:
    track, time, flags, frames = block_frames(data, a, b)
    entry = media.tracks.get(track, {})
    # Frames of a lace follow each other: of samples by their lengths, else by the track's frame duration.
    # Without either all have the time of the block.
    wide = entry.get(CHANNELS, 1) * entry.get(BIT_DEPTH, 0) / 8
    per_byte = 1e9 / (entry[RATE] * media.scale * wide) if entry.get("codec", "").startswith("A_PCM") and entry.get(RATE) and wide else 0.0
    per_frame = 0.0 if per_byte else entry.get(DEFAULT_DURATION, 0) / media.scale
    first = frames[0][0]
    for k, (at, size) in enumerate(frames):
        media.packets.append((track, base + time + int((at - first) * per_byte + k * per_frame), at, size, bool(flags & 0x80), cluster))


def features(payload: bytes, media: Media) -> str:
    """Figures of the samples, the silence of which is 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};duration_ms={media.duration * media.scale / 1e6:.3f};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % PAD if raw else PAD)


def store_media(docs: DataFrame, space: Workspace, name: str = "media") -> DataFrame:
    """Write (doc_id, n_bytes, media) for every row of docs(doc_id, text); null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = [padded(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sized], pa.int64()), pa.array([mux_pcm(p) for _, p in sized], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return space.write(spread(rows).mapInArrow(run, "doc_id long, n_bytes long, media binary"), name)


def packet_table(media: DataFrame) -> DataFrame:
    """One row for every packet of media(doc_id, media): (doc_id, packet, track, timestamp_ns, byte_offset, n_bytes, keyframe, cluster). Null media has no packets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                m = demux(data)
                rows = [(doc, i, t, when * m.scale, at, n, key, c) for i, (t, when, at, n, key, c) in enumerate(m.packets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PACKET.types, strict=True)], schema=_PACKET)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet int, track int, timestamp_ns long, byte_offset long, n_bytes long, keyframe boolean, cluster int")


_PACKET = pa.schema([("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("byte_offset", pa.int64()), ("n_bytes", pa.int64()), ("keyframe", pa.bool_()), ("cluster", pa.int32())])


def media_digests(stored: DataFrame) -> DataFrame:
    """Parse stored media and digest payload and file; one row for every row.

    Checks that every cue points to a cluster. Equal files give equal values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                m = demux(data)
                payload = b"".join(data[at : at + n] for _, _, at, n, _, _ in m.packets)
                for _, _, where in m.cues:
                    if _uint(data, m.segment + where, m.segment + where + 4) != CLUSTER:
                        raise ValueError("a cue points to no cluster")
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, m)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, space: Workspace) -> DataFrame:
    """Store the texts as media, read the stored bytes back, digest them.

    Null and empty texts are 64 zero bytes. Repeated rows are each returned; an
    empty table gives an empty result; extra columns are ignored. A very long text is
    one file of many clusters, held whole by a worker. Nothing is compared, so there
    are no ties."""
    return media_digests(store_media(docs, space))
