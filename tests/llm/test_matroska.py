import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import matroska as m


@given(st.binary(max_size=9000))
@settings(max_examples=60, deadline=None)
def test_payload_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    data = m.mux_pcm(payload)
    media = m.demux(data)
    assert b"".join(data[a : a + n] for _, _, a, n, _, _ in media.packets) == payload
    assert media.tracks[1][m.BIT_DEPTH] == 8 and media.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert len(media.cues) == len(media.clusters)


@given(st.lists(st.integers(0, 40_000), min_size=1, max_size=12), st.sampled_from([0, 1, 2, 3]))
@settings(max_examples=80, deadline=None)
def test_lacing(sizes, kind):
    if kind == 0:
        sizes = sizes[:1]
    if kind == 2:
        sizes = [sizes[0]] * len(sizes)
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    data = m.simple_block(3, -7, frames, kind)
    ((number, a, b),) = m.elements(data, 0, len(data))
    track, time, flags, ranges = m.block_frames(data, a, b)
    assert (number, track, time, flags >> 1 & 3) == (m.SIMPLE_BLOCK, 3, -7, kind)
    assert [data[x : x + n] for x, n in ranges] == frames


def test_long_media_has_clusters_cues_and_timestamps():
    payload = bytes(range(256)) * 2000
    data = m.mux_pcm(payload)
    media = m.demux(data)
    assert len(media.clusters) == 4 and [c[0] for c in media.cues] == [0, 16384, 32768, 49152]
    at = 0
    for track, time, _, n, key, _ in media.packets:
        assert (track, time, key) == (1, at // 8, True)
        at += n


def test_unknown_sizes_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    block = m._vint(1) + struct.pack(">hB", 4, 0) + b"abcd"
    cluster = m.element(m.TIMESTAMP, 100) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block))
    tracks = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.element(m.TRACK_NUMBER, 1) + m.element(m.TRACK_TYPE, 1) + m.element(m.CODEC_ID, "V_X")))
    body = tracks + m.CLUSTER.to_bytes(4, "big") + unknown + cluster + m.CLUSTER.to_bytes(4, "big") + unknown + cluster
    media = m.demux(m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + unknown + body)
    assert [(p[1], p[3], p[5]) for p in media.packets] == [(104, 4, 0), (104, 4, 1)]


@pytest.mark.parametrize("bad", [b"", b"abc", b"\x00" * 40, m.mux_pcm(bytes(64))[:-3]])
def test_damage_is_an_error(bad):
    with pytest.raises(ValueError):
        m.demux(bad)


def test_every_cut_is_an_error_or_a_shorter_file():
    data = m.mux_pcm(bytes(range(256)) * 5)
    for n in range(len(data)):
        try:
            m.demux(data[:n])
        except ValueError:
            pass


@pytest.mark.parametrize("codec,audio,duration,times", [("A_PCM/INT/LIT", (2, 16), 0, [100, 101, 102]), ("A_PCM/INT/LIT", (1, 8), 0, [100, 104, 108]), ("A_OPUS", (2, 0), 20_000_000, [100, 120, 140]), ("A_OPUS", (2, 0), 0, [100, 100, 100])])
def test_times_of_laced_frames(codec, audio, duration, times):
    fields = m.element(m.RATE, 8000.0) + m.element(m.CHANNELS, audio[0]) + (m.element(m.BIT_DEPTH, audio[1]) if audio[1] else b"")
    entry = m.element(m.TRACK_NUMBER, 1) + m.element(m.TRACK_TYPE, 2) + m.element(m.CODEC_ID, codec) + m.element(m.AUDIO, fields) + (m.element(m.DEFAULT_DURATION, duration) if duration else b"")
    body = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, entry)) + m.element(m.CLUSTER, m.element(m.TIMESTAMP, 100) + m.simple_block(1, 0, [bytes(32)] * 3, 2))
    assert [x[1] for x in m.demux(m.element(m.EBML, b"") + m.element(m.SEGMENT, body)).packets] == times


@pytest.mark.parametrize("source", ["documents", "edge_docs"])
def test_digests(request, space_of, source):
    docs = request.getfixturevalue(source)
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = m.media_column(docs, space_of("m")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_packets_and_empty(documents, no_docs, space_of):
    stored = m.store_media(documents.limit(5), space_of("m"))
    rows = m.packet_table(stored).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_bytes
    assert total == {r.doc_id: -(-max(1, r.n_bytes) // 64) * 64 for r in stored.collect()}
    assert m.media_column(no_docs, space_of("m")).count() == 0
