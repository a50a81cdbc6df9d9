import hashlib
import random
import zlib

import pytest

from lodestrand.llm import transport as ts


@pytest.mark.parametrize("n", [0, 1, 64, 150, 162, 163, 184, 4095, 4096, 4097, 4096 * 9 + 5, 100_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = ts.multiplex(payload)
    assert len(media) % 188 == 0 and media[0] == 0x47
    found = ts.demultiplex(media)
    assert found.payload() == payload
    assert found.programs == {1: 0x1000} and found.streams == {0x100: 6}
    assert (found.gaps, found.repeats, found.bad_sections, found.broken_units, found.lost_sync) == (0, 0, 0, 0, 0)
    assert [u.pts for u in found.units] == [90_000 + 3600 * k for k in range(len(found.units))]
    assert [u.random_access for u in found.units] == [k % 8 == 0 for k in range(len(found.units))]
    assert found.clocks == [u.pts for u in found.units]


def packets(media):
    return [media[i : i + 188] for i in range(0, len(media), 188)]


def test_damage_is_counted():
    payload = random.Random(1).randbytes(20_000)
    p = packets(ts.multiplex(payload))
    lost = ts.demultiplex(b"".join(p[:10] + p[11:]))
    assert lost.gaps == 1 and lost.broken_units == 1 and len(lost.units) == 4
    twice = ts.demultiplex(b"".join(p[:10] + [p[9]] + p[10:]))
    assert twice.repeats == 1 and twice.gaps == 0 and twice.payload() == payload
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(184)
    assert ts.demultiplex(b"".join(p[:3] + [null] + p[3:])).payload() == payload
    shifted = ts.demultiplex(b"junk" + b"".join(p))
    assert shifted.lost_sync == 4 and shifted.payload() == payload
    flipped = bytearray(p[0])
    flipped[12] ^= 1
    assert ts.demultiplex(bytes(flipped) + b"".join(p[1:])).bad_sections == 1
    with pytest.raises(ts.TransportError):
        ts.demultiplex(b"no stream at all")


def test_section_checksum_is_the_published_one():
    assert ts.section_crc(b"123456789") == 0x0376E6E7


def test_table(spark, edge_docs, no_docs):
    rows = ts.round_trip(edge_docs).collect()
    want = []
    for r in edge_docs.collect():
        data = (r.text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        want.append((r.doc_id or -1, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    same = {r.payload_sha256: (r.media_sha256, r.media_bytes, r.feature) for r in rows}
    assert all(same[r.payload_sha256] == (r.media_sha256, r.media_bytes, r.feature) for r in rows)
    assert ts.round_trip(no_docs).count() == 0
    index = ts.units(ts.store(edge_docs)).collect()
    assert sum(r.n_bytes for r in index) == sum(w[2] for w in want) and any(r.random_access for r in index)


def test_features_tell_later_access_points_and_times_apart():
    media = ts.multiplex(bytes(4096 * 8 * 12))
    line = ts.describe(ts.demultiplex(media))
    for field, value in (("pts", 5), ("packet", 7), ("random_access", False)):
        changed = ts.demultiplex(media)
        setattr(changed.units[80], field, value)
        assert changed.units[80].random_access or field == "random_access"
        assert ts.describe(changed) != line
