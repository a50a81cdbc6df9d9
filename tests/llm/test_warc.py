import hashlib
import io
import struct

import pytest
import zstandard

from lodestrand.llm import warc

PAGES = [
    (1, "http://a.example/1", "x" * 200),
    (2, "http://a.example/2\r\nInjected: yes", "x" * 200),
    (3, None, "short"),
    (4, "u", "short"),
    (5, "u", None),
    (6, "u", "é" * 60),
    (7, "u", "é" * 60),
    (8, "u", "y" * 100),
    (8, "v", "y" * 100),
    (None, "u", "x" * 200),
    (9, "u", "long " * 200_000),
]


def brute(pages):
    rows, first = [], {}
    for i, (page, _, html) in sorted(enumerate(pages), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and digest in first:
            rows.append((page, len(data), digest, "revisit", first[digest]))
        else:
            first[digest] = page
            rows.append((page, len(data), digest, "response", None))
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")


def test_pages_come_back(spark, pages):
    rows = warc.archive_pages(pages).collect()
    assert sorted(str(tuple(r)) for r in rows) == brute(PAGES)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/pages.parquet")
    want = brute([(r.page_id, r.url, r.html) for r in table.collect()])
    assert sorted(str(tuple(r)) for r in warc.archive_pages(table).collect()) == want


def archive(n=50):
    records = [warc.make_record(i, f"http://h/{i}", (f"page {i} " * 40).encode(), hashlib.sha256((f"page {i} " * 40).encode()).hexdigest(), None, False) for i in range(n)]
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, records)
    for r in records:
        w.add(r)
    return out.getvalue(), records


def test_dictionary_leads_and_frames_are_single_records():
    data, records = archive()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    assert data.count(struct.pack("<I", warc.FRAME_MAGIC)) >= len(records)
    for chunk in (7, 1 << 20):
        got = list(warc.read_archive(io.BytesIO(data), chunk))
        assert [r.page_id() for r in got] == list(range(len(records)))
    # Without its dictionary the archive can't be read.
    size = struct.unpack("<I", data[4:8])[0]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(data[8 + size :])))
    small, _ = archive(3)
    assert struct.unpack("<I", small[:4])[0] == warc.FRAME_MAGIC and len(list(warc.read_archive(io.BytesIO(small)))) == 3


def test_plain_dictionaries_are_read():
    data, _ = archive()
    size = struct.unpack("<I", data[4:8])[0]
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert len(list(warc.read_archive(io.BytesIO(struct.pack("<II", warc.DICTIONARY_MAGIC, len(plain)) + plain + data[8 + size :])))) == 50


def test_skippable_frames_are_skipped_and_empty_frames_refused():
    record = warc.make_record(4, "u", b"data", hashlib.sha256(b"data").hexdigest(), None, False)
    one = zstandard.ZstdCompressor().compress(record)
    other = struct.pack("<II", 0x184D2A50, 5000) + bytes(5000)
    for chunk in (7, 1 << 20):
        assert len(list(warc.read_archive(io.BytesIO(one + other + one + other), chunk))) == 2
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(one + zstandard.ZstdCompressor().compress(b"") + one)))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(one + other[:100])))


def test_damage_is_found():
    data, _ = archive()
    for bad in (data[:-5], data[: len(data) // 2]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(bad)))
    flipped = bytearray(data)
    flipped[-20] ^= 1
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(io.BytesIO(bytes(flipped))))


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"WARC/1.1", b"WARC/9.9"),
        (b"WARC-Date: ", b"X-Date: "),
        (b"Content-Length: 4\r\n\r\n", b"Content-Length: 5\r\n\r\n"),
        (b"data", b"dato"),
        (b"WARC-Type: response", b"WARC-Type response"),
        (b"WARC-Date: ", b"WARC-Type: response\r\nWARC-Date: "),
    ],
)
def test_records_are_validated(old, new):
    good = warc.make_record(1, "u", b"data", hashlib.sha256(b"data").hexdigest(), None, False)
    assert warc.parse_record(good).http()[1] == b"data"
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(good.replace(old, new, 1) if old != b"data" else new.join(good.rsplit(old, 1)))


def test_revisits_carry_no_payload():
    r = warc.parse_record(warc.make_record(4, "u", b"data", "d" * 64, 2, True))
    assert (r.kind, r.page_id("warc-refers-to"), r.http()[1], r.http()[0]["content-length"]) == ("revisit", 2, b"", "4")
