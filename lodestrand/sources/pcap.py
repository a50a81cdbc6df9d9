"""Packet captures: outbound connection attempts by destination."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import importable

# Bytes of link-layer header by link type (null, Ethernet, raw IP, two Linux cooked forms).
LINK_BYTES = {0: 4, 1: 14, 101: 0, 113: 16, 276: 20}


class CaptureError(ValueError):
    """Bytes that are no capture, or one of a kind whose offsets are not known."""


def connection_attempts(data: bytes) -> Counter:
    """TCP segments with SYN and without ACK, by "address:port" of IPv4 destinations."""
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}.get(data[:4])
    if order is None or len(data) < 24:
        raise CaptureError("not a classic capture")
    link = struct.unpack_from(order + "I", data, 20)[0]
    if link not in LINK_BYTES:
        raise CaptureError(f"link type {link} has no known offset")
    found: Counter = Counter()
    at = 24
    while at + 16 <= len(data):
        held = struct.unpack_from(order + "I", data, at + 8)[0]
        packet = data[at + 16 + LINK_BYTES[link] : at + 16 + held]
        at += 16 + held
        if len(packet) >= 20 and packet[0] >> 4 == 4 and packet[9] == 6:
            segment = packet[(packet[0] & 15) * 4 :]
            if len(segment) >= 14 and segment[13] & 0x12 == 0x02:
                found[f"{'.'.join(map(str, packet[16:20]))}:{int.from_bytes(segment[2:4], 'big')}"] += 1
    return found


def syn_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, destination, syns) of capture files, most first."""
    importable(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, d, n) for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for d, n in connection_attempts(data).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "destination", "syns"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(parse, "path string, destination string, syns long").orderBy(F.desc("syns"), "destination")


def rewritten(data: bytes, addresses: dict[str, str]) -> bytes:
    """A capture with its IPv4 addresses replaced, header checksums made anew, and nothing kept beyond the TCP header.

    Packets that are no IPv4, or hold an address that has no replacement, are dropped: they could name whom they reached.
    """
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}.get(data[:4])
    if order is None or len(data) < 24:
        raise CaptureError("not a classic capture")
    link = struct.unpack_from(order + "I", data, 20)[0]
    if link not in LINK_BYTES:
        raise CaptureError(f"link type {link} has no known offset")
    out, at = [data[:24]], 24
    while at + 16 <= len(data):
        held = struct.unpack_from(order + "I", data, at + 8)[0]
        packet = bytearray(data[at + 16 : at + 16 + held])
        when, at = data[at : at + 8], at + 16 + held
        ip = LINK_BYTES[link]
        if len(packet) < ip + 20 or packet[ip] >> 4 != 4:
            continue
        both = [".".join(map(str, packet[ip + k : ip + k + 4])) for k in (12, 16)]
        if not all(a in addresses for a in both):
            continue
        size = (packet[ip] & 15) * 4
        for k, a in zip((12, 16), both, strict=True):
            packet[ip + k : ip + k + 4] = bytes(map(int, addresses[a].split(".")))
        packet[ip + 10 : ip + 12] = b"\0\0"
        total = sum(struct.unpack(f">{size // 2}H", packet[ip : ip + size]))
        while total >> 16:
            total = (total & 0xFFFF) + (total >> 16)
        packet[ip + 10 : ip + 12] = struct.pack(">H", ~total & 0xFFFF)
        for k in range(min(ip, 14)):  # link-layer addresses
            packet[k] = packet[k] if link != 1 or k >= 12 else 0
        kept = packet[: ip + size + 20]
        out.append(when + struct.pack(order + "II", len(kept), len(kept)) + bytes(kept))
    return b"".join(out)


def rewrite(spark: SparkSession, pattern: str, addresses: DataFrame) -> DataFrame:
    """(path, content): capture files with the addresses of (address, replacement), which are those of one run."""
    importable(spark)
    known = {r["address"]: r["replacement"] for r in addresses.select("address", "replacement").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rewritten(data, known) for data in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "path string, content binary")


def unobserved(attempts: DataFrame, flows: DataFrame) -> DataFrame:
    """Destinations of attempts, but for this machine, whose address no flow has."""
    seen = flows.filter(F.coalesce("dest_ip", F.lit("")) != "").select(F.col("dest_ip").alias("ip")).distinct()
    remote = attempts.filter(~F.col("destination").startswith("127.")).withColumn("ip", F.regexp_replace("destination", r":\d+$", ""))
    return remote.join(seen, "ip", "left_anti").select("destination", "syns")


def by_server(calls: DataFrame, flows: DataFrame) -> DataFrame:
    """Calls and flows of each server that was called; servers that only flows name are left out."""
    called = calls.groupBy("server_id").agg(F.count("*").alias("calls"), F.count_if(F.coalesce("ok", F.lit(False))).alias("completed"))
    seen = flows.groupBy("server_id").agg(F.count("*").alias("proxy_flows"), F.count_if(F.col("phase") == "driving").alias("proxy_flows_during_calls"))
    return called.join(seen, "server_id", "left").fillna(0, ["proxy_flows", "proxy_flows_during_calls"])
