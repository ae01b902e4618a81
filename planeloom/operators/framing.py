"""Packets as records of a byte stream: 28 bytes of header with its CRC-32, then a payload with its own.

scan finds the records again in a stream that may be damaged: a header or payload whose CRC is wrong is passed over and
the search goes on at the next byte.
"""

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

#: The mark at the start of a record, and its fields: mark, mean, level, sub-band, segment, plane and channel, width, height, payload bits, payload CRC.
MARK, HEAD = 0x605B, struct.Struct("<HHBBBBIIII")
SIZE = HEAD.size + 4


def record(payload: bytes, mean=0, level=1, subband=0, segment=0, plane=0, channel=0, width=0, height=0, n_bits=None) -> bytes:
    n_bits = 8 * len(payload) if n_bits is None else n_bits
    head = HEAD.pack(MARK, mean, level, subband, segment, plane | channel << 4, width, height, n_bits, zlib.crc32(payload))
    return head + struct.pack("<I", zlib.crc32(head)) + payload


def scan(stream: bytes):
    """(offset, header fields, payload) of each whole record."""
    mark, at = struct.pack("<H", MARK), 0
    while (at := stream.find(mark, at)) >= 0 and at + SIZE <= len(stream):
        head = stream[at : at + HEAD.size]
        fields = HEAD.unpack(head)
        end = at + SIZE + (fields[8] + 7) // 8
        payload = stream[at + SIZE : end]
        if struct.unpack_from("<I", stream, at + HEAD.size)[0] == zlib.crc32(head) and end <= len(stream) and zlib.crc32(payload) == fields[9]:
            yield at, fields, payload
            at = end
        else:
            at += 1


def framed(texts: DataFrame, piece: int = 512) -> DataFrame:
    """(doc_id, stream) of (doc_id, text): a record for each piece of the text's bytes, numbered by segment and, in 256s, width. Null text is empty."""

    def run(batches):
        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            out = [b"".join(record(raw[i : i + piece], segment=i // piece % 256, width=i // piece // 256) for i in range(0, len(raw), piece)) for raw in raws]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "stream"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, stream binary")


def damaged(streams: DataFrame) -> DataFrame:
    """(doc_id, stream) with the last payload byte of the second of each three records flipped, for tests of the scan."""

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                raw = bytearray(raw or b"")
                for i, (at, fields, payload) in enumerate(list(scan(bytes(raw)))):
                    if i % 3 == 1:
                        raw[at + SIZE + len(payload) - 1] ^= 0x55
                out.append(bytes(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "stream"])

    return streams.select("doc_id", "stream").mapInArrow(run, "doc_id long, stream binary")


def scanned(streams: DataFrame) -> DataFrame:
    """(doc_id, offset, segment, payload) of the whole records of (doc_id, stream)."""

    def run(batches):
        for b in batches:
            rows = [(doc, at, f[4] + 256 * f[6], p) for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for at, f, p in scan(raw or b"")]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "offset", "segment", "payload"])

    return streams.select("doc_id", "stream").mapInArrow(run, "doc_id long, offset long, segment int, payload binary")
