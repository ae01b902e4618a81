"""Ogg: pages with checksums, packets over lacing values, two logical streams, timestamps from granule positions.

A text is stored as 8-bit samples at RATE: its UTF-8, with bytes 0 up to a positive multiple of 64. Chunks of CHUNK bytes
go in turn to two logical streams whose pages are interleaved; each stream opens with a header packet. The reader
checks capture pattern, checksum and page order, rebuilds packets from lacing values, also over page borders,
demultiplexes by serial number, and dates packets by the granule position (samples of the stream so far) of
the page on which they end. Null text counts as empty; repeated rows each give a row; extra columns are ignored.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa

RATE, CHUNK, SERIALS = 8000, 20_000, (1, 2)
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEAD = struct.Struct("<4sBBqIIIB")
HEADER = struct.Struct("<8sIQ")


def checksum(data: bytes) -> int:
    """The page checksum: polynomial 04c11db7, high bit first, from 0. It is CRC-32 of the bit-reversed bytes, reversed."""
    return int(f"{zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """One logical stream's pages; a packet comes with its granule position."""
    laces, data = [], []
    for body, granule in packets:
        full, rest = divmod(len(body), 255)
        laces += [(255, None)] * full + [(rest, granule)]
        data.append(body)
    data, at, out = b"".join(data), 0, []
    for n, start in enumerate(range(0, len(laces), 255)):
        part = laces[start : start + 255]
        size = sum(x for x, _ in part)
        granule = next((g for _, g in reversed(part) if g is not None), -1)
        flags = (start > 0 and laces[start - 1][1] is None) | (n == 0) << 1 | (start + 255 >= len(laces)) << 2
        page = HEAD.pack(b"OggS", 0, flags, granule, serial, n, 0, len(part)) + bytes(x for x, _ in part) + data[at : at + size]
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        at += size
    return out


def store(payload: bytes) -> bytes:
    streams = []
    for k, serial in enumerate(SERIALS):
        chunks = [payload[i : i + CHUNK] for i in range(k * CHUNK, len(payload), CHUNK * len(SERIALS))]
        ends = np.cumsum([len(c) for c in chunks]).tolist()
        streams.append(pages(serial, [(HEADER.pack(b"samples8", RATE, len(payload)), 0), *zip(chunks, ends)]))
    return b"".join(p for n in range(max(map(len, streams))) for s in streams for p in s[n : n + 1])


def read(stored: bytes) -> tuple[bytes, float, int, list[tuple[int, float, float]]]:
    """(payload, seconds, pages, packets as (serial, start, end) in seconds of their stream); ValueError if the stored bytes are damaged."""
    packets: dict[int, list] = {}  # of each stream: body, granule at its end
    state: dict[int, list] = {}
    at = n_pages = 0
    while at < len(stored):
        if at + HEAD.size > len(stored):
            raise ValueError("page cut short")
        mark, version, flags, granule, serial, number, crc, count = HEAD.unpack_from(stored, at)
        laces = stored[at + HEAD.size : at + HEAD.size + count]
        end = at + HEAD.size + count + sum(laces)
        if mark != b"OggS" or version or end > len(stored) or checksum(stored[at : at + 22] + bytes(4) + stored[at + 26 : end]) != crc:
            raise ValueError("damaged page")
        s = state.setdefault(serial, [0, b"", False])
        if number != s[0] or bool(flags & 1) != bool(s[2]) or bool(flags & 2) != (number == 0):
            raise ValueError("page out of order")
        pos, open_, body, ended = at + HEAD.size + count, s[2], [s[1]], []
        for x in laces:
            body.append(stored[pos : pos + x])
            pos, open_ = pos + x, x == 255
            if not open_:
                ended.append(b"".join(body))
                body = []
        own = packets.setdefault(serial, [])
        for i, p in enumerate(ended):
            # a header packet, the first of a stream, has no samples
            own.append((p, granule - sum(len(q) for q in ended[i + 1 :]) if own else 0))
        state[serial] = [number + 1, b"".join(body), open_]
        at, n_pages = end, n_pages + 1
    if any(s[2] for s in state.values()) or set(packets) != set(SERIALS):
        raise ValueError("packet cut short")
    head = packets[SERIALS[0]][0][0]
    if len(head) != HEADER.size:
        raise ValueError("no header")
    size, parts, times = HEADER.unpack(head)[2], [[body for body, _ in packets[s][1:]] for s in SERIALS], []
    for serial in SERIALS:
        before = 0
        for body, granule in packets[serial][1:]:
            if granule - len(body) != before:
                raise ValueError("granule positions do not fit the samples")
            times.append((serial, before / RATE, granule / RATE))
            before = granule
    payload = b"".join(p for n in range(max(map(len, parts))) for s in parts for p in s[n : n + 1])
    if len(payload) != size:
        raise ValueError("samples missing")
    return payload, sum(b - a for _, a, b in times), n_pages, times


def feature(payload: bytes, seconds: float, n_pages: int) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    return f"seconds={seconds:.6f};pages={n_pages};sum={x.sum()};energy={(x * x).sum()};peak={np.abs(x).max()};crossings={crossings}"


def ogg_documents(docs):
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode()
                media = store(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                payload, seconds, n_pages, _ = read(media)
                rows.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, seconds, n_pages)))
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


I, S = pa.int64(), pa.string()
SCHEMA = pa.schema({"doc_id": I, "n_bytes": I, "payload_bytes": I, "payload_sha256": S, "tail_crc32": I, "media_bytes": I, "media_sha256": S, "feature": S})


def op5_ogg(spark, sf_dir):
    return ogg_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_ogg": op5_ogg}
