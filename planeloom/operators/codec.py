"""Whole images to progressive streams and back.

An image's channel is a group: its lifting stages run in NumPy over all its lines at once, the mean of LL is taken off,
and each sub-band is cut into segments. From there a segment is a row of its own, and its nine planes are coded where
it lies. Packets (a plane of a sub-band and channel) are kept in order of priority up to a quota, and an image's
records are put in stream order. Decoding finds the records again, takes the last of a repeated one, decodes each
segment down to its first missing plane, and undoes the rest.

Errors are ValueErrors whose text begins with the code: TOO_MANY_STAGES (LL under 3), TOO_MANY_SEGMENTS,
INTEGER_OVERFLOW (a mean over 15 bits or a coefficient over the planes), PACKET_COUNT_EXCEEDED.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import coding, framing
from .geometry import MAX_SEGMENTS
from .wavelet import FILTERS

MAX_PACKETS = 800
I, B = pa.int64(), pa.binary()


def _slopes(low: np.ndarray) -> np.ndarray:
    r = np.zeros((low.shape[0], low.shape[1] + 2), np.int64)
    r[:, 0] = 1
    r[:, 1 : low.shape[1]] = low[:, :-1] - low[:, 1:]
    return r


def _taken(r: np.ndarray, after, n: int, pairs: int, odd: bool, filt: str):
    """What is taken from the difference of pair n; after is the next pair's difference."""
    p, a, b, c = FILTERS[filt]
    if n == 0:
        return r[:, 1] >> 2
    if p and n == 1 and pairs + odd > 2:
        return (2 * r[:, 1] + 3 * r[:, 2] - 2 * after + 4) >> 3
    if not odd and n == pairs - 1:
        return r[:, n] >> 2
    return (p * r[:, n - 1] + a * r[:, n] + b * r[:, n + 1] - c * after + 8) >> 4


def forward_lines(x: np.ndarray, filt: str) -> np.ndarray:
    """Each row as its low, then its high values."""
    pairs, odd = x.shape[1] // 2, bool(x.shape[1] % 2)
    even, d = x[:, : 2 * pairs : 2], x[:, : 2 * pairs : 2] - x[:, 1 : 2 * pairs : 2]
    low = np.concatenate([(even + x[:, 1 : 2 * pairs : 2]) >> 1, x[:, 2 * pairs :]], 1)
    r, last = _slopes(low), np.zeros(len(x), np.int64)
    high = [d[:, n] - _taken(r, d[:, n + 1] if n + 1 < pairs else last, n, pairs, odd, filt) for n in range(pairs)]
    return np.concatenate([low, np.stack(high, 1)], 1)


def inverse_lines(y: np.ndarray, filt: str) -> np.ndarray:
    """Rows from their low and high values: a loop over the pairs, across all lines."""
    pairs, odd = y.shape[1] // 2, bool(y.shape[1] % 2)
    low, high = y[:, : pairs + odd], y[:, pairs + odd :]
    r, after, out = _slopes(low), np.zeros(len(y), np.int64), np.empty_like(y)
    if odd:
        out[:, -1] = low[:, -1]
    for n in range(pairs - 1, -1, -1):
        after = high[:, n] + _taken(r, after, n, pairs, odd, filt)
        out[:, 2 * n] = low[:, n] + ((after + 1) >> 1)
        out[:, 2 * n + 1] = out[:, 2 * n] - after
    return out


def low_dim(d: int, stage: int) -> int:
    return (d + (1 << stage) - 1) >> stage


def forward(x: np.ndarray, stages: int, filt: str) -> np.ndarray:
    """Rows then columns of what is LL so far, stages times; LL lies at the upper left."""
    x = x.astype(np.int64)
    h, w = x.shape
    if min(low_dim(h, stages), low_dim(w, stages)) < 3:
        raise ValueError("TOO_MANY_STAGES: LL would be under 3 samples wide or high")
    for s in range(stages):
        b, a = low_dim(h, s), low_dim(w, s)
        x[:b, :a] = forward_lines(forward_lines(x[:b, :a], filt).T, filt).T
    return x


def inverse(x: np.ndarray, stages: int, filt: str) -> np.ndarray:
    x = x.astype(np.int64)
    h, w = x.shape
    for s in range(stages - 1, -1, -1):
        b, a = low_dim(h, s), low_dim(w, s)
        x[:b, :a] = inverse_lines(inverse_lines(x[:b, :a].T, filt).T, filt)
    return x


def bands(w: int, h: int, stages: int):
    """(level, sub-band, x0, y0, width, height) of every level, LL at the last only."""
    for level in range(1, stages + 1):
        lw, lh, hw, hh = low_dim(w, level), low_dim(h, level), low_dim(w, level - 1) // 2, low_dim(h, level - 1) // 2
        yield from ((level, *b) for b in ((0, 0, 0, lw, lh), (1, lw, 0, hw, lh), (2, 0, lh, lw, hh), (3, lw, lh, hw, hh)) if b[0] or level == stages)


def segments(w: int, h: int, s: int) -> list[tuple[int, int, int, int]]:
    """(x0, y0, width, height) of s near-square cells that tile w by h: upper rows of c cells, lower rows of c + 1."""
    if s > w * h or s > MAX_SEGMENTS:
        raise ValueError("TOO_MANY_SEGMENTS: more segments than samples or than the format allows")
    rows = s if h > (s - 1) * w else next(r for r in range(1, s + 1) if r >= s or r * (r + 1) * w >= h * s)
    c = s // rows
    top = (c + 1) * rows - s
    top_h = max(top, (2 * h * c * top + s) // 2 // s)
    out = []
    for n_rows, n_cols, y, height in ((top, c, 0, top_h), (rows - top, c + 1, top_h, h - top_h)):
        ys = _cuts(height, n_rows)
        xs = _cuts(w, n_cols)
        out += [(a, y + b, d - a, e - b) for b, e in zip(ys, ys[1:]) for a, d in zip(xs, xs[1:])]
    return out


def _cuts(size: int, n: int) -> list[int]:
    """Borders of n parts, the shorter ones first."""
    short, longer = divmod(size, n) if n else (0, 0)
    return np.cumsum([0] + [short] * (n - longer) + [short + 1] * longer).tolist()


def _array(rows: pa.Table) -> np.ndarray:
    y, x, v = (rows.column(c).to_numpy() for c in ("y", "x", "v"))
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.int64)
    out[y, x] = v
    return out


def priority(channels: int):
    """The packet's priority as a column of level, lsb and subband; colour doubles a level's unit at each plane."""
    power = "level + 2 * lsb + 1" if channels > 1 else "level + lsb"
    return F.expr(f"CASE subband WHEN 0 THEN shiftleft(1L, int({power} + 1)) WHEN 3 THEN shiftleft(1L, int({power} - 1)) + 1 ELSE shiftleft(1L, int({power})) END")


def coded(rasters: DataFrame, stages: int, filt: str, n_segments: int) -> DataFrame:
    """(img, channel, level, subband, lsb, seg, record) of rasters (img, channel, y, x, v): whole records, all planes."""

    def transform(rows: pa.Table) -> pa.Table:
        x = _array(rows)
        h, w = x.shape
        y, out = forward(x, stages, filt), []
        for level, subband, x0, y0, bw, bh in bands(w, h, stages):
            part = y[y0 : y0 + bh, x0 : x0 + bw]
            mean = 0
            if not subband:
                mean = int(part.sum()) // part.size
                if not 0 <= mean < 1 << 15:
                    raise ValueError("INTEGER_OVERFLOW: the mean of LL needs more than 15 bits")
                part = part - mean
            out += [(level, subband, k, mean, w, h, sw, sh, part[b : b + sh, a : a + sw].astype(np.int32).tobytes()) for k, (a, b, sw, sh) in enumerate(segments(bw, bh, n_segments))]
        cols = [[rows.column(c)[0].as_py()] * len(out) for c in ("img", "channel")] + list(zip(*out))
        return pa.table([pa.array(c, t) for c, t in zip(cols, [I] * 10 + [B])], ["img", "channel", "level", "subband", "seg", "mean", "w", "h", "sw", "sh", "cells"])

    def encode(batches):
        for batch in batches:
            rows = []
            for img, channel, level, subband, seg, mean, w, h, sw, sh, cells in zip(*(c.to_pylist() for c in batch.columns)):
                for lsb, payload, bits in coding.encode_segment(np.frombuffer(cells, np.int32).tolist(), sw, sh, subband):
                    whole = framing.record(payload, mean, level, subband, seg, lsb, channel, w, h, bits)
                    rows.append((img, channel, level, subband, lsb, seg, whole))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [I] * 6 + [B])], ["img", "channel", "level", "subband", "lsb", "seg", "record"])

    cells = rasters.select(*(F.col(c).cast("long").alias(c) for c in ("img", "channel", "y", "x", "v"))).groupBy("img", "channel")
    cells = cells.applyInArrow(transform, "img long, channel long, level long, subband long, seg long, mean long, w long, h long, sw long, sh long, cells binary")
    return cells.repartition("img", "channel", "level", "subband", "seg").mapInArrow(encode, "img long, channel long, level long, subband long, lsb long, seg long, record binary")


def kept_records(records: DataFrame, channels: int, quota: int) -> DataFrame:
    """The records of each image's longest prefix of whole packets, in order of priority, that quota bytes hold."""
    packet = ["img", "channel", "level", "subband", "lsb"]
    sizes = records.groupBy(*packet).agg(F.sum(F.octet_length("record")).alias("n"))
    sizes = sizes.withColumn("priority", priority(channels))
    order = Window.partitionBy("img").orderBy(F.col("priority").desc(), "subband", "level", F.col("lsb").desc(), "channel")
    upto = sizes.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= quota)
    return records.join(upto.select(*packet), packet)


def compress(rasters: DataFrame, stages: int = 3, filt: str = "a", n_segments: int = 6, channels: int = 1, quota: int | None = None) -> DataFrame:
    """(img, stream) of rasters (img, channel, y, x, v); with a quota as much of it as that many bytes hold."""
    if channels * coding.PLANES * (3 * stages + 1) >= MAX_PACKETS:
        raise ValueError("PACKET_COUNT_EXCEEDED: more packets than the format allows")
    records = coded(rasters, stages, filt, n_segments)
    if quota is not None:
        records = kept_records(records, channels, quota)

    def whole(rows: pa.Table) -> pa.Table:
        order = sorted(rows.select(["seg", "subband", "level", "lsb", "channel", "record"]).to_pylist(), key=lambda r: (r["seg"], -r["subband"], -r["level"], -r["lsb"], r["channel"]))
        return pa.table([rows.column("img").slice(0, 1), pa.array([b"".join(r["record"] for r in order)], B)], ["img", "stream"])

    return records.groupBy("img").applyInArrow(whole, "img long, stream binary")


def found_records(streams: DataFrame) -> DataFrame:
    """(img, channel, level, subband, seg, lsb, offset, mean, w, h, n_bits, payload) of the whole records of (img, stream)."""

    def run(batches):
        for batch in batches:
            for img, stream in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(img, f[5] >> 4, f[2], f[3], f[4], f[5] & 15, at, f[1], f[6], f[7], f[8], p) for at, f, p in framing.scan(stream or b"")]
                cols = list(zip(*rows)) or [[]] * 12
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [I] * 11 + [B])], [*NAMES, "payload"])

    NAMES = ["img", "channel", "level", "subband", "seg", "lsb", "offset", "mean", "w", "h", "n_bits"]
    return streams.select("img", "stream").mapInArrow(run, ", ".join(f"{n} long" for n in NAMES) + ", payload binary")


def dimensions(streams: DataFrame) -> DataFrame:
    """(img, w, h) by the last whole record of each stream."""
    return found_records(streams).groupBy("img").agg(F.max_by("w", "offset").alias("w"), F.max_by("h", "offset").alias("h"))


def decompress(streams: DataFrame, stages: int = 3, filt: str = "a", n_segments: int = 6) -> DataFrame:
    """(img, channel, y, x, v) of streams (img, stream): what the whole records give, negative samples as 0.

    Stages, filter and segments are not in the stream. A segment without records is zero; a stream without any gives no rows.
    """
    key = ["img", "channel", "level", "subband", "seg"]
    rows = found_records(streams)
    last = rows.groupBy(*key, "lsb").agg(F.max_by(F.struct("offset", "mean", "w", "h", "n_bits", "payload"), "offset").alias("r")).select(*key, "lsb", "r.*")

    def decode(batches):
        for batch in batches:
            out = []
            for *at, planes in zip(*(c.to_pylist() for c in batch.columns)):
                img, channel, level, subband, seg = at
                newest = max(planes, key=lambda p: p["offset"])
                w, h = newest["w"], newest["h"]
                place = next((b[2:] for b in bands(w, h, stages) if b[:2] == (level, subband)), None)
                if place is None or seg >= n_segments:
                    continue  # not of these stages or segments
                x0, y0, sw, sh = segments(*place[2:], n_segments)[seg]
                values = coding.decode_segment({p["lsb"]: (p["payload"], p["n_bits"]) for p in planes}, sw, sh, subband)
                out.append((img, channel, subband, newest["offset"], newest["mean"], w, h, place[0] + x0, place[1] + y0, sw, sh, np.array(values, np.int32).tobytes()))
            cols = list(zip(*out)) or [[]] * 12
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [I] * 11 + [B])], CELLS + ["cells"])

    CELLS = ["img", "channel", "subband", "offset", "mean", "w", "h", "x0", "y0", "sw", "sh"]
    planes = last.groupBy(*key).agg(F.collect_list(F.struct("lsb", "offset", "mean", "w", "h", "n_bits", "payload")).alias("planes"))
    cells = planes.mapInArrow(decode, ", ".join(f"{n} long" for n in CELLS) + ", cells binary")

    def restore(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["offset"])
        w, h = rows[-1]["w"], rows[-1]["h"]
        y, mean = np.zeros((h, w), np.int64), rows[-1]["mean"]
        for r in rows:
            if (r["w"], r["h"]) == (w, h):
                y[r["y0"] : r["y0"] + r["sh"], r["x0"] : r["x0"] + r["sw"]] = np.frombuffer(r["cells"], np.int32).reshape(r["sh"], r["sw"])
            mean = r["mean"] if r["subband"] == 0 else mean
        y[: low_dim(h, stages), : low_dim(w, stages)] += mean if any(r["subband"] == 0 for r in rows) else 0
        v = np.maximum(inverse(y, stages, filt), 0)
        n = w * h
        cols = [np.full(n, rows[0]["img"]), np.full(n, rows[0]["channel"]), np.repeat(np.arange(h), w), np.tile(np.arange(w), h), v.ravel()]
        return pa.table([pa.array(c, I) for c in cols], ["img", "channel", "y", "x", "v"])

    return cells.groupBy("img", "channel").applyInArrow(restore, "img long, channel long, y long, x long, v long")
