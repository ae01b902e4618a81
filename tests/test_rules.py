"""Queries held against rules in plain Python, written apart from their SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from planeloom.operators import catalog, codec, wavelet

SF = "/root/testdata/sf0.001"


def rows(spark, name, *cols):
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*cols).collect()]


@pytest.fixture(scope="module")
def tiles():
    out = {}
    for i, e in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall():
        out.setdefault(i // 64, []).append([min(255, max(0, int(np.floor((float(np.float32(x)) + 1) * 127.5)))) for x in e])
    return {i: np.array(t) for i, t in out.items()}


@pytest.fixture(scope="module")
def part():
    return duckdb.sql(f"SELECT p_partkey, p_size FROM '{SF}/part.parquet'").fetchall()


def coefficients(tiles):
    for img, t in tiles.items():
        y = codec.forward(t, 2, "a")
        for level, band, x0, y0, w, h in codec.bands(t.shape[1], t.shape[0], 2):
            yield img, level, band, y[y0 : y0 + h, x0 : x0 + w]


def test_transform_queries(spark, tiles):
    energy, mean, neg, stats, categories = set(), set(), set(), set(), Counter()
    for img, level, band, c in coefficients(tiles):
        energy.add((img, level, band, c.size, int(abs(c).sum()), int((c * c).sum()), int(abs(c).max())))
        if not band:
            mean.add((img, int(c.sum()) // c.size, c.size))
            c = c - int(c.sum()) // c.size
        neg |= {(img, level, band, y, x, bool(c[y, x] < 0), int(abs(c[y, x]))) for y in range(c.shape[0]) for x in range(c.shape[1])}
        stats.add((img, level, band, c.size, *(int((abs(c) >= 1 << p).sum()) for p in range(9))))
        for m in abs(c).ravel().tolist():
            for p in range(9):
                k = (img, level, band, p, min(3, (m >> (p + 1)).bit_length()))
                categories[k, "n"] += 1
                categories[k, "ones"] += m >> p & 1
    assert set(rows(spark, "subband_energy", "img", "level", "subband", "n", "sum_abs", "energy", "peak")) == energy
    assert set(rows(spark, "ll_mean", "img", "ll_mean", "n")) == mean
    assert set(rows(spark, "sign_magnitude", "img", "level", "subband", "y", "x", "neg", "mag")) == neg
    assert set(rows(spark, "bitplane_stats", "img", "level", "subband", "n", *(f"plane_{p}" for p in range(9)))) == stats
    got = rows(spark, "bit_categories", "img", "level", "subband", "plane", "category", "n", "ones")
    assert {(r[:5], *r[5:]) for r in got} == {(k, n, categories[k, "ones"]) for (k, what), n in categories.items() if what == "n"}


def test_pixel_queries(spark, tiles, part):
    rgb = [(i, s * 5 % 256, i % 256, i * 7 % 256) for i, s in part]
    clip = lambda x: max(0, min(255, x))
    assert sorted(rows(spark, "rgb565", "id", "rgb565")) == sorted((i, r // 8 * 2048 + g // 4 * 32 + b // 8) for i, r, g, b in rgb)
    want = [(i, clip(y + int(1435 * (cr - 128) / 1024)), clip(y - int((352 * (cb - 128) + 731 * (cr - 128)) / 1024)), clip(y + int(1814 * (cb - 128) / 1024))) for i, y, cb, cr in rgb]
    assert sorted(rows(spark, "ycc_to_rgb", "id", "r", "g", "b")) == sorted(want)
    want = [(i, clip(int((299000 * r + 587000 * g + 114000 * b) / 1e6)), clip(int((-168736 * r - 331264 * g + 500000 * b) / 1e6) + 128), clip(int((500000 * r - 418688 * g - 81312 * b) / 1e6) + 128)) for i, s in part for r, g, b in [(s % 256, i % 256, i * 7 % 256)]]
    import __spark_entry__

    assert sorted(map(tuple, __spark_entry__.queries()["rgb_to_yuv"](spark, SF).select("id", "y", "u", "v").collect())) == sorted(want)
    want = {(img, y, x, int(t[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].sum()) // t[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].size) for img, t in tiles.items() for y in range((t.shape[0] + 1) // 2) for x in range((t.shape[1] + 1) // 2)}
    assert set(rows(spark, "raster_descale", "img", "y", "x", "v")) == want
    want = {(img, y0 + b, x0 + a, k) for img, t in tiles.items() for k, (x0, y0, w, h) in enumerate(codec.segments(t.shape[1], t.shape[0], 6)) for a in range(w) for b in range(h)}
    assert set(rows(spark, "segment_pixels", "img", "y", "x", "seg")) == want


def test_yuv422(spark):
    signal = {}
    for u, v in duckdb.sql(f"SELECT user_id, value FROM '{SF}/events.parquet' ORDER BY user_id, ts, event_id").fetchall():
        signal.setdefault(u, []).append(int(v // 1) % 256)
    want = set()
    for u, raw in signal.items():
        cb, cr = 128, 128
        for c in range((len(raw) + 1) // 2):
            if c % 2 == 0:
                cb = raw[2 * c + 1] if 2 * c + 1 < len(raw) else 128
                cr = raw[2 * c + 3] if 2 * c + 3 < len(raw) else cr
            want.add((u, c, raw[2 * c], cb, cr))
    assert set(rows(spark, "yuv422_split", "user_id", "c", "y", "u", "v")) == want


def packets(stages, channels):
    out = []
    for level in range(1, stages + 1):
        for channel in range(channels):
            for lsb in range(9):
                unit = 2**level << lsb if channels == 1 else 2 ** (level + lsb + 1) << lsb
                for band in range(4):
                    if band or level == stages:
                        out.append((2 * unit if band == 0 else unit // 2 + 1 if band == 3 else unit, band, level, lsb, channel))
    return sorted(out, key=lambda p: (-p[0], p[1], p[2], -p[3], p[4]))


def test_schedule(spark, part):
    images = [(i, 1 + i % 4) for (i,) in duckdb.sql(f"SELECT s_suppkey FROM '{SF}/supplier.parquet'").fetchall()]
    for name, channels in (("gray", 1), ("yuv", 3)):
        want = {(i, level, band, lsb, channel, p, k) for i, stages in images for k, (p, band, level, lsb, channel) in enumerate(packets(stages, channels))}
        assert set(rows(spark, f"packet_schedule_{name}", "img", "level", "subband", "lsb", "channel", "priority", "place")) == want
    quota, order = set(), set()
    for i, stages in images:
        upto = 0
        for k, (p, *_) in enumerate(packets(stages, 3)):
            upto += 28 + p % 97
            if upto <= 4096:
                quota.add((i, k, 28 + p % 97, upto))
        cut = [(seg, -band, -level, -lsb, channel, k) for seg in range(6) for k, (_, band, level, lsb, channel) in enumerate(packets(stages, 3))]
        order |= {(i, x[0], x[-1], n) for n, x in enumerate(sorted(cut), 1)}
    assert set(rows(spark, "quota_prefix", "img", "place", "n_bytes", "upto")) == quota
    assert set(rows(spark, "rearrange_order", "img", "seg", "place", "stream_place")) == order
    want = {(i, *b) for i, _ in part for b in codec.bands(33 + i % 57, 33 + i * 7 % 57, 1 + i % 4)}
    assert set(rows(spark, "subband_geometry", "img", "level", "subband", "x0", "y0", "bw", "bh")) == want
    want = {(i, k, *c) for i, _ in part for k, c in enumerate(codec.segments(3 + i % 57, 3 + i * 7 % 57, 1 + i % 9))}
    assert set(rows(spark, "partition_segments", "img", "seg", "x0", "y0", "sw", "sh")) == want


def test_packets_over_all_events(spark):
    last = {}
    for e, user, band, value in duckdb.sql(f"SELECT event_id, user_id, event_type, value FROM '{SF}/events.parquet' ORDER BY event_id").fetchall():
        last[user, band, e % 9] = (e, int(value // 1))
    want = {(*k, *x) for k, x in last.items()}
    assert set(rows(spark, "packet_dedupe", "img", "band", "plane", "seen", "payload")) == want
    assert set(rows(spark, "contiguous_planes", "img", "band", "plane", "seen", "payload")) == {x for x in want if all((x[0], x[1], p) in last for p in range(x[2], 9))}


def test_crc32_docs(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(rows(spark, "crc32_docs", "doc_id", "crc32")) == sorted((i, zlib.crc32((t or "").encode())) for i, t in docs)


def test_quota_query(spark):
    got = rows(spark, "codec_quota", "img", "n_bytes", "most_off")
    assert got and all(0 < n <= 1500 and 0 < off < 256 for _, n, off in got)


@pytest.mark.parametrize("filt", sorted("abcdefq"))
def test_inverse_walks_lines_over_batches(spark, filt):
    """Lines of all lengths, one longer than an Arrow batch, null and negative keys; halves by the codec's forward rule."""
    r = np.random.default_rng(11)
    want, halves = {}, []
    for key, n in [(None, 9), (-1, 8), *((k, k) for k in range(3, 40)), (99, 2501)]:
        x = r.integers(-300, 300, n)
        want[key] = x.tolist()
        y = codec.forward_lines(x[None, :], filt)[0].tolist()
        cut = (n + 1) // 2
        halves += [(key, i, y[i], y[cut + i] if i < n // 2 else None) for i in range(cut)]
    r.shuffle(order := np.arange(len(halves)))
    table = spark.createDataFrame([halves[i] for i in order], "key long, n long, l long, h long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = wavelet.inverse(table, ["key"], filt).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {}
    for row in sorted(rows, key=lambda row: row.i):
        assert row.i == len(got.setdefault(row.key, []))
        got[row.key].append(row.v)
    assert got == want
    assert wavelet.inverse(table.limit(0), ["key"], filt).count() == 0
