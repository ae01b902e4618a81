"""Queries of the raster and signal operators over the provided tables, each with its SQL for DuckDB."""

from pyspark.sql import functions as F

from planeloom.dialect import duck_sql, spark_sql

from . import codec, framing, geometry, jpeg, schedule, wavelet

SIGNAL = "sig AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(floor(value) AS BIGINT) AS v FROM events)"
_PIXEL = "least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT)))"
#: Tiles of 64 vectors, one a row.
RASTER = f"raster AS (SELECT img, y, x, {_PIXEL} AS v FROM vectors)"
_VECTORS = {
    "spark": "vectors AS (SELECT vec_id div 64 AS img, vec_id % 64 AS y, x, e FROM embeddings LATERAL VIEW posexplode(embedding) t AS x, e)",
    "duck": "vectors AS (SELECT vec_id // 64 AS img, vec_id % 64 AS y, unnest(range(len(embedding))) AS x, unnest(embedding) AS e FROM embeddings)",
}
RGB = "rgb AS (SELECT p_partkey AS id, CAST(p_size * 5 % 256 AS BIGINT) AS r, p_partkey % 256 AS g, p_partkey * 7 % 256 AS b FROM part)"
DIMS = "dims AS (SELECT p_partkey AS img, 33 + p_partkey % 57 AS w, 33 + p_partkey * 7 % 57 AS h, 1 + p_partkey % 4 AS stages FROM part)"
RECTS = "rects AS (SELECT p_partkey AS img, 3 + p_partkey % 57 AS w, 3 + p_partkey * 7 % 57 AS h, 1 + p_partkey % 9 AS s FROM part)"
IMAGES = "dims AS (SELECT s_suppkey AS img, 1 + s_suppkey % 4 AS stages FROM supplier)"

_one = wavelet.stage_sql("raster", "s1", "a")
_two = f"{_one},\nll1 AS (SELECT img, y, x, v FROM s1 WHERE subband = 0),{wavelet.stage_sql('ll1', 's2', 'a')},\ncoef AS (SELECT img, 1 AS level, subband, y, x, v FROM s1 WHERE subband > 0 UNION ALL SELECT img, 2, subband, y, x, v FROM s2)"
_mean = "mean AS (SELECT img, CAST(sum(v) AS BIGINT) // count(*) AS ll_mean, count(*) AS n FROM coef WHERE subband = 0 GROUP BY img)"
#: The mean by windows over the image, so that the transform is read once.
_centred = "means AS (SELECT img, level, subband, y, x, v, CAST(sum(CASE WHEN subband = 0 THEN v END) OVER (PARTITION BY img) AS BIGINT) // count(CASE WHEN subband = 0 THEN v END) OVER (PARTITION BY img) AS ll_mean FROM coef),\ncentred AS (SELECT img, level, subband, y, x, CASE WHEN subband = 0 THEN v - ll_mean ELSE v END AS v FROM means)"
_clip = lambda x: f"least(255, greatest(0, {x}))"
_found = f"found AS (SELECT user_id AS img, event_type AS band, event_id % {schedule.PLANES} AS plane, event_id AS seen, CAST(floor(value) AS BIGINT) AS payload FROM events)"
_segmented = f"{IMAGES},{schedule.packets_sql(3)},\ncut AS (SELECT *, <upto 6> AS seg FROM packets)"

#: name: (tables read, common tables, last SELECT)
_TEXTS = {
    **{f"wavelet_fwd_1d_{f}": ("events", f"{SIGNAL},{wavelet.forward_sql('sig', 'fwd', 'user_id', 'pos', f)}", "SELECT user_id, n, l AS low, h AS high FROM fwd") for f in wavelet.FILTERS},
    "wavelet_fwd_2d": ("embeddings", f"{RASTER},{_one}", "SELECT img, subband, y, x, v FROM s1"),
    "subband_energy": ("embeddings", f"{RASTER},{_two}", "SELECT img, level, subband, count(*) AS n, CAST(sum(abs(v)) AS BIGINT) AS sum_abs, CAST(sum(v * v) AS BIGINT) AS energy, max(abs(v)) AS peak FROM coef GROUP BY img, level, subband"),
    "ll_mean": ("embeddings", f"{RASTER},{_two},\n{_mean}", "SELECT img, ll_mean, n FROM mean"),
    "sign_magnitude": ("embeddings", f"{RASTER},{_two},\n{_centred}", "SELECT img, level, subband, y, x, v < 0 AS neg, abs(v) AS mag FROM centred"),
    "sign_magnitude_inverse": ("events", "sm AS (SELECT event_id, event_id % 2 = 1 AS neg, CAST(floor(value) AS BIGINT) AS mag FROM events)", "SELECT event_id, CASE WHEN neg THEN -mag ELSE mag END AS v, greatest(0, CASE WHEN neg THEN -mag ELSE mag END) AS clamped FROM sm"),
    "bitplane_stats": ("embeddings", f"{RASTER},{_two},\n{_centred}", "SELECT img, level, subband, count(*) AS n, " + ", ".join(f"CAST(sum(CASE WHEN abs(v) >= {1 << p} THEN 1 ELSE 0 END) AS BIGINT) AS plane_{p}" for p in range(schedule.PLANES)) + " FROM centred GROUP BY img, level, subband"),
    "bit_categories": ("embeddings", f"{RASTER},{_two},\n{_centred},\nplanes AS (SELECT img, level, subband, abs(v) AS mag, <upto {schedule.PLANES}> AS plane FROM centred),\nabove AS (SELECT img, level, subband, plane, mag >> (plane + 1) AS m, (mag >> plane) % 2 AS b FROM planes)", "SELECT img, level, subband, CAST(plane AS BIGINT) AS plane, CASE WHEN m < 2 THEN CAST(m AS INT) WHEN m < 4 THEN 2 ELSE 3 END AS category, count(*) AS n, CAST(sum(b) AS BIGINT) AS ones FROM above GROUP BY img, level, subband, plane, CASE WHEN m < 2 THEN CAST(m AS INT) WHEN m < 4 THEN 2 ELSE 3 END"),
    "segment_pixels": ("embeddings", f"{RASTER},\nrects AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h, 6 AS s FROM raster GROUP BY img),{geometry.SEGMENTS}", "SELECT r.img, r.y, r.x, CAST(g.seg AS BIGINT) AS seg FROM raster r JOIN segments g ON r.img = g.img AND r.x >= g.x0 AND r.x < g.x0 + g.sw AND r.y >= g.y0 AND r.y < g.y0 + g.sh"),
    "yuv422_split": (
        "events",
        f"{SIGNAL},\nby4 AS (SELECT user_id, pos // 4 AS grp, max(CASE WHEN pos % 4 = 0 THEN v % 256 END) AS b0, max(CASE WHEN pos % 4 = 1 THEN v % 256 END) AS b1, max(CASE WHEN pos % 4 = 2 THEN v % 256 END) AS b2, max(CASE WHEN pos % 4 = 3 THEN v % 256 END) AS b3 FROM sig GROUP BY user_id, pos // 4),\nuv AS (SELECT user_id, grp, b0, b2, coalesce(b1, 128) AS u, coalesce(b3, lag(b3) OVER (PARTITION BY user_id ORDER BY grp), 128) AS v FROM by4),\npixels AS (SELECT *, <upto CASE WHEN b2 IS NULL THEN 1 ELSE 2 END> AS odd FROM uv)",
        "SELECT user_id, 2 * grp + odd AS c, CASE WHEN odd = 0 THEN b0 ELSE b2 END AS y, u, v FROM pixels",
    ),
    "ycc_to_rgb": ("part", RGB, f"SELECT id, {_clip('r + 1435 * (b - 128) // 1024')} AS r, {_clip('r - (352 * (g - 128) + 731 * (b - 128)) // 1024')} AS g, {_clip('r + 1814 * (g - 128) // 1024')} AS b FROM rgb"),
    "rgb565": ("part", RGB, "SELECT id, ((r >> 3) << 11) + ((g >> 2) << 5) + (b >> 3) AS rgb565 FROM rgb"),
    **{f"raster_descale_{n}": ("embeddings", RASTER, f"SELECT img, y // {n} AS y, x // {n} AS x, CAST(sum(v) AS BIGINT) // count(*) AS v FROM raster GROUP BY img, y // {n}, x // {n}") for n in (4, 8)},
    "chroma_upsample": ("embeddings", f"{RASTER},\nchroma AS (SELECT img, y // 2 AS cy, x // 2 AS cx, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 255 - v END) AS u, max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v // 2 END) AS w FROM raster WHERE img % 2 = 0 GROUP BY img, y // 2, x // 2)", "SELECT r.img, y, x, v, coalesce(u, 128) AS u, coalesce(w, 128) AS w FROM raster r LEFT JOIN chroma c ON r.img = c.img AND r.y // 2 = c.cy AND r.x // 2 = c.cx"),
    "raster_descale": ("embeddings", RASTER, "SELECT img, y // 2 AS y, x // 2 AS x, CAST(sum(v) AS BIGINT) // count(*) AS v FROM raster GROUP BY img, y // 2, x // 2"),
    "subband_geometry": ("part", f"{DIMS},{geometry.SUBBANDS}", "SELECT img, CAST(level AS BIGINT) AS level, CAST(subband AS BIGINT) AS subband, x0, y0, bw, bh FROM subbands"),
    "partition_segments": ("part", f"{RECTS},{geometry.SEGMENTS}", "SELECT img, CAST(seg AS BIGINT) AS seg, x0, y0, sw, sh FROM segments"),
    **{f"packet_schedule_{k}": ("supplier", f"{IMAGES},{schedule.packets_sql(n)}", "SELECT img, CAST(level AS BIGINT) AS level, CAST(subband AS BIGINT) AS subband, CAST(lsb AS BIGINT) AS lsb, CAST(channel AS BIGINT) AS channel, priority, CAST(place AS BIGINT) AS place FROM packets") for k, n in (("gray", 1), ("yuv", 3))},
    "quota_prefix": ("supplier", f"{IMAGES},{schedule.packets_sql(3)},\nsized AS (SELECT img, place, CAST(28 + priority % 97 AS BIGINT) AS n_bytes, CAST(4096 AS BIGINT) AS quota FROM packets),{schedule.QUOTA}", "SELECT img, CAST(place AS BIGINT) AS place, n_bytes, upto FROM prefix"),
    "rearrange_order": ("supplier", _segmented, f"SELECT img, CAST(seg AS BIGINT) AS seg, CAST(place AS BIGINT) AS place, CAST(row_number() OVER (PARTITION BY img ORDER BY {schedule.STREAM_ORDER}) AS BIGINT) AS stream_place FROM cut"),
    "packet_dedupe": ("events", f"{_found},\n{schedule.LAST}", "SELECT img, band, plane, seen, payload FROM kept"),
    "contiguous_planes": ("events", f"{_found},\n{schedule.LAST},{schedule.CONTIGUOUS}", "SELECT img, band, plane, seen, payload FROM usable"),
}


def _text(name: str, engine: str) -> str:
    table, given, last = _TEXTS[name]
    vectors = f"{_VECTORS[engine]},\n" if table == "embeddings" else ""
    return f"WITH {vectors}{(spark_sql if engine == 'spark' else duck_sql)(given + chr(10) + last)}"


def _read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _query(name: str):
    def run(spark, sf_dir):
        _read(spark, sf_dir, _TEXTS[name][0]).createOrReplaceTempView(_TEXTS[name][0])
        return spark.sql(_text(name, "spark"))

    return run


def _back_1d(filt: str):
    def run(spark, sf_dir):
        halves = QUERIES[f"wavelet_fwd_1d_{filt}"](spark, sf_dir).withColumnsRenamed({"low": "l", "high": "h"})
        return wavelet.inverse(halves, ["user_id"], filt).select("user_id", F.col("i").cast("long").alias("i"), "v")

    return run


def _back_1d_a(spark, sf_dir):
    _read(spark, sf_dir, "events").createOrReplaceTempView("events")
    given = f"{_TEXTS['wavelet_fwd_1d_a'][1]},{wavelet.inverse_a_sql('fwd', 'back', 'user_id')}"
    return spark.sql("WITH " + spark_sql(f"{given}\nSELECT user_id, CAST(i AS BIGINT) AS i, v FROM back"))


def _back_2d(spark, sf_dir):
    return wavelet.inverse_2d(QUERIES["wavelet_fwd_2d"](spark, sf_dir), "a").select("img", *(F.col(c).cast("long").alias(c) for c in "yx"), F.greatest("v", F.lit(0)).alias("v"))


def _crc32(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("crc32"))


def _scan(spark, sf_dir):
    found = framing.scanned(framing.framed(_read(spark, sf_dir, "documents")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_records"), F.sum(F.octet_length("payload")).cast("long").alias("n_bytes"))


def _scan_damaged(spark, sf_dir):
    """Each third record of a stream is spoilt; of the others number and payload are found."""
    found = framing.scanned(framing.damaged(framing.framed(_read(spark, sf_dir, "documents"))))
    return found.select("doc_id", F.col("segment").cast("long").alias("segment"), F.md5("payload").alias("digest"))


def _tiles(spark, sf_dir, channels):
    """The raster of each image, and for colour its mirror and its negative as further channels."""
    _read(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    one = spark.sql(f"WITH {_VECTORS['spark']}, {RASTER} SELECT img, 0 AS channel, y, x, v FROM raster")
    more = [one.withColumns({"channel": F.lit(1), "v": 255 - F.col("v")}), one.withColumns({"channel": F.lit(2), "v": F.floor(F.col("v") / 2)})]
    return one.unionByName(more[0]).unionByName(more[1]) if channels > 1 else one


def _round_trip(channels, filt):
    def run(spark, sf_dir):
        streams = codec.compress(_tiles(spark, sf_dir, channels), stages=2, filt=filt, n_segments=4, channels=channels)
        return codec.decompress(streams, stages=2, filt=filt, n_segments=4)

    return run


def _dimensions(spark, sf_dir):
    return codec.dimensions(codec.compress(_tiles(spark, sf_dir, 1), stages=2, n_segments=4, quota=20_000))


def _jpeg(channels):
    """Images in which each sample is a block of 8 x 8, read at an eighth: the samples come back as they were."""

    def run(spark, sf_dir):
        files = jpeg.written(_tiles(spark, sf_dir, channels), quality=100, enlarge=8)
        return jpeg.pixels(files, scale=3)

    return run


def _jpeg_info(spark, sf_dir):
    return jpeg.info(jpeg.written(_tiles(spark, sf_dir, 3), quality=70, sampling=(2, 2))).select("img", "width", "height", "channels")


def _truncated(spark, sf_dir):
    """Streams under a quota: their bytes, records and error against the raster."""
    tiles = _tiles(spark, sf_dir, 1)
    streams = codec.compress(tiles, stages=2, n_segments=4, quota=1500)
    back = codec.decompress(streams, stages=2, n_segments=4).withColumnRenamed("v", "near")
    off = tiles.join(back, ["img", "channel", "y", "x"]).groupBy("img").agg(F.max(F.abs(F.col("v") - F.col("near"))).alias("most_off"))
    return streams.select("img", F.octet_length("stream").alias("n_bytes")).join(off, "img")


QUERIES = {name: _query(name) for name in _TEXTS} | {
    "codec_round_trip_gray": _round_trip(1, "a"),
    "codec_round_trip_yuv": _round_trip(3, "c"),
    "codec_dimensions": _dimensions,
    "jpeg_gray": _jpeg(1),
    "jpeg_colour": _jpeg(3),
    "jpeg_info": _jpeg_info,
    "codec_quota": _truncated,
    "wavelet_inv_1d_a": _back_1d_a,
    **{f"wavelet_inv_1d_{f}": _back_1d(f) for f in wavelet.FILTERS if f != "a"},
    "wavelet_inv_2d": _back_2d,
    "crc32_docs": _crc32,
    "scan_packets": _scan,
    "scan_damaged": _scan_damaged,
}
#: The inverse queries are held against the samples they started from. DuckDB has no CRC-32.
SQL = {name: _text(name, "duck") for name in _TEXTS} | {
    **{f"wavelet_inv_1d_{f}": f"WITH {SIGNAL} SELECT user_id, CAST(pos AS BIGINT) AS i, v FROM sig" for f in wavelet.FILTERS},
    "codec_round_trip_gray": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, CAST(0 AS BIGINT) AS channel, y, x, v FROM raster",
    "codec_round_trip_yuv": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, c AS channel, y, x, CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE v // 2 END AS v FROM raster, range(3) t(c)",
    "codec_dimensions": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM raster GROUP BY img",
    "wavelet_inv_2d": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, y, x, v FROM raster",
    "jpeg_gray": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, y, x, v AS r, v AS g, v AS b FROM raster",
    "jpeg_colour": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, y, x, {_clip('v + 1435 * (v // 2 - 128) // 1024')} AS r, {_clip('v - (352 * (127 - v) + 731 * (v // 2 - 128)) // 1024')} AS g, {_clip('v + 1814 * (127 - v) // 1024')} AS b FROM raster",
    "jpeg_info": f"WITH {_VECTORS['duck']}, {RASTER} SELECT img, max(x) + 1 AS width, max(y) + 1 AS height, CAST(3 AS BIGINT) AS channels FROM raster GROUP BY img",
    "scan_damaged": "WITH b AS (SELECT doc_id, encode(text) AS raw, unnest(range((octet_length(encode(text)) + 511) // 512)) AS segment FROM documents WHERE text <> '') SELECT doc_id, segment, md5(raw[segment * 512 + 1 : segment * 512 + 512]) AS digest FROM b WHERE segment % 3 <> 1",
    "scan_packets": "WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text <> '') SELECT doc_id, (n + 511) // 512 AS n_records, n AS n_bytes FROM b",
}
