import random
import zlib

import duckdb
import numpy as np
import pytest

from planeloom.dialect import duck_sql
from planeloom.operators import catalog, codec, framing, geometry, wavelet


def forward(x, filt):
    """The rule of the forward transform, one sample after the other."""
    p, a, b, c = wavelet.FILTERS[filt]
    pairs = len(x) // 2
    low = [(x[2 * i] + x[2 * i + 1]) // 2 for i in range(pairs)] + x[2 * pairs :]
    d = [x[2 * i] - x[2 * i + 1] for i in range(pairs)] + [0]
    r = lambda i: 1 if i == 0 else low[i - 1] - low[i]
    high = []
    for i in range(pairs):
        if i == 0:
            s = r(1) // 4
        elif i == 1 and p and len(low) > 2:
            s = (2 * r(1) + 3 * r(2) - 2 * d[2] + 4) // 8
        elif len(x) % 2 == 0 and i == pairs - 1:
            s = r(i) // 4
        else:
            s = (p * r(i - 1) + a * r(i) + b * r(i + 1) - c * d[i + 1] + 8) // 16
        high.append(d[i] - s)
    return low, high


_random = random.Random(7)
LINES = {n: [_random.randrange(256) for _ in range(n)] for n in range(3, 65)}


@pytest.mark.parametrize("filt", wavelet.FILTERS)
def test_forward_sql_equals_rule_and_inverse_restores(filt):
    con = duckdb.connect()
    con.execute("CREATE TABLE sig (k INT, pos BIGINT, v BIGINT)")
    con.execute("INSERT INTO sig VALUES " + ", ".join(f"({k}, {i}, {v})" for k, line in LINES.items() for i, v in enumerate(line)))
    got = con.sql("WITH " + duck_sql(wavelet.forward_sql("sig", "f", "k", "pos", filt)) + " SELECT k, n, l, h FROM f ORDER BY k, n").fetchall()
    for k, line in LINES.items():
        low, high = forward(line, filt)
        rows = [r for r in got if r[0] == k]
        assert [r[2] for r in rows] == low
        assert [r[3] for r in rows if r[3] is not None] == high
        assert codec.inverse_lines(np.array([low + high]), filt)[0].tolist() == line


def test_segments_tile():
    con = duckdb.connect()
    con.execute("CREATE TABLE rects AS SELECT w * 10000 + h * 100 + s AS img, w, h, s FROM range(3, 40, 4) a(w), range(3, 40, 3) b(h), range(1, 17) c(s) WHERE s <= w * h")
    got = {}
    for img, x0, y0, sw, sh in con.sql("WITH " + duck_sql(geometry.SEGMENTS) + " SELECT img, x0, y0, sw, sh FROM segments").fetchall():
        got.setdefault(img, []).append((x0, y0, sw, sh))
    assert len(got) == con.sql("FROM rects").shape[0]
    for img, cells in got.items():
        w, h, s = img // 10000, img // 100 % 100, img % 100
        places = [(x, y) for x0, y0, sw, sh in cells for x in range(x0, x0 + sw) for y in range(y0, y0 + sh)]
        assert len(cells) == s and len(places) == w * h == len(set(places)) and max(places)[0] == w - 1


def test_scan_passes_over_damage():
    parts = [framing.record(bytes([i]) * 50, segment=i) for i in range(4)]
    parts[1] = parts[1][:40] + b"?" + parts[1][41:]
    stream = b"noise\x5b\x60" + b"".join(parts) + parts[0][:20]
    assert [(f[4], p) for _, f, p in framing.scan(stream)] == [(i, bytes([i]) * 50) for i in (0, 2, 3)]
    assert list(framing.scan(b"")) == []


def test_crc32_and_inverse_of_null_text(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "doc_id long, text string")
    rows = framing.scanned(framing.framed(docs)).collect()
    assert [(r.doc_id, bytes(r.payload)) for r in rows] == [(1, b"abc")]
    assert spark.sql("SELECT crc32(encode('abc', 'utf-8')) AS c").first().c == zlib.crc32(b"abc")


def test_packets_of_all_events_and_planned_gaps(spark, tmp_path):
    rows = [(e, 1, "a", e / 2) for e in (8, 7, 5, 4)]  # no plane 6
    rows += [(e, 2, "a", 1.0) for e in (7, 6, 5)]  # no top plane
    rows += [(e, 3, "b", e + 0.5) for e in (8, 17, 35, 14, 16, 25)]  # plane 8 three times, last by 35; 14 is its only plane 5
    rows += [(e, 4, "c", 0.0) for e in (63 - k for k in range(1, 10))]  # all planes, from 62 down to 54
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    last = {}
    for e, user, band, value in sorted(rows):
        last[user, band, e % 9] = (e, int(value // 1))
    want = {(u, b, p, *x) for (u, b, p), x in last.items()}
    got = {name: catalog.QUERIES[name](spark, str(tmp_path)).select("img", "band", "plane", "seen", "payload").collect() for name in ("packet_dedupe", "contiguous_planes")}
    assert sorted(map(tuple, got["packet_dedupe"])) == sorted(want)
    usable = {x for x in want if all((x[0], x[1], p) in last for p in range(x[2], 9))}
    assert sorted(map(tuple, got["contiguous_planes"])) == sorted(usable)
    assert {(r.img, r.plane) for r in got["contiguous_planes"]} == {(1, 8), (1, 7), (3, 8), (3, 7), *((4, p) for p in range(9))}
