"""The coder and the whole codec: round trips, truncation, damage, and rules written out once more in Python."""

import random

import numpy as np
import pytest

from planeloom.operators import codec, coding, framing, wavelet
from tests.test_operators import LINES, forward

R = random.Random(5)


def test_words_are_prefix_free_and_complete():
    for words in coding.CODES:
        out = sorted(words.values())
        assert not any(b.startswith(a) for a, b in zip(out, out[1:]))
        assert sum(2.0 ** -len(a) for a in words) == pytest.approx(1)


def test_bins():
    assert [coding.bin_of(z, 100) for z in (50, 54, 100)] == [0, 1, 16]
    for _ in range(200):
        total = R.randint(2, 500)
        zeros = R.randint((total + 1) // 2, total)
        assert coding.bin_of(zeros, total) == max([i + 1 for i, c in enumerate(coding.CUTOFFS) if zeros * 65536 >= total * c], default=0)


@pytest.mark.parametrize("subband", range(4))
def test_segments_come_back_and_truncate(subband):
    for spread in (1, 12, 150):
        w, h = R.randint(1, 40), R.randint(1, 40)
        values = [max(-511, min(511, int(R.gauss(0, spread)))) for _ in range(w * h)]
        planes = {p: (a, n) for p, a, n in coding.encode_segment(values, w, h, subband)}
        assert coding.decode_segment(planes, w, h, subband) == values
        for lowest in (3, 6):
            part = {p: x for p, x in planes.items() if p >= lowest}
            assert coding.decode_segment(part, w, h, subband) == [(abs(v) >> lowest << lowest) * (1 if v > 0 else -1) for v in values]
        cut = dict(planes)
        cut[2] = (planes[2][0][:1], min(8, planes[2][1]))
        assert len(coding.decode_segment(cut, w, h, subband)) == w * h
    with pytest.raises(ValueError, match="INTEGER_OVERFLOW"):
        coding.encode_segment([512], 1, 1, subband)


def test_a_full_ring_is_filled_up():
    values = [0] * 20_000
    for i in range(0, 20_000, 3):
        values[i] = R.choice([0, 0, 1, -1, 300, -200])
    planes = {p: (a, n) for p, a, n in coding.encode_segment(values, 200, 100, 1)}
    assert coding.decode_segment(planes, 200, 100, 1) == values


@pytest.mark.parametrize("filt", wavelet.FILTERS)
def test_lines_and_stages(filt):
    for line in LINES.values():
        low, high = forward(line, filt)
        y = codec.forward_lines(np.array([line, line[::-1]]), filt)
        assert y[0].tolist() == low + high
        assert codec.inverse_lines(y, filt)[0].tolist() == line
    for h, w, stages in ((12, 24, 2), (33, 47, 3), (3, 9, 0), (41, 20, 1)):
        x = np.array([[R.randrange(256) for _ in range(w)] for _ in range(h)])
        assert (codec.inverse(codec.forward(x, stages, filt), stages, filt) == x).all()
    with pytest.raises(ValueError, match="TOO_MANY_STAGES"):
        codec.forward(np.zeros((16, 9)), 3, filt)


def test_segments_tile():
    for w in range(3, 40, 5):
        for h in range(3, 40, 4):
            for s in range(1, 17):
                if s <= w * h:
                    places = [(x, y) for x0, y0, sw, sh in codec.segments(w, h, s) for x in range(x0, x0 + sw) for y in range(y0, y0 + sh)]
                    assert len(codec.segments(w, h, s)) == s and len(places) == w * h == len(set(places))
    with pytest.raises(ValueError, match="TOO_MANY_SEGMENTS"):
        codec.segments(2, 2, 5)


@pytest.fixture(scope="module")
def images(spark):
    rows = [(i, c, y, x, (x * 5 + y * 3 + c * 40 + R.randrange(30)) % 200) for i, (w, h) in enumerate(((33, 20), (24, 41))) for c in range(3) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img long, channel long, y long, x long, v long")


def sorted_rows(df):
    return sorted(map(tuple, df.select("img", "channel", "y", "x", "v").collect()))


def test_colour_round_trip_quota_and_damage(spark, images):
    whole = {r.img: bytes(r.stream) for r in codec.compress(images, stages=2, filt="b", n_segments=5, channels=3).collect()}
    table = lambda streams: spark.createDataFrame([(i, bytearray(s)) for i, s in streams.items()], "img long, stream binary")
    back = lambda streams: codec.decompress(table(streams), stages=2, filt="b", n_segments=5)
    want = sorted_rows(images)
    assert sorted_rows(back(whole)) == want
    # order and repeats do not count: the last whole record does
    records = {i: [s[at : at + framing.SIZE + len(p)] for at, _, p in framing.scan(s)] for i, s in whole.items()}
    mixed = {i: b"".join(R.sample(x, len(x)) + x[:9]) for i, x in records.items()}
    assert sorted_rows(back(mixed)) == want
    # a flipped byte spoils its own segment only; the call goes on
    bad = bytearray(whole[0])
    bad[framing.SIZE + 2] ^= 1
    got = sorted_rows(back({0: bytes(bad), 1: whole[1]}))
    assert [r for r in got if r[0] == 1] == [r for r in want if r[0] == 1] and len(got) == len(want)
    # a stream cut short, and one of noise
    assert len(sorted_rows(back({0: whole[0][: len(whole[0]) // 2], 1: b"noise"}))) == sum(r[0] == 0 for r in want)
    sizes, errors = [], []
    for quota in (4000, 9000, 10**9):
        small = codec.compress(images, stages=2, filt="b", n_segments=5, channels=3, quota=quota)
        streams = {r.img: bytes(r.stream) for r in small.collect()}
        assert all(len(s) <= quota for s in streams.values())
        sizes.append(len(streams[0]))
        near = sorted_rows(codec.decompress(table(streams), stages=2, filt="b", n_segments=5))
        errors.append(sum(abs(a[4] - b[4]) for a, b in zip(near, want) if a[0] == 0 == b[0]))
    assert sizes == sorted(sizes) and errors == sorted(errors, reverse=True) and errors[-1] == 0
    assert {(r.img, r.w, r.h) for r in codec.dimensions(table(whole)).collect()} == {(0, 33, 20), (1, 24, 41)}
    with pytest.raises(ValueError, match="PACKET_COUNT_EXCEEDED"):
        codec.compress(images, stages=10, channels=3)
