"""Baseline JPEG images to pixels and back, as an image source for the raster operators.

The frame is read by markers; a scan's coefficients fill one array a component, and dequantising, the cosine transform,
chroma upsampling and colour run in NumPy over whole images. An image is a row and a task's work; pixels leave in slices.

Baseline only, eight bits, one or three components in one scan, luma 1x1, 2x1 or 2x2 to chroma. Errors are ValueErrors
that begin with JPEG_UNSUPPORTED (a form that is not read) or JPEG_DAMAGED. Scale s halves both sides s times: means of whole RGB
boxes rounded down, for s = 3 the blocks' means alone. Sides are divided rounding down. The cosine transform is
in floating point, so a sample may differ by one from an integer one.
"""

import heapq
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_U, _X = np.mgrid[:8, :8]
COSINE = np.where(_U == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _X + 1) * _U * np.pi / 16))
SLICE = 1 << 16


def _lengths_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next, 256 times the code's length plus its symbol; 0 where no code fits."""
    out, at, k = np.zeros(1 << 16, np.int32), 0, 0
    for n, many in enumerate(counts, 1):
        for s in symbols[k : k + many]:
            out[at : at + (1 << 16 - n)] = n << 8 | s
            at += 1 << 16 - n
        k += many
    if at > 1 << 16 or k > len(symbols):
        raise ValueError("JPEG_DAMAGED: code lengths do not fit")
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data.replace(b"\xff\0", b"\xff") + bytes(4), 0, 0
        self.end = 8 * (len(self.data) - 4)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table) -> int:
        e = table[self.peek()]
        self.at += e >> 8
        if not e or self.at > self.end:
            raise ValueError("JPEG_DAMAGED: no such code, or the scan ends early")
        return e & 255

    def value(self, n: int) -> int:
        v = self.peek() >> (16 - n)
        self.at += n
        if self.at > self.end:
            raise ValueError("JPEG_DAMAGED: the scan ends early")
        return v if v >> (n - 1) else v - (1 << n) + 1


def frame(raw: bytes) -> dict:
    """Size, components (id, h, v, quantiser), tables and scan of an image."""
    out = {"quant": {}, "code": {}, "restart": 0, "parts": None}
    if raw[:2] != b"\xff\xd8":
        raise ValueError("JPEG_DAMAGED: no start of image")
    at = 2
    try:
        while True:
            if raw[at] != 255:
                raise ValueError("JPEG_DAMAGED: no marker where one is due")
            kind = raw[at + 1]
            if kind == 255:
                at += 1
                continue
            n = struct.unpack_from(">H", raw, at + 2)[0]
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if at > len(raw):
                raise ValueError("JPEG_DAMAGED: cut short")
            if kind == 0xC0:
                bits, h, w, many = struct.unpack_from(">BHHB", body)
                out |= {"w": w, "h": h, "parts": [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * many, 3)]}
                luma = out["parts"][0][1:3] if many else None
                if bits != 8 or not w or not h or many not in (1, 3) or many == 3 and (luma not in ((1, 1), (2, 1), (2, 2)) or any(p[1:3] != (1, 1) for p in out["parts"][1:])):
                    raise ValueError("JPEG_UNSUPPORTED: depth, size, components or sampling")
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) or kind == 0xD9:
                raise ValueError("JPEG_UNSUPPORTED: not a baseline image of one scan")
            elif kind == 0xDB:
                while body:
                    if body[0] >> 4 or len(body) < 65:
                        raise ValueError("JPEG_UNSUPPORTED: quantisers of 16 bits")
                    out["quant"][body[0]], body = np.frombuffer(body, np.uint8, 64, 1).astype(np.float64), body[65:]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    out["code"][body[0]], body = _lengths_table(body[1:17], body[17 : 17 + n]).tolist(), body[17 + n :]
            elif kind == 0xDD:
                out["restart"] = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                if out["parts"] is None or body[0] != len(out["parts"]):
                    raise ValueError("JPEG_UNSUPPORTED: components in several scans")
                named = {body[i]: (body[i + 1] >> 4, 16 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
                out["scan"] = [(*p[1:], *(out["code"][k] for k in named[p[0]])) for p in out["parts"]]
                out["data"] = raw[at:]
                if any(p[2] not in out["quant"] for p in out["scan"]):
                    raise ValueError("JPEG_DAMAGED: a quantiser is missing")
                return out
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("JPEG_DAMAGED: cut short or a table is missing") from e


def _runs(data: bytes) -> list[bytes]:
    """The scan cut at its restart markers, up to the next other marker."""
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        kind = data[at + 1] if at + 1 < len(data) else 0xD9
        if 0xD0 <= kind <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        elif kind:
            return [*out, data[start:at]]
        at += 2
    return [*out, data[start:]]


def planes(raw: bytes) -> tuple[int, int, list[tuple[int, int, np.ndarray]]]:
    """Width, height and of each component h, v and its blocks of dequantised coefficients (rows, columns, 8, 8)."""
    f = frame(raw)
    scan = [(1, 1, *f["scan"][0][2:])] if len(f["scan"]) == 1 else f["scan"]
    mw, mh = -(-f["w"] // (8 * scan[0][0])), -(-f["h"] // (8 * scan[0][1]))
    coef = [np.zeros((mh * v, mw * h, 64), np.float64) for h, v, *_ in scan]
    runs, per = _runs(f["data"]), f["restart"] or mw * mh
    if len(runs) < -(-mw * mh // per):
        raise ValueError("JPEG_DAMAGED: restarts are missing")
    for start, run in zip(range(0, mw * mh, per), runs):
        bits, last = _Bits(run), [0] * len(scan)
        for m in range(start, min(start + per, mw * mh)):
            for c, (h, v, _, dc, ac) in enumerate(scan):
                for b in range(h * v):
                    block = coef[c][m // mw * v + b // h, m % mw * h + b % h]
                    if n := bits.symbol(dc):
                        if n > 11:
                            raise ValueError("JPEG_DAMAGED: a difference is too long")
                        last[c] += bits.value(n)
                    block[0], k = last[c], 1
                    while k < 64 and (s := bits.symbol(ac)):
                        k += s >> 4
                        if s & 15:
                            if k > 63:
                                raise ValueError("JPEG_DAMAGED: a block has over 64 coefficients")
                            block[ZIGZAG[k]] = bits.value(s & 15)
                        k += 1
    raster = np.empty(64)
    out = []
    for (h, v, q, *_), c in zip(scan, coef):
        raster[ZIGZAG] = f["quant"][q]
        out.append((h, v, (c * raster).reshape(*c.shape[:2], 8, 8)))
    return f["w"], f["h"], out


def _flat(blocks: np.ndarray) -> np.ndarray:
    """Blocks side by side."""
    return blocks.swapaxes(1, 2).reshape(blocks.shape[0] * blocks.shape[2], -1)


def decode(raw: bytes, scale: int = 0) -> np.ndarray:
    """The (height, width, 3) bytes of an image, red, green, blue."""
    w, h, parts = planes(raw)
    side = 1 if scale == 3 else 8
    ycc = []
    for ph, pv, c in parts:
        samples = c[:, :, :1, :1] / 8 if side == 1 else COSINE.T @ c @ COSINE
        flat = np.clip(np.floor(_flat(samples) + 128.5), 0, 255).astype(np.int64)
        ycc.append(flat.repeat(parts[0][1] // pv, 0).repeat(parts[0][0] // ph, 1))
    y, u, v = (*ycc, *[np.full_like(ycc[0], 128)] * 2)[:3]
    part = lambda n: np.sign(n) * (abs(n) // 1024)  # noqa: E731  # fixed values: weights in 1024ths, rounded to zero
    rgb = np.stack([y + part(1435 * (v - 128)), y - part(352 * (u - 128) + 731 * (v - 128)), y + part(1814 * (u - 128))], 2)
    rgb = np.clip(rgb, 0, 255)[: h if side == 8 else h >> 3, : w if side == 8 else w >> 3]
    if scale in (1, 2):
        n = 1 << scale
        rgb = rgb[: h // n * n, : w // n * n].reshape(h // n, n, w // n, n, 3).sum((1, 3)) // (n * n)
    return rgb.astype(np.uint8)


def _code(counts: Counter) -> tuple[bytes, bytes, dict]:
    """Lengths, symbols and codes of at most 16 bits by counts; no code is all ones."""
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, 256, (256,))]
        heapq.heapify(heap)
        depth = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            depth.update(a[2] + b[2])
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= 16:
            break
        counts = Counter({s: (n + 1) // 2 for s, n in counts.items()})
    order = sorted(counts, key=lambda s: (depth[s], s))
    codes, code, size = {}, 0, 0
    for s in order:
        code, size = code << (depth[s] - size), depth[s]
        codes[s] = format(code, f"0{size}b")
        code += 1
    return bytes(sum(depth[s] == n for s in order) for n in range(1, 17)), bytes(order), codes


def _bits(v: int) -> str:
    n = abs(v).bit_length()
    return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def encode(channels: list[np.ndarray], quality: int = 90, sampling: tuple[int, int] = (1, 1), restart: int = 0) -> bytes:
    """A baseline image of a gray channel or of Y, Cb, Cr (0 to 255, one size), its codes fitted to it.

    The quantiser of u, v is 1 + (u + v + 1) * (100 - quality) // 8, at most 255; 100 divides by nothing.
    """
    h, w = channels[0].shape
    quant = np.clip(1 + (_U + _X + 1) * (100 - quality) // 8, 1, 255)
    fh, fv = sampling if len(channels) == 3 else (1, 1)
    mw, mh = -(-w // (8 * fh)), -(-h // (8 * fv))
    coef = []
    for c, x in enumerate(channels):
        x = np.pad(np.asarray(x, np.float64), ((0, mh * 8 * fv - h), (0, mw * 8 * fh - w)), "edge")
        if c:
            x = x.reshape(mh * 8, fv, mw * 8, fh).mean((1, 3))
        x = x.reshape(x.shape[0] // 8, 8, -1, 8).swapaxes(1, 2) - 128
        coef.append(np.rint(COSINE @ x @ COSINE.T / quant).astype(int).reshape(*x.shape[:2], 64)[:, :, ZIGZAG].tolist())
    runs, per = [], restart or mw * mh
    for m in range(mw * mh):
        if m % per == 0:
            runs.append([])
            last = [0] * len(channels)
        for c in range(len(channels)):
            a, b = (fh, fv) if c == 0 else (1, 1)
            for i in range(a * b):
                block = coef[c][m // mw * b + i // a][m % mw * a + i % a]
                step, last[c] = block[0] - last[c], block[0]
                runs[-1].append((0, abs(step).bit_length(), _bits(step)))
                k = 0
                for at in [i for i in range(1, 64) if block[i]]:
                    for _ in range((at - k - 1) // 16):
                        runs[-1].append((1, 0xF0, ""))
                    runs[-1].append((1, (at - k - 1) % 16 << 4 | abs(block[at]).bit_length(), _bits(block[at])))
                    k = at
                if k < 63:
                    runs[-1].append((1, 0, ""))
    tables = [_code(Counter(s for run in runs for t, s, _ in run if t == kind) or Counter([0])) for kind in (0, 1)]
    mark = lambda kind, body: struct.pack(">BBH", 255, kind, len(body) + 2) + body
    n = len(channels)
    out = b"\xff\xd8" + mark(0xDB, b"\0" + bytes(quant.ravel()[ZIGZAG].tolist()))
    out += mark(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, fh << 4 | fv if c == 0 else 0x11, 0]) for c in range(n)))
    out += b"".join(mark(0xC4, bytes([kind << 4]) + t[0] + t[1]) for kind, t in enumerate(tables))
    out += mark(0xDD, struct.pack(">H", restart)) if restart else b""
    out += mark(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\0\x3f\0")
    for i, run in enumerate(runs):
        text = "".join(tables[t][2][s] + more for t, s, more in run)
        text += "1" * (-len(text) % 8)
        out += (bytes([255, 0xD0 + (i - 1) % 8]) if i else b"") + int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
    return out + b"\xff\xd9"


def read(spark, folder: str) -> DataFrame:
    """(img, content) of the files below a folder; img is the path."""
    return spark.read.format("binaryFile").load(folder).selectExpr("path AS img", "content")


def info(images: DataFrame) -> DataFrame:
    """(img, width, height, channels, error) of each image of (img, content) by its head; the rest is null where there is an error."""

    def run(batches):
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                try:
                    f = frame(raw or b"")
                    rows.append((f["w"], f["h"], len(f["parts"]), None))
                except ValueError as e:
                    rows.append((None, None, None, str(e).split(":")[0]))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()]))], ["img", "width", "height", "channels", "error"])

    return images.select("img", "content").mapInArrow(run, f"img {images.schema['img'].dataType.simpleString()}, width long, height long, channels long, error string")


def pixels(images: DataFrame, scale: int = 0) -> DataFrame:
    """(img, y, x, r, g, b) of (img, content). Null, damaged and unsupported images give no rows; info names them."""

    def run(batches):
        for b in batches:
            for img, raw in zip(b.column(0), b.column(1).to_pylist()):
                try:
                    rgb = decode(raw or b"", scale)
                except ValueError:
                    continue
                flat, w = rgb.reshape(-1, 3).astype(np.int64), rgb.shape[1]
                for i in range(0, len(flat), SLICE):
                    at = np.arange(i, min(i + SLICE, len(flat)))
                    yield pa.RecordBatch.from_arrays([pa.array([img.as_py()] * len(at), b.column(0).type), pa.array(at // w), pa.array(at % w), *(pa.array(flat[at, c]) for c in range(3))], ["img", "y", "x", "r", "g", "b"])

    return images.select("img", "content").mapInArrow(run, f"img {images.schema['img'].dataType.simpleString()}, y long, x long, r long, g long, b long")


def written(raster: DataFrame, quality: int = 90, sampling: tuple[int, int] = (1, 1), enlarge: int = 1) -> DataFrame:
    """(img, content) of (img, channel, y, x, v): gray for one channel, else Y, Cb, Cr. enlarge repeats each sample in both directions."""

    def run(rows: pa.Table) -> pa.Table:
        img, c, y, x, v = (rows.column(k).to_numpy() for k in ("img", "channel", "y", "x", "v"))
        out = np.zeros((int(c.max()) + 1, int(y.max()) + 1, int(x.max()) + 1), np.int64)
        out[c, y, x] = v
        content = encode(list(out.repeat(enlarge, 1).repeat(enlarge, 2)), quality, sampling)
        return pa.table({"img": pa.array(img[:1]), "content": pa.array([content], pa.binary())})

    return raster.select("img", "channel", "y", "x", "v").groupBy("img").applyInArrow(run, "img long, content binary")
