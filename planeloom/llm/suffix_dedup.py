"""Removal of bytes covered by a string of LENGTH bytes that also starts elsewhere: blockwise, by a difference cover.

The cover is a perfect difference set of the residues modulo PERIOD, so any two suffixes have an offset below PERIOD at
which both stand at a cover place. Two equal strings of LENGTH bytes thus hold, at that offset, equal strings of
LENGTH - PERIOD + 1 bytes at cover places. First only the cover sample is ranked (a rank is a 64-bit hash of that
string, sorted a bucket at a time). Suffixes near a cover place whose rank is shared are the only ones that can tie
for LENGTH bytes; the others are settled by that and never move. The tying suffixes are sorted in BLOCKS passes, in
each a bucket at a time, by two unrelated 64-bit hashes of their first LENGTH bytes; of the order only equality
counts, so hashes stand for the bytes (128 bits, besides the bucket's number). Memory is bounded by a bucket and a pack.

Texts that are equal as a whole are sorted once and removed as a whole. Distinct texts are packed to about PACK bytes, cut in
pieces of PIECE starts if longer; a pack sends each unlike key once, so a passage that a third of all documents hold
is one key a pack, and a run of one byte one key. What is shared comes back as a bit for each key sent.

Null text counts as empty; documents under LENGTH bytes keep all. Very long texts are judged whole, through their pieces.
Equal rows, and rows of equal text with any ids, null ones too, are copies of each other. An empty table gives an
empty one; extra columns are kept or ignored, only names that begin with _cut_ are taken. Texts are cut at bytes, so
kept bytes may not be whole characters; kept_texts drops the rest of a cut character.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .components import dropped, stored

LENGTH, PACK, PIECE, BUCKET, BLOCKS, SALTS = 400, 1 << 19, 1 << 18, 1 << 19, 2, 16
BASE = 0x9E3779B97F4A7C15
TABLE, NAMES = (np.random.default_rng(s).integers(0, 2**64, 256, np.uint64) for s in (5, 6))
KEY = 16
_powers: dict[int, np.ndarray] = {}


@functools.cache
def difference_set(q: int) -> tuple[int, ...]:
    """For a prime q, q + 1 residues modulo q * q + q + 1 whose differences are all the others: powers of x, modulo a cubic, in a plane."""
    size = q * q + q + 1
    for a, b, c in ((a, b, c) for a in range(1, q) for b in range(q) for c in range(q)):
        x, places = (1, 0, 0), []
        for i in range(size):
            if not x[2]:
                places.append(i)
            x = (a * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + c * x[2]) % q)
        if len(places) == q + 1 and len({(s - t) % size for s in places for t in places}) == size:
            return tuple(places)
    raise ValueError("q is no prime")


@functools.cache
def cover(length: int) -> tuple[int, tuple[int, ...]]:
    """(period, residues): the largest perfect cover of up to half the length; of short lengths every place."""
    primes = [q for q in range(2, length) if q * q + q + 1 <= length // 2 and all(q % p for p in range(2, q))]
    return (primes[-1] ** 2 + primes[-1] + 1, difference_set(primes[-1])) if primes else (1, (0,))


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, PACK + PIECE), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def rolled(raw: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """A hash of the width bytes from each place in at."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[raw] * powers(BASE, n), out=sums[1:])
    h = (sums[at + width] - sums[at]) * powers(pow(BASE, -1, 2**64), n)[at]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a ^ (a >> np.uint64(31))
    h *= np.uint64(0x94D049BB133111EB)
    h += b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def named(raw: np.ndarray, width: int) -> np.ndarray:
    """Another hash of the width bytes from every place, built by doubling."""
    name, out, size, done = NAMES[raw], None, 1, 0
    while True:
        if width & size:
            out = name if out is None else _join(out[: len(name) - done], name[done:])
            done += size
        if size * 2 > width:
            return out
        name = _join(name[:-size], name[size:])
        size *= 2


def unlike(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each key one place, in order of the keys; and of each place the number of its key."""
    order = np.argsort(a, kind="stable")
    x = a[order]
    new = np.ones(len(a), bool)
    new[1:] = x[1:] != x[:-1]
    if b is not None:
        y = b[order]
        if (~new[1:] & (y[1:] != y[:-1])).any():
            order = np.lexsort((b, a))
            x, y = a[order], b[order]
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return (((a >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _edges(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)


def shared(rows: DataFrame, columns: list[str], keys, buckets: int, block: int = 0, blocks: int = 1) -> DataFrame:
    """(batch, bucket, mask): of each row's unlike keys in a bucket, in order, a bit if another row has it too.

    keys gives, of a row's columns, the keys as one or two arrays. Only buckets of this block are sorted.
    """

    def deal(batches):
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.select(["batch", *columns]).columns)):
                a, b = keys(*row)
                first, _ = unlike(a, b)
                a, b = a[first], None if b is None else b[first]
                own = bucket_of(a, buckets)
                cuts = _edges(own)
                at = [(x, y) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if own[x] % blocks == block]
                out = [[int(own[x]) for x, _ in at], [name] * len(at), [a[x:y].tobytes() for x, y in at], [b"" if b is None else b[x:y].tobytes() for x, y in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "batch", "a", "b"])

    def sort(batches):
        bucket, names, parts = None, [], []

        def close():
            sizes = [len(a) for a, _ in parts]
            a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            _, number = unlike(a, b if len(b) else None)
            hit = np.bincount(number)[number] > 1
            masks = [(n, np.packbits(h).tobytes()) for n, h in zip(names, np.split(hit, np.cumsum(sizes)[:-1])) if h.any()]
            out = pa.RecordBatch.from_arrays([pa.array([n for n, _ in masks], pa.binary()), pa.array([bucket] * len(masks), pa.int64()), pa.array([m for _, m in masks], pa.binary())], ["batch", "bucket", "mask"])
            names.clear()
            parts.clear()
            return out

        for batch in batches:
            for k, name, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if k != bucket:
                    if len(parts) > 1:
                        yield close()
                    names.clear()
                    parts.clear()
                    bucket = k
                names.append(name)
                parts.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
        if len(parts) > 1:
            yield close()

    dealt = rows.select("batch", *columns).mapInArrow(deal, "bucket long, batch binary, a binary, b binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "batch binary, bucket long, mask binary")


def hits(a: np.ndarray, b: np.ndarray | None, buckets: int, found) -> np.ndarray:
    """Of each key whether it is there twice, here or (by the masks found) elsewhere."""
    first, number = unlike(a, b)
    hit = np.bincount(number, minlength=len(first)) > 1
    own = bucket_of(a[first], buckets)
    for f in found or []:
        x, y = np.searchsorted(own, (f["bucket"], f["bucket"] + 1))
        hit[x:y] |= np.unpackbits(np.frombuffer(f["mask"], np.uint8), count=y - x).astype(bool)
    return hit[number]


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _open(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.uint8)


def packed(docs: DataFrame, length: int) -> DataFrame:
    """Distinct texts in packs: batch, n_bytes, pieces (keys, offset in the text, size), their bytes; and which texts have copies, with their sizes."""
    one = docs.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))

    def pack(batches):
        keys, at, parts, copied = [], [], [], []
        room = 0

        def row():
            nonlocal room
            places, sizes = np.array(at, np.int64).tobytes(), np.array([len(p) for p in parts], np.int64).tobytes()
            cells = [b"".join(keys), places, sizes, zstandard.compress(b"".join(parts), 1), b"".join(k for k, _ in copied), np.array([n for _, n in copied], np.int64).tobytes()]
            out = [pa.array([hashlib.sha256(cells[0] + places).digest()[:KEY]], pa.binary()), pa.array([room], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]]
            for x in (keys, at, parts, copied):
                x.clear()
            room = 0
            return pa.RecordBatch.from_arrays(out, ["batch", "n_bytes", "keys", "at", "sizes", "blob", "copied", "copied_sizes"])

        for batch in batches:
            for key, raw, n in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                if n > 1:
                    copied.append((key, len(raw)))
                for a in range(0, len(raw) - length + 1, PIECE):
                    keys.append(key)
                    at.append(a)
                    parts.append(raw[a : a + PIECE + length - 1])
                    room += len(parts[-1])
                    if room >= PACK:
                        yield row()
        if keys or copied:
            yield row()

    return one.mapInArrow(pack, "batch binary, n_bytes long, keys binary, at binary, sizes binary, blob binary, copied binary, copied_sizes binary")


def sampled(period: int, residues: tuple[int, ...], length: int):
    """Of a pack, the places of its cover sample (in the pack, and the piece of each) and their ranks."""
    width = length - period + 1
    grid = (np.arange(0, PIECE + length, period)[:, None] + np.array(residues)).ravel()

    def sample(at, sizes, blob):
        raw, sizes, at = _open(blob), _longs(sizes), _longs(at)
        places, piece, start = [], [], 0
        for i, (n, a) in enumerate(zip(sizes.tolist(), at.tolist())):
            own = grid - a % period  # residues are of the place in the whole text
            own = own[np.searchsorted(own, 0) : np.searchsorted(own, n - width, side="right")]
            places.append(own + start)
            piece.append(np.full(len(own), i))
            start += n
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        return places, np.concatenate(piece) if piece else places, rolled(raw, width, places) if len(places) else np.zeros(0, np.uint64), raw, sizes

    return sample


def tying(packs: DataFrame, length: int) -> DataFrame:
    """Regions of suffixes that may tie for length bytes: batch, n_starts, for each region key, offset in the text and number of starts; their bytes."""
    period, residues = cover(length)
    sample = sampled(period, residues, length)
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total * len(residues) // period // BUCKET))
    masks = shared(packs, ["at", "sizes", "blob"], lambda at, sizes, blob: (sample(at, sizes, blob)[2], None), buckets)
    masks = stored(masks, "cover")
    found = masks.groupBy("batch").agg(F.collect_list(F.struct("bucket", "mask")).alias("found"))

    def cut(batches):
        for batch in batches:
            for name, keys, at, sizes, blob, found in zip(*(c.to_pylist() for c in batch.columns)):
                places, piece, ranks, raw, size = sample(at, sizes, blob)
                hit = hits(ranks, None, buckets, found)
                places, piece = places[hit], piece[hit]
                start = np.cumsum(size) - size
                low, high = np.maximum(start[piece], places - period + 1), np.minimum(places, start[piece] + size[piece] - length)
                good = low <= high
                low, high, piece = low[good], high[good], piece[good]
                if not len(low):
                    continue
                new = np.flatnonzero(np.r_[True, (low[1:] > high[:-1] + 1) | (piece[1:] != piece[:-1])])
                low, high, piece = low[new], high[np.r_[new[1:] - 1, len(high) - 1]], piece[new]
                text = raw.tobytes()
                parts = b"".join(text[a : b + length] for a, b in zip(low.tolist(), high.tolist()))
                cells = [b"".join(keys[KEY * i : KEY * i + KEY] for i in piece.tolist()), (_longs(at)[piece] + low - start[piece]).tobytes(), (high - low + 1).tobytes(), zstandard.compress(parts, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([int((high - low + 1).sum())], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], ["batch", "n_starts", "keys", "at", "starts", "blob"])

    rows = packs.select("batch", "keys", "at", "sizes", "blob").join(found, "batch", "left")
    regions = stored(rows.mapInArrow(cut, "batch binary, n_starts long, keys binary, at binary, starts binary, blob binary"), "ties")
    dropped(masks)
    return regions


def suffixes(length: int):
    """Of regions, the place of each suffix in the text, its region, and the two hashes of its first length bytes."""

    def keys(at, starts, blob):
        raw, n = _open(blob), _longs(starts)
        region = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(np.cumsum(n + length - 1) - (n + length - 1), n) + within
        return _longs(at)[region] + within, region, rolled(raw, length, place), named(raw, length)[place]

    return keys


def spans(docs: DataFrame, length: int) -> DataFrame:
    """(key, a, b): bytes a to b of the texts with that key go; runs of one piece do not touch. docs: key, text of length bytes or more."""
    packs = stored(packed(docs, length), "packs")

    def whole(batches):
        for batch in batches:
            cells = list(zip(*(c.to_pylist() for c in batch.columns)))
            keys = [k[i : i + KEY] for k, _ in cells for i in range(0, len(k), KEY)]
            ends = np.concatenate([np.zeros(0, np.int64), *[_longs(n) for _, n in cells]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends * 0, pa.int64()), pa.array(ends, pa.int64())], ["key", "a", "b"])

    schema = "key binary, a long, b long"
    copies = stored(packs.select("copied", "copied_sizes").mapInArrow(whole, schema), "copies")
    regions = tying(packs, length)
    dropped(packs)
    keys = suffixes(length)
    buckets = max(BLOCKS, -(-(regions.agg(F.sum("n_starts")).first()[0] or 0) // BUCKET))
    masks = [stored(shared(regions, ["at", "starts", "blob"], lambda *row: keys(*row)[2:], buckets, k, BLOCKS), f"block{k}") for k in range(BLOCKS)]
    found = functools.reduce(DataFrame.unionByName, masks).groupBy("batch").agg(F.collect_list(F.struct("bucket", "mask")).alias("found"))

    def cut(batches):
        for batch in batches:
            for names, at, starts, blob, found in zip(*(c.to_pylist() for c in batch.columns)):
                place, region, a, b = keys(at, starts, blob)
                hit = hits(a, b, buckets, found)
                place, region = place[hit], region[hit]
                if not len(place):
                    continue
                new = np.flatnonzero(np.r_[True, (place[1:] > place[:-1] + length) | (region[1:] != region[:-1])])
                ends = place[np.r_[new[1:] - 1, len(place) - 1]] + length
                yield pa.RecordBatch.from_arrays([pa.array([names[KEY * i : KEY * i + KEY] for i in region[new].tolist()], pa.binary()), pa.array(place[new]), pa.array(ends)], ["key", "a", "b"])

    out = stored(regions.join(found, "batch", "left").select("keys", "at", "starts", "blob", "found").mapInArrow(cut, schema), "spans")
    for x in (*masks, regions):
        dropped(x)
    return out.unionByName(copies)


def joined(cuts) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted((x["a"], x["b"]) for x in ([] if cuts is None else cuts)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in cuts]]
    return b"".join(raw[x:y] for x, y in zip(ends, [*[a for a, _ in cuts], len(raw)]))


def with_cuts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with a column _cut_spans (null: nothing to remove), and others whose names begin with _cut_."""
    docs = docs.withColumn("_cut_key", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 2 * KEY)))
    found = spans(docs.where(f"octet_length(text) >= {length}").select(F.col("_cut_key").alias("key"), "text"), length)
    cuts = found.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("_cut_spans")).withColumnRenamed("key", "_cut_key")
    # a text may have copies in a third of all rows: they are dealt to SALTS tasks, and their cuts to each of these
    cuts = cuts.withColumn("_cut_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return docs.withColumn("_cut_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(cuts, ["_cut_key", "_cut_salt"], "left")


def kept_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, same columns, with the repeated bytes taken out of text; null texts and untouched ones stay as they are."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, cuts: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), cuts.to_pylist())
        return pa.array([t if c is None else kept(t.encode(), joined(c)).decode("utf-8", "ignore") for t, c in rows], pa.string())

    cut_docs = with_cuts(docs, length)
    return cut_docs.select(*[F.when(F.col("_cut_spans").isNull(), F.col("text")).otherwise(cut("text", "_cut_spans")).alias("text") if c == "text" else c for c in docs.columns])


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text, what is kept of it (cut characters dropped), of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, raw, cuts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                raw, cuts = raw or b"", joined(cuts)
                rest = kept(raw, cuts)
                rows.append((doc, len(raw), len(raw) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    cut = with_cuts(docs.select("doc_id", "text"), length).select("doc_id", "text", "_cut_spans")
    return cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
