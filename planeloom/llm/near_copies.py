"""Near copies: rows whose texts' sets of WIDTH-word shingles have a Jaccard similarity of LEAST or more, and chains of such.

Candidates come from SimHash links over shingles of that width and from MinHash bands: BANDS keys of ROWS minima each, so
that a pair at 0.8 shares no key with a chance of (1 - 0.8 ** 4) ** 32, 5 in 100 million. (SimHash alone has pairs at 0.8
at distances up to 13 of 64 bits, where a grid of cells no longer tells texts apart.) Texts joined by candidates are a
group. Groups over CHUNK texts or VOLUME shingles are cut into chunks, and every pair of chunks is a task's work, so no
group is one task's burden, be it of many texts or of very long ones. Of two chunks' texts every pair not yet joined is compared exactly, if their sizes can reach LEAST; the
joins of all pairs of chunks give the classes.

Texts are told apart by a 128-bit hash of their words in lower case; texts without words are copies of each other. Each
text goes once, compressed, to its sketch and, if it has candidates, to its group.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .components import components, dropped, stored

WIDTH, LEAST, BANDS, ROWS, CHUNK, VOLUME = 5, 0.8, 32, 4, 1024, 1 << 21
_random = np.random.default_rng(11)
_A, _B = (_random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def hashed(words: bytes, width: int = WIDTH) -> np.ndarray:
    """The hashed shingles in order."""
    return np.concatenate([np.zeros(0, np.uint64), *simhash.hashes(words.split(), width)])


def shingles(text: str | bytes | None, width: int = WIDTH) -> np.ndarray:
    """The hashed shingles, sorted and each once."""
    return np.unique(hashed(text if isinstance(text, bytes) else normal(text), width))


def normal(text: str | None) -> bytes:
    """The words in lower case (A-Z only), joined by single spaces."""
    return b" ".join((text or "").encode().lower().split())


def bands(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 2048):
        least = np.minimum(least, (grams[at : at + 2048, None] * _A + _B).min(axis=0))
    least = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ (key >> np.uint64(29)) ^ least[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    m, n = sorted((len(a), len(b)))
    if m < least * n - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (m + n - both) - 1e-9


def joined(sets: list[np.ndarray], least: float = LEAST) -> list[int]:
    """Of each set the first index of its group: groups are chains of pairs with a similarity of least or more."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    groups: list[list[int]] = []
    for i in order:
        own, rest = [i], []
        for g in groups:
            if any(similar(sets[i], sets[j], least) for j in reversed(g)):
                own += g
            else:
                rest.append(g)
        groups = [*rest, sorted(own, key=lambda j: (len(sets[j]), j))]
    out = [0] * len(sets)
    for g in groups:
        for i in g:
            out[i] = min(g)
    return out


def _groups(batches):
    """Rows come ordered by (root, x, y), a pair of chunks: with (key, blob). Gives links (a, b) that join near copies."""
    pair, keys, sets = None, [], []

    def close():
        ends = [(keys[f], k) for k, f in zip(keys, joined(sets)) if keys[f] != k]
        keys.clear()
        sets.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.binary()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for *at, key, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if at != pair:
                yield close()
                pair = at
            keys.append(key)
            sets.append(shingles(zstandard.decompress(blob)))
    yield close()


def _sketch(batches):
    for b in batches:
        rows = []
        for id, text, row in zip(*(c.to_pylist() for c in b.columns)):
            words = normal(text)
            h = hashed(words)
            grams = np.unique(h)
            rows.append((id, row, xxhash.xxh3_128_digest(words), simhash.majority([h]), bands(grams) if len(grams) else [], len(grams), zstandard.compress(words, 1)))
        cols = list(zip(*rows)) or [[]] * 7
        fps = np.array(cols[3], np.uint64).view(np.int64)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols[:3], fps, *cols[4:]], kinds)], ["id", "row", "key", "fp", "bands", "grams", "blob"])


def classes(docs: DataFrame) -> DataFrame:
    """(first, class): of each distinct text its first row, as a struct that orders rows, and the class of its near copies.

    docs: id, text, row (a hash that tells rows apart). Null ids come last, equal ids by row.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    rows = docs.select("id", "text", "row").mapInArrow(_sketch, "id long, row long, key binary, fp long, bands array<long>, grams long, blob binary")
    texts = stored(rows.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("grams").alias("grams"), F.first("blob").alias("blob"), F.min(order).alias("first")), "sketches")
    cells = texts.select(F.explode("bands").alias("cell"), "key")
    shared = cells.groupBy("cell").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1")
    edges = cells.join(shared, "cell").where("key != a").select("a", F.col("key").alias("b")).distinct()
    # fingerprints within RADIUS, and texts of one fingerprint
    worded = texts.where("size(bands) > 0").select("fp", "key")
    prints = stored(worded.groupBy("fp").agg(F.min("key").alias("key")), "prints")
    own = worded.join(prints.withColumnRenamed("key", "a"), "fp").where("key != a").select("a", F.col("key").alias("b"))
    ends = [prints.select(F.col("fp").alias(x), F.col("key").alias(f"key_{x}")) for x in "ab"]
    far = simhash.links(prints).join(ends[0], "a").join(ends[1], "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    roots = stored(components(stored(edges.unionByName(own).unionByName(far), "candidates")), "roots")
    roots_of = roots.withColumnRenamed("node", "key")
    sizes = roots_of.join(texts.select("key", "grams"), "key").groupBy("root")
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("grams") / VOLUME, F.lit(1.0))).cast("int").alias("chunks"))
    near = roots_of.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    near = near.join(texts.select("key", "blob"), "key").withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    near = near.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "key", "blob")
    links = near.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(_groups, "a binary, b binary")
    named = components(stored(links, "links")).withColumnsRenamed({"node": "key", "root": "class"})
    out = stored(texts.select("key", "first").join(named, "key", "left").select("first", F.coalesce("class", "key").alias("class")), "classes")
    for x in (texts, prints, roots):
        dropped(x)
    return out


def firsts(docs: DataFrame) -> DataFrame:
    """docs, same columns, with one row of each class of near copies: the smallest doc_id, null ids last, then the smaller hash of the row."""
    row = F.xxhash64(*docs.columns)
    own = classes(docs.select(F.col("doc_id").alias("id"), "text", row.alias("row")))
    kept = own.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"), F.coalesce("first.id", F.lit(0).cast("long")).alias("_id"))
    rows = docs.withColumns({"_row": row, "_id": F.coalesce("doc_id", F.lit(0).cast("long"))}).join(kept, ["_row", "_id"], "left_semi")
    return rows.dropDuplicates(["_row", "_id"]).select(*docs.columns)  # rows equal in all columns
