"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments; the popcounts of the segments are a vector whose Manhattan distance is
never over the Hamming distance. The grid is over segments of 2 bits, in groups: two vectors within RADIUS (4) of each
other agree wholly in all groups but 4 at most, so the grid has a cell for each choice of all but 4 groups and their
popcounts, and close pairs share a cell. More fingerprints get more groups, so that cells stay small; any number is exact. In a
cell, vectors are ordered by their total popcount; pairs over the radius in it, then pairs over it by the Manhattan
distance over segments of 16 bits, are dropped, and the others verified by exact Hamming distance. Each cell gives a spanning forest of
its links only, so a group of copies never turns into all its pairs. Cells over CELL fingerprints are cut into
chunks, and pairs of chunks are dealt to tasks on their own: no cell is one task's burden and no link is lost.

Only distinct fingerprints are compared; rows get their component back by a join on the fingerprint. Null or empty
text has fingerprint zero, which links like any other. Repeated rows each give a row; extra columns are ignored.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components, stored

RADIUS, CELL = 4, 4096
#: Rows of cells a task sorts; tasks a component's rows are dealt to.
SHARE, SALTS = 1 << 16, 16
BLOCK = 1 << 16


def hashes(words: list[bytes], width: int, seed: int = 42):
    """Arrays of the hashed shingles of a text, repeats included, BLOCK at a time; of fewer words the whole sequence."""
    n = max(1, len(words) - width + 1) if words else 0
    for at in range(0, n, BLOCK):
        yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(at, min(n, at + BLOCK))), np.uint64)


def majority(parts) -> int:
    """The bits that are set in over half of the hashes; zero of none."""
    sums, n = np.zeros(64, np.int64), 0
    for h in parts:
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist())


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    return majority(hashes((text or "").encode().lower().split(), width, seed))  # bytes: A-Z only, and ASCII white space


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The embedding, packed: the popcount of each 2-bit segment in that segment's place."""
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + ((fps >> np.uint64(1)) & odd)


def bands_for(n: int) -> int:
    """Groups for n fingerprints: six up to 2 ** 19, then one more for each 4 bits."""
    return 6 + max(0, -(-((max(n, 1) - 1).bit_length() - 19) // 4))


def segments(fps: np.ndarray) -> np.ndarray:
    """The embedding over segments of 16 bits, a row each."""
    return np.bitwise_count(fps.astype("<u8").view("<u2").reshape(-1, 4)).astype(np.int8)


def cells(fps: np.ndarray, bands: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Index of fingerprint and key of cell, for each choice of groups."""
    vec, cuts = popcounts(fps), [round(i * 32 / bands) * 2 for i in range(bands + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for k, chosen in enumerate(itertools.combinations(masks, bands - RADIUS)):
        part = vec & np.uint64(sum(chosen))
        part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        keys.append(part ^ (part >> np.uint64(32)))  # unlike cells that share a key only cost time
    return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or between a and b (unsigned arrays)."""
    both = a if b is None else np.concatenate([a, b])
    total = np.bitwise_count(both).astype(np.int64)
    order = np.argsort(total, kind="stable")
    v, total = both[order], total[order]
    vector = segments(v)
    last = np.searchsorted(total, total + RADIUS, side="right")
    parent = list(range(len(v)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(v)):
        seen = v[i + 1 : last[i]]
        if not len(seen):
            continue
        close = np.flatnonzero(np.abs(vector[i + 1 : last[i]] - vector[i]).sum(axis=1) <= RADIUS)
        for j in (close[np.bitwise_count(seen[close] ^ v[i]) <= RADIUS] + i + 1).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(v[i]), int(v[j])))
    return out


def _edges_of_cells(batches):
    """Rows come ordered by cell; a cell's rows: its key, chunk pair, and which of both chunks each belongs to."""
    key, rows, out = None, [], []

    def close():
        if len(rows) > 1:
            side, fps = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64).view(np.uint64)
            a, b = fps[side == 0], fps[side == 1]
            out.extend(forest(a) if not len(b) else forest(a, b))
        rows.clear()

    for batch in batches:
        for k, x, y, side, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, x, y) != key:
                close()
                key = (k, x, y)
            rows.append((side, fp))
        if len(out) > 50_000:
            yield _links(out)
            out.clear()
    close()
    yield _links(out)


def _links(out):
    ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that span every component of those at RADIUS or less."""

    n = distinct.count()
    bands = bands_for(n)
    tasks = max(1, -(-n * math.comb(bands, RADIUS) // SHARE))  # more fingerprints give more tasks, not longer ones

    def spread(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, keys = cells(fps.view(np.uint64), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(fps[at], pa.int64())], ["cell", "fp"])

    rows = distinct.select("fp").mapInArrow(spread, "cell long, fp long")
    large = rows.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(F.col("count") / CELL).cast("int").alias("chunks"))
    rows = rows.join(large, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    rows = rows.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    return rows.repartition(tasks, "cell", "x", "y").sortWithinPartitions("cell", "x", "y").mapInArrow(_edges_of_cells, "a long, b long")


def component_ids(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest first of the fingerprints with the same root; one without a root is alone.

    A component may have a third of all fingerprints: they are dealt to SALTS tasks, and its id to each of these.
    """
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    salt = F.when(F.col("root").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.lit(SALTS))).cast("int")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"), salt.alias("salt"), F.col("root").isNotNull().alias("linked"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.max("linked").alias("linked"))
    salts = F.expr(f"sequence(0, if(linked, {SALTS - 1}, 0))")
    least = least.select("root", "component_id", F.explode(salts).alias("salt"))
    return named.join(least, ["root", "salt"]).select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    fps = stored(fingerprints(docs), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    named = component_ids(distinct, components(links(distinct)))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir):
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
