"""Exact top-k by inner product, pruned by segment statistics from coarse to fine.

A vector is cut into 1, 4, then 16 segments. With means m and deviations s of two vectors' segments of n components,
their inner product is at most the sum of n * (m1 * m2 + s1 * s2): equally, their distance is at least what the
segments' means and deviations give. Each level drops the candidates whose bound is under the k-th best exact score
that is known; survivors of the last level get exact integer scores.

Candidates are dealt to groups of about GROUP rows, queries go to every group in blocks: each row moves SPLIT times as a
candidate and once a group as a query. A query comes with a seed, its k-th best score among the first SEED rows, so
that a group drops what can't be among the best of all. Scores that may not fit 63 bits are summed in Python integers.

Null vectors and vectors with null or non-finite components take no part; shorter vectors count as padded with
zeros. Ties go to the smaller id. Rows that repeat an id are rows of their own: each is a query or a candidate, and only
a query's own row is no candidate of it. Components whose 256-fold is no long, and scores that are none, are errors.
An empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import stored

LEVELS, GROUP, SPLIT, SEED, BLOCK = (1, 4, 16), 1 << 15, 8, 1024, 64


def stats(v: np.ndarray, segments: int) -> np.ndarray:
    """Rows' segment means and deviations, scaled so that a product of two rows bounds their inner product."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges, edges[1:]):
        part = v[:, a:b].astype(np.float64)
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(out, 1)


def scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of c with q, exact: as floats, longs or Python integers, whichever hold them."""
    most = float(np.abs(c.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).sum())
    if most < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return c @ q if most < 2**62 else np.array([sum(int(x) * int(y) for x, y in zip(r, q)) for r in c] + [None], object)[:-1]


class Candidates:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray):
        self.rows, self.ids, self.vecs = rows, ids, vecs
        self.norm = np.linalg.norm(vecs.astype(np.float64), axis=1).max(initial=0)
        self.stats = [stats(self.vecs, s) for s in LEVELS] if vecs.size else []

    def best(self, asking: list[tuple[int, np.ndarray, int | None]], k: int) -> list[list[tuple[int, int]]]:
        """Of each query (row, vector, seed) the k best (id, score) of these candidates, or those of them not under its seed."""
        if not len(self.rows):
            return [[] for _ in asking]
        dim = max(self.vecs.shape[1], *(len(v) for _, v, _ in asking))
        if dim > self.vecs.shape[1]:
            self.__init__(self.rows, self.ids, np.pad(self.vecs, ((0, 0), (0, dim - self.vecs.shape[1]))))
        q = np.array([np.pad(v, (0, dim - len(v))) for _, v, _ in asking])
        # bounds are sums of float products: what rounding may have taken off is added
        slack = 1e-9 * (self.norm * np.linalg.norm(q.astype(np.float64), axis=1) + 1)
        least = np.array([-np.inf if seed is None else float(seed) for *_, seed in asking])
        floor = least - slack - 1e-12 * np.abs(np.where(np.isfinite(least), least, 0))
        alive, ok = np.arange(len(self.rows)), None
        for level, other in zip(LEVELS, self.stats):  # coarse to fine, all queries of the block at once
            bound = other[alive] @ stats(q, level).T
            ok = bound >= floor
            some = ok.any(axis=1)
            alive, ok, bound = alive[some], ok[some], bound[some]
        out = []
        for j, (row, _, seed) in enumerate(asking):
            good = np.flatnonzero(ok[:, j] & (self.rows[alive] != row))
            at = alive[good]
            if len(at) > k:
                tried = at[np.argpartition(-bound[good, j], k - 1)[:k]]
                own = float(min(scores(self.vecs[tried], q[j])))
                at = at[bound[good, j] >= own - slack[j] - 1e-12 * abs(own)]
            score = scores(self.vecs[at], q[j])
            order = np.lexsort((self.ids[at], -score)) if score.dtype != object else sorted(range(len(at)), key=lambda i: (-score[i], self.ids[at[i]]))
            out.append([(int(self.ids[at[i]]), int(score[i])) for i in list(order)[:k]])
        return out


def vectors(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, as slices of one array."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for r, v in zip(out, rows):
        r[: len(v)] = v
    return out


def top_k(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row of (vec_id, embedding) whose id is divisible by every."""
    good = "size(embedding) > 0 and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    ints = rows.select("vec_id", "embedding").where(good).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as long))").alias("v"))
    ints = stored(ints.withColumn("row", F.monotonically_increasing_id()), "vectors")  # fixes the row's number
    first = ints.orderBy("row").limit(SEED).collect()  # SEED rows at most
    seeds = Candidates(np.array([r.row for r in first], np.int64), np.array([r.vec_id for r in first], np.int64), matrix([r.v for r in first]))
    groups = max(1, -(-ints.count() // GROUP))

    def ask(batches):
        for b in batches:
            out = []
            for id, v, row in zip(b.column(0).to_pylist(), vectors(b.column(1)), b.column(2).to_pylist()):
                got = seeds.best([(row, v, None)], k)[0]
                out.append((id, v, row, got[-1][1] if len(got) == k else None))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()))], ["vec_id", "v", "row", "seed"])

    asked = stored(ints.where(F.col("vec_id") % every == 0).mapInArrow(ask, "vec_id long, v array<long>, row long, seed long"), "asked")
    asked = asked.select("*", F.explode(F.expr(f"sequence(0, {groups - 1})")).alias("group"), F.pmod(F.xxhash64("row"), F.lit(SPLIT)).cast("int").alias("split"), F.lit(True).alias("asks"))
    given = ints.select("vec_id", "v", "row", F.lit(None).cast("long").alias("seed"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("group"), F.explode(F.expr(f"sequence(0, {SPLIT - 1})")).alias("split"), F.lit(False).alias("asks"))

    def run(batches):
        place, rows, own = None, [], None

        def answer(asking):
            nonlocal own
            if own is None:  # all of the group's candidates have come
                own = Candidates(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), matrix([r[2] for r in rows]))
                rows.clear()
            best = own.best([(row, v, seed) for _, v, row, seed in asking], k)
            got = [(id, row, *x) for (id, _, row, _), found in zip(asking, best) for x in found]
            cols = list(zip(*got)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "row", "vec_id", "score"])

        for b in batches:
            asking = []
            for id, v, *at in zip(b.column(0).to_pylist(), vectors(b.column(1)), *(c.to_pylist() for c in b.columns[2:])):
                row, seed, group, split, asks = at
                if (group, split) != place:
                    if asking:
                        yield answer(asking)
                    place, own, asking = (group, split), None, []
                    rows.clear()
                if asks:
                    asking.append((id, v, row, seed))
                else:
                    rows.append((row, id, v.copy()))  # a copy, so that the batch can go
                if len(asking) >= BLOCK:
                    yield answer(asking)
                    asking = []
            if asking:
                yield answer(asking)

    dealt = given.unionByName(asked.select(given.columns)).repartition("group", "split").sortWithinPartitions("group", "split", "asks")
    found = dealt.mapInArrow(run, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_exact_topk": op6_exact_topk}
SQL = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
