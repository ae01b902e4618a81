"""Integer wavelet lifting of lines and rasters.

A line of N samples (N of 3 or more) has a low value for each pair, the last one alone if N is odd, and a high value
for each whole pair. The forward rule needs neighbours only, so it is windows over the line; pair sums and windows share
one shuffle. The inverse rule of filter A is windows as well; the others depend on the next restored value, so a
line is walked from its end. Filter C takes the next pair's difference at the second pair, so that it can be undone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: The filters' weights in sixteenths, of r[n-1], r[n], r[n+1] and d[n+1].
FILTERS = {"a": (0, 4, 4, 0), "b": (0, 4, 6, 4), "c": (-1, 4, 8, 6), "d": (0, 4, 5, 2), "e": (0, 3, 8, 6), "f": (0, 3, 9, 8), "q": (0, 4, 4, 4)}


def _guess(weights: tuple[int, int, int, int], d_next: str) -> str:
    """What is taken from the difference of pair n, in SQL over rp, r0, r1 (r[n-1] to r[n+1])."""
    p, a, b, c = weights
    second = f"WHEN n = 1 AND r1 IS NOT NULL THEN (2 * r0 + 3 * r1 - 2 * {d_next} + 4) >> 3" if p else ""
    return f"""CASE WHEN n = 0 THEN coalesce(r1, 0) >> 2 {second}
    WHEN cnt % 2 = 0 AND n = cnt // 2 - 1 THEN r0 >> 2
    ELSE ({p} * coalesce(rp, 1) + {a} * r0 + {b} * r1 - {c} * {d_next} + 8) >> 4 END"""


def _slopes(line: str) -> str:
    w = f"OVER (PARTITION BY {line} ORDER BY n)"
    return f"lag(l, 2) {w} - lag(l) {w} AS rp, lag(l) {w} - l AS r0, l - lead(l) {w} AS r1"


def forward_sql(src: str, out: str, line: str, pos: str, filt: str) -> str:
    """Common tables ending in out (line, cnt, n, l, h) from src (line, pos, v); h is null at the odd end."""
    return f"""
{out}_n AS (SELECT {line}, {pos} AS i, v, count(*) OVER (PARTITION BY {line}) AS cnt FROM {src}),
{out}_q AS (SELECT {line}, cnt, i // 2 AS n, min(CASE WHEN i % 2 = 0 THEN v END) AS a, min(CASE WHEN i % 2 = 1 THEN v END) AS b FROM {out}_n GROUP BY {line}, cnt, i // 2),
{out}_p AS (SELECT {line}, cnt, n, CASE WHEN b IS NULL THEN a ELSE (a + b) >> 1 END AS l, CASE WHEN b IS NULL THEN 0 ELSE a - b END AS d FROM {out}_q),
{out}_r AS (SELECT {line}, cnt, n, l, d, lead(d) OVER (PARTITION BY {line} ORDER BY n) AS d1, {_slopes(line)} FROM {out}_p),
{out} AS (SELECT {line}, cnt, n, l, CASE WHEN n < cnt // 2 THEN d - ({_guess(FILTERS[filt], 'd1')}) END AS h FROM {out}_r)"""


def inverse_a_sql(src: str, out: str, line: str) -> str:
    """Common tables ending in out (line, i, v) from src (line, cnt, n, l, h), for filter A."""
    return f"""
{out}_r AS (SELECT {line}, cnt, n, l, h, {_slopes(line)} FROM {src}),
{out}_d AS (SELECT {line}, cnt, n, l, h + ({_guess(FILTERS['a'], '0')}) AS d FROM {out}_r),
{out}_e AS (SELECT {line}, cnt, n, l, d, <upto CASE WHEN d IS NULL THEN 1 ELSE 2 END> AS side FROM {out}_d),
{out} AS (SELECT {line}, 2 * n + side AS i, CASE WHEN d IS NULL THEN l ELSE l + ((d + 1) >> 1) - side * d END AS v FROM {out}_e)"""


def inverse(halves: DataFrame, line: list[str], filt: str) -> DataFrame:
    """(line, i, v) from (line, n, l, h), any filter.

    A pair's difference needs the next pair's, so a line is walked from its end in one task, sorted by Spark and read
    batch by batch with one number kept: memory does not grow with the line. Windows and walk share one shuffle.
    """
    p, a, b, c = FILTERS[filt]
    down, all_ = Window.partitionBy(*line).orderBy(F.desc("n")), Window.partitionBy(*line)
    low = F.col("l")
    rows = halves.select(*line, "n", "l", "h", F.count("h").over(all_).alias("pairs"), F.count("l").over(all_).alias("lows"), F.lead("l").over(down).alias("l1"), F.lead("l", 2).over(down).alias("l2"), F.lag("l").over(down).alias("next"))
    rp, r0, r1 = F.coalesce(F.col("l2") - F.col("l1"), F.lit(1)), F.col("l1") - low, low - F.col("next")
    after = F.coalesce(r1, F.lit(0))

    def case(first, second, last, other):
        out = F.when(F.col("n") == 0, first)
        out = out.when((F.col("n") == 1) & r1.isNotNull(), second) if p else out
        return out.when((F.col("pairs") == F.col("lows")) & (F.col("n") == F.col("pairs") - 1), last).otherwise(other)

    base = case(after, 2 * r0 + 3 * r1 + 4, r0, p * rp + a * r0 + b * after + 8)
    rule = [base.cast("long").alias("base"), case(*map(F.lit, (0, 2, 0, c))).cast("long").alias("weight"), case(*map(F.lit, (2, 3, 2, 4))).cast("long").alias("shift")]
    rows = rows.select(*line, F.col("n").cast("long").alias("n"), low.cast("long").alias("l"), F.col("h").cast("long").alias("h"), *rule).sortWithinPartitions(*line, F.desc("n"))

    def walk(batches):
        at, d = None, 0
        for batch in batches:
            n, low, high, base, weight, shift = (batch.column(c).to_pylist() for c in ("n", "l", "h", "base", "weight", "shift"))
            out = []
            for key, h, x, w, s in zip(zip(*(batch.column(c).to_pylist() for c in line)), high, base, weight, shift):
                if key != at:
                    at, d = key, 0
                if h is not None:
                    d = h + ((x - w * d) >> s)
                out.append(d)
            whole = np.array([h is not None for h in high], bool)
            take = np.repeat(np.arange(len(n)), 1 + whole)
            side = np.concatenate([[0], take[1:] == take[:-1]]).astype(np.int64)[: len(take)]
            low, d_all, whole = np.array(low, np.int64)[take], np.array(out, np.int64)[take], whole[take]
            v = np.where(whole, low + ((d_all + 1) >> 1) - side * d_all, low)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(take)) for c in line), pa.array(2 * np.array(n, np.int64)[take] + side), pa.array(v)], [*line, "i", "v"])

    types = ", ".join(f"`{c}` {halves.schema[c].dataType.simpleString()}" for c in line)
    return rows.mapInArrow(walk, f"{types}, i long, v long")


def stage_sql(src: str, out: str, filt: str) -> str:
    """Rows, then columns: out (img, subband, y, x, v) from src (img, y, x, v). subband: 0 LL, 1 HL, 2 LH, 3 HH."""
    return f"""{forward_sql(src, out + '_x', 'img, y', 'x', filt)},
{out}_xs AS (SELECT img, y, n AS x, side AS hx, CASE WHEN side = 0 THEN l ELSE h END AS v FROM (SELECT *, <upto CASE WHEN h IS NULL THEN 1 ELSE 2 END> AS side FROM {out}_x) t),{forward_sql(out + '_xs', out + '_y', 'img, x, hx', 'y', filt)},
{out} AS (SELECT img, hx + 2 * side AS subband, n AS y, x, CASE WHEN side = 0 THEN l ELSE h END AS v FROM (SELECT *, <upto CASE WHEN h IS NULL THEN 1 ELSE 2 END> AS side FROM {out}_y) t)"""


def inverse_2d(bands: DataFrame, filt: str) -> DataFrame:
    """(img, y, x, v) from (img, subband, y, x, v): columns, then rows."""
    half = lambda at, key: [F.max(F.when(F.col(key) == 0, F.col(at))).alias("l"), F.max(F.when(F.col(key) == 1, F.col(at))).alias("h")]
    cols = bands.withColumns({"hx": F.col("subband") % 2, "hy": F.floor(F.col("subband") / 2)})
    cols = cols.groupBy("img", "x", "hx", F.col("y").alias("n")).agg(*half("v", "hy"))
    rows = inverse(cols, ["img", "x", "hx"], filt).withColumnRenamed("i", "y")
    rows = rows.groupBy("img", "y", F.col("x").alias("n")).agg(*half("v", "hx"))
    return inverse(rows, ["img", "y"], filt).withColumnRenamed("i", "x").select("img", "y", "x", "v")
