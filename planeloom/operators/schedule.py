"""Packets in the order of their priority, cut at a quota, put in stream order; and what a reader keeps of them."""

PLANES = 9


def packets_sql(channels: int) -> str:
    """From dims (img, stages): packets with priority and place. The order is total: ties go by sub-band, level, plane, channel."""
    base = "1 << (level + 2 * lsb + 1)" if channels > 1 else "1 << (level + lsb)"  # colour doubles a level's unit at each plane
    return f"""
k0 AS (SELECT img, stages, <upto stages> AS above FROM dims),
k1 AS (SELECT img, stages, above + 1 AS level FROM k0),
k2 AS (SELECT *, <upto 4> AS subband FROM k1),
k3 AS (SELECT *, <upto {PLANES}> AS lsb FROM k2 WHERE subband > 0 OR level = stages),
k4 AS (SELECT *, <upto {channels}> AS channel, CAST({base} AS BIGINT) AS unit FROM k3),
k5 AS (SELECT img, level, subband, lsb, channel, CASE subband WHEN 0 THEN (unit << 1) WHEN 3 THEN (unit >> 1) + 1 ELSE unit END AS priority FROM k4),
packets AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY priority DESC, subband, level, lsb DESC, channel) - 1 AS place FROM k5)"""


#: From sized (img, place, n_bytes, quota): the longest prefix that the quota holds.
QUOTA = """
run AS (SELECT *, sum(n_bytes) OVER (PARTITION BY img ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized),
prefix AS (SELECT img, place, n_bytes, CAST(upto AS BIGINT) AS upto FROM run WHERE upto <= quota)"""

STREAM_ORDER = "seg, subband DESC, level DESC, lsb DESC, channel"

#: From found (img, band, plane, seen, payload): of a repeated key the last one counts.
LAST = "kept AS (SELECT img, band, plane, max(seen) AS seen, max_by(payload, seen) AS payload FROM found GROUP BY img, band, plane)"

#: From kept: planes from the top down to the first that is missing.
CONTIGUOUS = f"""
down AS (SELECT *, row_number() OVER (PARTITION BY img, band ORDER BY plane DESC) AS k FROM kept),
usable AS (SELECT img, band, plane, seen, payload FROM down WHERE plane = {PLANES} - k)"""
