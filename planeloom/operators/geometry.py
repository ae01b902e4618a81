"""Sub-band rectangles and the partition of a rectangle into segments, as scalar expressions."""

#: At most so many segments; the choice of the number of rows is one CASE over them.
MAX_SEGMENTS = 32

#: From dims (img, w, h, stages): a rectangle for each level and sub-band.
SUBBANDS = """
lv0 AS (SELECT img, w, h, stages, <upto stages> AS above FROM dims),
lv AS (SELECT img, w, h, stages, above + 1 AS level FROM lv0),
sz AS (SELECT img, stages, level, (w + (1 << level) - 1) >> level AS lw, (h + (1 << level) - 1) >> level AS lh,
  ((w + (1 << (level - 1)) - 1) >> (level - 1)) >> 1 AS hw, ((h + (1 << (level - 1)) - 1) >> (level - 1)) >> 1 AS hh FROM lv),
bands AS (SELECT *, <upto 4> AS subband FROM sz),
subbands AS (SELECT img, level, subband, CASE WHEN subband % 2 = 1 THEN lw ELSE 0 END AS x0, CASE WHEN subband >= 2 THEN lh ELSE 0 END AS y0,
  CASE WHEN subband % 2 = 1 THEN hw ELSE lw END AS bw, CASE WHEN subband >= 2 THEN hh ELSE lh END AS bh FROM bands WHERE subband > 0 OR level = stages)"""

_ROWS = "CASE " + " ".join(f"WHEN {r} >= s OR {r * (r + 1)} * w >= h * s THEN {r}" for r in range(1, MAX_SEGMENTS + 1)) + " END"

#: From rects (img, w, h, s): s near-square cells that tile w by h. Upper rows have c cells, lower ones c + 1.
SEGMENTS = f"""
p1 AS (SELECT *, CASE WHEN h > (s - 1) * w THEN s ELSE {_ROWS} END AS r FROM rects WHERE s <= w * h AND s <= {MAX_SEGMENTS}),
p2 AS (SELECT *, s // r AS c, (s // r + 1) * r - s AS rt FROM p1),
p3 AS (SELECT *, greatest(rt, ((2 * h * c * rt + s) // 2) // s) AS ht FROM p2),
p4 AS (SELECT *, <upto s> AS seg FROM p3),
p5 AS (SELECT *, seg >= rt * c AS low FROM p4),
p6 AS (SELECT *, CASE WHEN low THEN c + 1 ELSE c END AS nc, CASE WHEN low THEN r - rt ELSE rt END AS nr,
  CASE WHEN low THEN h - ht ELSE ht END AS hr, CASE WHEN low THEN ht ELSE 0 END AS top, CASE WHEN low THEN seg - rt * c ELSE seg END AS k FROM p5),
p7 AS (SELECT *, w // nc AS cw, hr // nr AS ch, (w // nc + 1) * nc - w AS c0, (hr // nr + 1) * nr - hr AS r0, k % nc AS col, k // nc AS line FROM p6),
segments AS (SELECT img, seg, col * cw + greatest(0, col - c0) AS x0, top + line * ch + greatest(0, line - r0) AS y0,
  cw + CASE WHEN col >= c0 THEN 1 ELSE 0 END AS sw, ch + CASE WHEN line >= r0 THEN 1 ELSE 0 END AS sh FROM p7)"""
