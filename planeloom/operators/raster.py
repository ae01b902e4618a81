"""Raster operators written as SQL that Spark and DuckDB both run."""

RGB_TO_YUV = """
WITH p AS (SELECT p_partkey AS id, CAST(p_size % 256 AS BIGINT) AS r,
  CAST(p_partkey % 256 AS BIGINT) AS g, CAST((p_partkey * 7) % 256 AS BIGINT) AS b FROM part)
SELECT id,
  least(255, greatest(0, CAST(trunc_div(299000*r + 587000*g + 114000*b) AS BIGINT))) AS y,
  least(255, greatest(0, CAST(trunc_div(-168736*r - 331264*g + 500000*b) AS BIGINT) + 128)) AS u,
  least(255, greatest(0, CAST(trunc_div(500000*r - 418688*g - 81312*b) AS BIGINT) + 128)) AS v
FROM p
"""


def spark_sql(sql: str) -> str:
    return _div(sql, "({}) div 1000000")


def duck_sql(sql: str) -> str:
    return _div(sql, "({}) // 1000000")


def _div(sql: str, form: str) -> str:
    while (at := sql.find("trunc_div(")) >= 0:
        end = sql.index(")", at)
        sql = sql[:at] + form.format(sql[at + 10 : end]) + sql[end + 1 :]
    return sql
