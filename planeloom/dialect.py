"""One SQL text for Spark and DuckDB. `//` truncates, `>>` floors; `<upto n>` makes a row for each of 0..n-1."""

import re


def spark_sql(sql: str) -> str:
    return re.sub(r"<upto ([^>]*)>", r"explode(sequence(0, CAST(\1 AS INT) - 1))", sql.replace("//", " div "))


def duck_sql(sql: str) -> str:
    return re.sub(r"<upto ([^>]*)>", r"unnest(range(CAST(\1 AS INT)))", sql)
