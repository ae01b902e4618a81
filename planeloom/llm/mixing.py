"""Mixing sources to target weights by hierarchical budgeting, in DataFrame and SQL functions only.

Leaves are the sources of a domain-language-source tree. A node's budget goes to its children by weight. A child
can take at most EPOCHS times its supply; what it cannot take goes to its siblings by weight, and only what no sibling
can take is left to the ancestors' other children, as a child's capacity is the sum of its leaves'. Then
each leaf takes whole epochs and, of the next epoch, the longest prefix in seeded order that its budget holds.

The prefix needs no leaf-wide sort: tokens are summed by (leaf, bucket of the order); buckets wholly inside are
taken as they are, only the one bucket where the budget ends is ordered row by row.

Target weights come as a table (mix_domain, mix_lang, mix_source, weight): a row with null mix_source weighs a language
among its siblings, one with null mix_lang too a domain. Where the table names a child of a node, its other children
weigh nothing and are not taken; repeated rows add up, null and negative weights count as nothing. The children of a node
that has none named weigh their parts of supply, drawn to equal shares by FLAT (tenths); so all do without a table.
The domain is an SQL expression over the columns of docs (DOMAIN by default). A token is four bytes, rounded up. Null or empty texts have no tokens and are never taken; null lang or source is a leaf named "?".
Repeated rows count and are taken each on their own, in any order among themselves. An empty table gives no rows.
"""

from pyspark.sql import DataFrame

EPOCHS, FLAT, BUCKETS, SEED = 4, 1, 1024, 17

DOMAIN = "CASE WHEN source LIKE '%0' OR source LIKE '%2' OR source LIKE '%4' OR source LIKE '%6' OR source LIKE '%8' THEN 'even' ELSE 'odd' END"
#: Texts that Spark and DuckDB both run, but for the words in braces.
BASE = """SELECT {columns}
  coalesce({domain}, '?') AS mix_domain,
  coalesce(lang, '?') AS mix_lang, coalesce(source, '?') AS mix_source,
  CAST(({bytes} + 3 - ({bytes} + 3) % 4) / 4 AS BIGINT) AS mix_tokens FROM {docs} WHERE {bytes} > 0"""


KEYS = ["mix_domain", "mix_lang", "mix_source"]


def _rated(weights: str) -> str:
    """The leaves that weigh something, with the given weights of their three nodes (null where no sibling is named)."""
    at = lambda n: " AND ".join(f"{k} IS {'NOT ' if i < n else ''}NULL" for i, k in enumerate(KEYS))
    named = [f"given_{n} AS (SELECT {', '.join(KEYS[:n])}, CAST(sum(greatest(coalesce(weight, 0), 0)) * 1000000 AS BIGINT) AS w FROM {weights} WHERE {at(n)} GROUP BY {', '.join(KEYS[:n])})" for n in (1, 2, 3)]
    parents = [f"LEFT JOIN (SELECT DISTINCT {', '.join(KEYS[: n - 1])}, 0 AS w FROM given_{n}) p{n} USING ({', '.join(KEYS[: n - 1])})" for n in (2, 3)]
    given = [f"LEFT JOIN given_{n} g{n} USING ({', '.join(KEYS[:n])})" for n in (1, 2, 3)]
    cols = "coalesce(g1.w, (SELECT min(0) FROM given_1)) AS w_1, coalesce(g2.w, p2.w) AS w_2, coalesce(g3.w, p3.w) AS w_3"
    return f"""{', '.join(named)},
rated AS (SELECT {', '.join(KEYS)}, supply, cap, {cols} FROM all_leaves {' '.join(given + parents)}),
leaves AS (SELECT * FROM rated WHERE coalesce(w_1, 1) > 0 AND coalesce(w_2, 1) > 0 AND coalesce(w_3, 1) > 0)"""


def _level(keys: list[str], parent: str, out: str, flat: int, rated: bool = False) -> str:
    """Budgets of the children keys of the rows of parent (its keys and budget), by water level."""
    up = keys[:-1]
    by = f"PARTITION BY {', '.join(up)}" if up else ""
    order = f"ORDER BY CAST(c.cap AS DOUBLE) / c.w, {', '.join('c.' + k for k in keys)}"
    inner = f"({'PARTITION BY ' + ', '.join('c.' + k for k in up) if up else ''} {order} ROWS BETWEEN "
    given, source = ("p.budget", f"JOIN {parent} p ON " + " AND ".join(f"c.{k} = p.{k}" for k in up)) if up else (f"(SELECT budget FROM {parent})", "")
    cols = ", ".join(keys)
    weight = f"CAST({10 - flat} * count(*) OVER ({by}) * supply + {flat} * sum(supply) OVER ({by}) AS BIGINT)"
    weight, also = (f"coalesce(given_w, {weight})", f", max(w_{len(keys)}) AS given_w") if rated else (weight, "")
    return f"""
{out}_c AS (SELECT {cols}, CAST(sum(supply) AS BIGINT) AS supply, CAST(sum(cap) AS BIGINT) AS cap{also} FROM leaves GROUP BY {cols}),
{out}_w AS (SELECT *, {weight} AS w FROM {out}_c),
{out}_s AS (SELECT c.*, {given} AS given,
  CAST(coalesce(sum(c.cap) OVER {inner}UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cap_before,
  CAST(sum(c.w) OVER {inner}CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_after
  FROM {out}_w c {source}),
{out}_f AS (SELECT *, CAST(given - cap_before AS DOUBLE) / w_after AS level, CAST(given - cap_before AS DOUBLE) / w_after >= CAST(cap AS DOUBLE) / w AS filled FROM {out}_s),
{out}_l AS (SELECT *, max(CASE WHEN NOT filled THEN level END) OVER ({by}) AS water FROM {out}_f),
{out} AS (SELECT {cols}, supply, cap, CASE WHEN filled OR water IS NULL THEN cap ELSE least(cap, CAST(floor(water * w) AS BIGINT)) END AS budget FROM {out}_l)"""


def plan_sql(base: str, epochs: int = EPOCHS, flat: int = FLAT, parts: tuple[int, int] = (1, 1), weights: str | None = None) -> str:
    """The common tables that end in leaf_plan: a row for each leaf with its budget, whole epochs and rest."""
    keys, every, rated = KEYS, "all_leaves" if weights else "leaves", bool(weights)
    return f"""{every} AS (SELECT {', '.join(keys)}, CAST(sum(mix_tokens) AS BIGINT) AS supply, CAST({epochs} * sum(mix_tokens) AS BIGINT) AS cap FROM {base} GROUP BY {', '.join(keys)}),
root AS (SELECT CAST(floor(sum(supply) * CAST({parts[0]} AS DOUBLE) / {parts[1]}) AS BIGINT) AS budget FROM {every}),{_rated(weights) + ',' if weights else ''}{_level(keys[:1], 'root', 'domains', flat, rated)},{_level(keys[:2], 'domains', 'langs', flat, rated)},{_level(keys, 'langs', 'sources', flat, rated)},
leaf_plan AS (SELECT {', '.join(keys)}, CAST((budget - budget % supply) / supply AS INT) AS mix_whole, CAST(budget % supply AS BIGINT) AS mix_rest FROM sources)"""


ORDER = "CAST((((doc_id % 1000003) + 1000003) % 1000003 * 7919 + (mix_whole + 1) * 104729 + {seed} * 1299709) % 1000003 AS BIGINT) * 1103515245 % 2147483648"
#: Null ids are placed by their text.
_PLACE = ORDER.replace("doc_id", "coalesce(doc_id, mix_text % 1000003)")


def mixed(docs: DataFrame, epochs: int = EPOCHS, flat: int = FLAT, parts: tuple[int, int] = (1, 1), seed: int = SEED, weights: DataFrame | None = None, domain: str = DOMAIN) -> DataFrame:
    """docs' rows as taken, with mix_domain, mix_lang, mix_source, mix_tokens and mix_epoch; a row may come once an epoch.

    parts: the budget as a fraction of all tokens. weights: the table of target weights. Columns of docs keep their names; those beginning with mix_ are taken.
    """
    spark = docs.sparkSession
    columns = ", ".join(f"`{c}`" for c in docs.columns if not c.startswith("mix_")) + f", xxhash64(text) AS mix_text, xxhash64({', '.join(f'`{c}`' for c in docs.columns)}) AS mix_row,"
    base = spark.sql(BASE.format(columns=columns, bytes="octet_length(coalesce(text, ''))", docs="{d}", domain=domain), d=docs)
    keys = KEYS
    given = {} if weights is None else {"w": weights.select(*KEYS, "weight")}
    leaves = spark.sql(f"WITH {plan_sql('{b}', epochs, flat, parts, '{w}' if given else None)} SELECT * FROM leaf_plan", b=base, **given)
    from .components import stored

    leaves = stored(leaves, "leaves")  # a row for each leaf; Spark broadcasts it if its files are small
    placed = spark.sql(f"SELECT b.*, l.mix_whole, l.mix_rest, {_PLACE.format(seed=seed)} AS mix_order FROM {{b}} b JOIN {{l}} l USING ({', '.join(keys)})", b=base, l=leaves)
    per = 2147483648 // BUCKETS
    sums = spark.sql(f"SELECT {', '.join(keys)}, mix_rest, CAST(floor(mix_order / {per}) AS INT) AS mix_bucket, sum(mix_tokens) AS n FROM {{p}} GROUP BY ALL", p=placed)
    ends = spark.sql(f"SELECT *, sum(n) OVER (PARTITION BY {', '.join(keys)} ORDER BY mix_bucket) AS mix_upto FROM {{s}}", s=sums)
    ends = stored(spark.sql(f"SELECT {', '.join(keys)}, min(CASE WHEN mix_upto > mix_rest THEN mix_bucket END) AS mix_edge, max(CASE WHEN mix_upto <= mix_rest THEN mix_upto ELSE 0 END) AS mix_before FROM {{e}} GROUP BY {', '.join(keys)}", e=ends), "edges")
    at = spark.sql(f"SELECT p.*, CAST(floor(mix_order / {per}) AS INT) AS mix_bucket, e.mix_edge, e.mix_before FROM {{p}} p JOIN {{e}} e USING ({', '.join(keys)})", p=placed, e=ends)
    inside = spark.sql("SELECT *, mix_whole + CASE WHEN mix_bucket < mix_edge THEN 1 ELSE 0 END AS mix_times FROM {a}", a=at)
    names = [c for c in base.columns if c not in ("mix_text", "mix_row")]
    out = ", ".join(f"`{c}`" for c in names)
    many = spark.sql(f"SELECT {out}, explode(sequence(0, mix_times - 1)) AS mix_epoch FROM {{i}} WHERE mix_times > 0", i=inside)
    mix_edge = spark.sql(f"SELECT *, sum(mix_tokens) OVER (PARTITION BY {', '.join(keys)} ORDER BY mix_order, doc_id, mix_text, mix_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + mix_before AS mix_upto FROM {{a}} WHERE mix_bucket = mix_edge", a=at)
    last = spark.sql(f"SELECT {out}, mix_whole AS mix_epoch FROM {{e}} WHERE mix_upto <= mix_rest", e=mix_edge)
    return many.unionAll(last)


def op3_mixing(spark, sf_dir):
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")).select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch")


QUERIES = {"op3_mixing": op3_mixing}
_KEYS = "mix_domain, mix_lang, mix_source"
SQL = {
    "op3_mixing": f"""WITH base AS ({BASE.format(columns='doc_id,', bytes="octet_length(encode(coalesce(text, '')))", docs='documents', domain=DOMAIN)}),
{plan_sql('base')},
placed AS (SELECT base.*, mix_whole, mix_rest, {ORDER.format(seed=SEED)} AS mix_order FROM base JOIN leaf_plan USING ({_KEYS})),
sums AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY {_KEYS} ORDER BY mix_order, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mix_upto FROM placed)
SELECT doc_id, {_KEYS}, mix_tokens, CAST(e AS INTEGER) AS mix_epoch FROM (
  SELECT *, unnest(range(mix_whole + CASE WHEN mix_upto <= mix_rest THEN 1 ELSE 0 END)) AS e FROM sums)"""
}
