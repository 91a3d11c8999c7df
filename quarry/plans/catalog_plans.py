"""Catalog plans (A07-A14) over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import keys as K
from ..sources import tables as T
from .registry import register

_ORDER = ", ".join(f"('{t}', {i})" for i, t in enumerate(T.STAR_TABLES))
_FKS = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in T.STAR_FOREIGN_KEYS)

# DuckDB side: the same profile read from information_schema over the views.
CATALOG_SQL = f"""WITH tord(table_name, table_id) AS (VALUES {_ORDER}),
ic AS (SELECT o.table_id, c.table_name, c.column_name, c.ordinal_position,
         CASE WHEN c.data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE c.data_type END AS data_type
       FROM information_schema.columns c JOIN tord o ON c.table_name = o.table_name),
cols AS (
  SELECT 'star' AS db_id, CAST(row_number() OVER (ORDER BY table_id, ordinal_position) AS BIGINT) AS column_id,
    CAST(table_id AS BIGINT) AS table_id, table_name, column_name,
    lower(replace(column_name, '_', ' ')) AS column_display, data_type AS declared_type,
    CASE WHEN lower(data_type) LIKE '%char%' OR lower(data_type) = '' OR lower(data_type) LIKE '%text%' OR lower(data_type) LIKE '%var%' THEN 'text'
         WHEN lower(data_type) LIKE '%int%' OR lower(data_type) LIKE '%numeric%' OR lower(data_type) LIKE '%decimal%'
           OR lower(data_type) LIKE '%number%' OR lower(data_type) LIKE '%id%' OR lower(data_type) LIKE '%real%'
           OR lower(data_type) LIKE '%double%' OR lower(data_type) LIKE '%float%' THEN 'number'
         WHEN lower(data_type) LIKE '%date%' OR lower(data_type) LIKE '%time%' OR lower(data_type) LIKE '%year%' THEN 'time'
         WHEN lower(data_type) LIKE '%boolean%' THEN 'boolean' ELSE 'others' END AS column_type,
    ordinal_position = 1 AS is_pk
  FROM ic
  UNION ALL SELECT 'star', 0, -1, NULL, '*', '*', NULL, 'text', false),
fkn(t, c, rt, rc) AS (VALUES {_FKS}),
fks AS (SELECT a.db_id, a.column_id, b.column_id AS other_column_id FROM fkn
        JOIN cols a ON a.table_name = fkn.t AND a.column_name = fkn.c
        JOIN cols b ON b.table_name = fkn.rt AND b.column_name = fkn.rc)"""


# non-null values of every column, read from the tables themselves
STATS_SQL = "stats AS (" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, CAST(n_values AS BIGINT) AS n_values "
    f"FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n_values)" for t in T.STAR_TABLES) + ")"


def _cols(spark, sf_dir):
    return C.profile(spark, sf_dir)


def _counted(spark, sf_dir):
    """The profile with each column's number of values."""
    return _cols(spark, sf_dir).join(C.column_stats(spark, sf_dir), ["db_id", "table_name", "column_name"], "left").na.fill(0, ["n_values"])


def _big(df, *names):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in df.columns])


@register("a07_catalog_profile", CATALOG_SQL + f""",
{STATS_SQL}
SELECT cols.*, coalesce(n_values, 0) AS n_values FROM cols LEFT JOIN stats USING (table_name, column_name)""", ops="A07 A08 A09")
def a07(spark, sf_dir):
    return _big(_counted(spark, sf_dir), "column_id", "table_id")


@register("a08_type_buckets", CATALOG_SQL + f""",
{STATS_SQL}
SELECT column_type, CAST(count(*) AS BIGINT) AS n_columns, CAST(sum(n_values) AS BIGINT) AS n_values
FROM cols JOIN stats USING (table_name, column_name) GROUP BY column_type""", ops="A08")
def a08(spark, sf_dir):
    return _counted(spark, sf_dir).filter("column_id > 0").groupBy("column_type").agg(
        F.count("*").alias("n_columns"), F.sum("n_values").alias("n_values"))


@register("a09_primary_keys", CATALOG_SQL + f""",
{STATS_SQL}
SELECT db_id, column_id, table_name, column_name, n_values FROM cols JOIN stats USING (table_name, column_name) WHERE is_pk""", ops="A09")
def a09(spark, sf_dir):
    c = _counted(spark, sf_dir)
    return _big(C.primary_keys(c).join(c, ["db_id", "column_id"]).select("db_id", "column_id", "table_name", "column_name", "n_values"), "column_id")


@register("a10_foreign_keys", CATALOG_SQL + f""",
{STATS_SQL}
SELECT f.db_id, f.column_id, f.other_column_id, n_values FROM fks f JOIN cols c ON c.column_id = f.column_id
JOIN stats USING (table_name, column_name)""", ops="A10")
def a10(spark, sf_dir):
    cols = _counted(spark, sf_dir)
    return _big(C.foreign_keys(spark, cols).join(cols.select("db_id", "column_id", "n_values"), ["db_id", "column_id"]),
                "column_id", "other_column_id")


@register("a11_enrich_examples", T.with_views(CATALOG_SQL + """,
packed AS (SELECT db_id, CAST(count(*) FILTER (WHERE column_id > 0) AS BIGINT) AS n_columns,
             CAST(count(DISTINCT table_id) FILTER (WHERE table_id >= 0) AS BIGINT) AS n_tables,
             string_agg(table_name, ',' ORDER BY column_id) FILTER (WHERE column_id > 0 AND is_pk) AS table_names,
             CAST((SELECT count(*) FROM fks) AS BIGINT) AS n_foreign_keys
           FROM cols GROUP BY db_id)
SELECT q.ex_id, q.db_id, p.n_tables, p.n_columns, p.table_names, p.n_foreign_keys
FROM questions q JOIN packed p ON q.db_id = p.db_id""", "questions"), ops="A11")
def a11(spark, sf_dir):
    cols = _cols(spark, sf_dir)
    packed = C.pack(cols, C.foreign_keys(spark, cols))
    # one packed row per database
    j = T.questions(spark, sf_dir).join(packed, "db_id")
    return j.select("ex_id", "db_id", F.size("db_table_names").cast("bigint").alias("n_tables"),
                    (F.size("db_column_names") - 1).cast("bigint").alias("n_columns"),
                    F.array_join("db_table_names", ",").alias("table_names"),
                    F.size("db_foreign_keys").cast("bigint").alias("n_foreign_keys"))


@register("a12_schema_registry", T.with_views(CATALOG_SQL + """,
reg AS (SELECT db_id, min(ex_id) AS first_ex_id, CAST(count(*) AS BIGINT) AS n_examples FROM questions GROUP BY db_id)
SELECT r.*, (SELECT string_agg(table_name || '.' || column_name, ',' ORDER BY column_id) FROM cols c WHERE c.db_id = r.db_id AND column_id > 0) AS columns,
  (SELECT string_agg(column_type, ',' ORDER BY column_id) FROM cols c WHERE c.db_id = r.db_id) AS column_types,
  (SELECT string_agg(column_id || '=' || other_column_id, ',' ORDER BY column_id, other_column_id) FROM fks f WHERE f.db_id = r.db_id) AS foreign_keys
FROM reg r""", "questions"), ops="A12")
def a12(spark, sf_dir):
    """One entry per database: the catalog that came with its first example."""
    cols = _cols(spark, sf_dir)
    seen = T.questions(spark, sf_dir).groupBy("db_id").agg(F.min("ex_id").alias("first_ex_id"), F.count("*").alias("n_examples"))
    r = seen.join(C.pack(cols, C.foreign_keys(spark, cols)), "db_id")
    own = F.filter("db_column_names", lambda c: c["table_id"] >= 0)
    return r.select(
        "db_id", "first_ex_id", "n_examples",
        F.array_join(F.transform(own, lambda c: F.concat(F.get("db_table_names", c["table_id"].cast("int")), F.lit("."), c["column_name"])), ",").alias("columns"),
        F.array_join("db_column_types", ",").alias("column_types"),
        F.array_join(F.transform("db_foreign_keys", lambda f: F.concat_ws("=", f["column_id"], f["other_column_id"])), ",").alias("foreign_keys"))


@register("a13_adjacency", CATALOG_SQL + ",\n" + STATS_SQL + """,
c AS (SELECT * FROM cols WHERE column_id > 0),
pt AS (SELECT db_id, lower(table_name) AS table_name, string_agg(lower(column_name), ',' ORDER BY lower(column_name)) AS columns,
         string_agg(lower(column_name), ',' ORDER BY lower(column_name)) FILTER (WHERE is_pk) AS primary_key
       FROM c GROUP BY db_id, table_name),
fk AS (SELECT a.db_id, lower(a.table_name) AS table_name,
         string_agg(lower(a.table_name) || '.' || lower(a.column_name) || '->' || lower(b.table_name) || '.' || lower(b.column_name), ','
                    ORDER BY lower(a.table_name) || '.' || lower(a.column_name) || '->' || lower(b.table_name) || '.' || lower(b.column_name)) AS foreign_keys
       FROM fks JOIN c a ON fks.column_id = a.column_id JOIN c b ON fks.other_column_id = b.column_id GROUP BY a.db_id, a.table_name)
SELECT pt.db_id, pt.table_name, columns, primary_key, coalesce(foreign_keys, '') AS foreign_keys, n_values
FROM pt LEFT JOIN fk ON pt.db_id = fk.db_id AND pt.table_name = fk.table_name
JOIN (SELECT table_name, CAST(sum(n_values) AS BIGINT) AS n_values FROM stats GROUP BY table_name) s ON s.table_name = pt.table_name""", ops="A13")
def a13(spark, sf_dir):
    cols = _counted(spark, sf_dir)
    held = cols.filter("column_id > 0").groupBy("db_id", F.lower("table_name").alias("table_name")).agg(F.sum("n_values").alias("n_values"))
    return C.adjacency(cols, C.foreign_keys(spark, cols)).join(held, ["db_id", "table_name"])


@register("a14_identifiers", CATALOG_SQL + ",\n" + STATS_SQL + """
SELECT db_id, '__' || lower(table_name) || '.' || lower(column_name) || '__' AS ident, 'column' AS kind, n_values
FROM cols JOIN stats USING (table_name, column_name)
UNION ALL SELECT DISTINCT db_id, '__' || lower(table_name) || '__', 'table', CAST(0 AS BIGINT) FROM cols WHERE column_id > 0
UNION ALL SELECT DISTINCT db_id, '__all__', 'star', CAST(0 AS BIGINT) FROM cols""", ops="A14")
def a14(spark, sf_dir):
    cols = _counted(spark, sf_dir)
    held = cols.filter("column_id > 0").select("db_id", "n_values", F.concat(
        F.lit("__"), F.lower("table_name"), F.lit("."), F.lower("column_name"), F.lit("__")).alias("ident"))
    return C.identifier_universe(cols).join(held, ["db_id", "ident"], "left").na.fill(0, ["n_values"])


# A09/A10 from the data; DuckDB side: the distinct values of every whole-number and text column
_KEY_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
}
KEYS_SQL = "WITH vals AS (" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, {k} AS pos, CASE WHEN typeof(any_value({c})) = 'VARCHAR' THEN 'text' ELSE 'number' END AS kind, "
    f"CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    for t, cs in _KEY_COLUMNS.items() for k, c in enumerate(cs)) + """),
sizes AS (""" + "\nUNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n_rows FROM {t}" for t in _KEY_COLUMNS) + """),
per AS (SELECT t, c, pos, kind, count(*) AS n_distinct, sum(n) AS n_values FROM vals GROUP BY t, c, pos, kind),
uniq AS (SELECT per.*, n_rows FROM per JOIN sizes USING (t) WHERE n_distinct = n_values AND n_values = n_rows)"""


def _key_tables(spark, sf_dir):
    return {t: T.table(spark, sf_dir, t) for t in T.STAR_TABLES}


@register("a09_discovered_keys", KEYS_SQL + """
SELECT t AS table_name, c AS column_name, kind, CAST(n_rows AS BIGINT) AS n_rows,
  pos = min(pos) OVER (PARTITION BY t) AS is_key FROM uniq""", ops="A09")
def a09_discovered(spark, sf_dir):
    tables = _key_tables(spark, sf_dir)
    return K.unique_columns(K.column_values(tables), tables)


@register("a10_inclusions", KEYS_SQL + """,
shared AS (SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS n
           FROM vals a JOIN vals b ON a.value = b.value AND a.kind = b.kind AND (a.t <> b.t OR a.c <> b.c)
           JOIN uniq u ON u.t = b.t AND u.c = b.c GROUP BY 1, 2, 3, 4)
SELECT s.t AS table_name, s.c AS column_name, rt AS ref_table, rc AS ref_column, CAST(n AS BIGINT) AS n_values,
  regexp_replace(s.c, '^[^_]*_', '') = regexp_replace(rc, '^[^_]*_', '') AS same_name
FROM shared s JOIN per p ON p.t = s.t AND p.c = s.c WHERE n = n_distinct""", ops="A10")
def a10_inclusions(spark, sf_dir):
    tables = _key_tables(spark, sf_dir)
    values = K.column_values(tables)
    return K.inclusions(values, K.unique_columns(values, tables))
