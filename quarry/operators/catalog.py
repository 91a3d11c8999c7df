"""Catalog profile of a database.

Flat, joinable tables keyed by ``db_id`` instead of parallel lists:
``db_tables``, ``db_columns`` (column 0 is ``*``), primary and foreign keys.
The profile reads table *schemas* only (no data), so building it is a
driver-side loop over table metadata (kind D); everything after is joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import STAR_DB, STAR_FOREIGN_KEYS, STAR_TABLES, table

# Declared SQL type of each Spark type (what a SQL catalog would report).
SQL_TYPE = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
    T.StringType: "VARCHAR", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN",
    T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
    T.DecimalType: "DECIMAL", T.BinaryType: "BLOB",
}


def declared_type(dt: T.DataType) -> str:
    return SQL_TYPE.get(type(dt), dt.simpleString().upper())


def type_bucket(declared):
    """Ordered substring rules on the lower-cased declared type."""
    t = F.lower(declared)
    has = lambda *s: F.lit(False) if not s else (t.contains(s[0]) | has(*s[1:]))
    return (F.when(has("char") | (t == "") | has("text", "var"), "text")
            .when(has("int", "numeric", "decimal", "number", "id", "real", "double", "float"), "number")
            .when(has("date", "time", "year"), "time")
            .when(has("boolean"), "boolean")
            .otherwise("others"))


def profile(spark: SparkSession, sf_dir: str, db_id: str = STAR_DB, tables=STAR_TABLES) -> DataFrame:
    """One row per column (column_id 0 = ``*``)."""
    rows = [(db_id, 0, -1, None, "*", None, None)]
    cid = 0
    for tid, name in enumerate(tables):
        for pos, f in enumerate(table(spark, sf_dir, name).schema.fields):  # schema only
            cid += 1
            rows.append((db_id, cid, tid, name, f.name, declared_type(f.dataType), pos))
    df = spark.createDataFrame(rows, "db_id string, column_id int, table_id int, table_name string, "
                                     "column_name string, declared_type string, col_pos int")
    return df.select(
        "db_id", "column_id", "table_id", F.when(F.col("table_id") >= 0, F.col("table_name")).alias("table_name"),
        "column_name",
        F.lower(F.replace(F.col("column_name"), F.lit("_"), F.lit(" "))).alias("column_display"),
        F.when(F.col("column_id") == 0, F.lit(None).cast("string")).otherwise(F.col("declared_type")).alias("declared_type"),
        F.when(F.col("column_id") == 0, F.lit("text")).otherwise(type_bucket(F.col("declared_type"))).alias("column_type"),
        # Only the first key column is kept (here: each table's first column)
        F.coalesce(F.col("col_pos") == 0, F.lit(False)).alias("is_pk"))


def column_stats(spark: SparkSession, sf_dir: str, db_id: str = STAR_DB, tables=STAR_TABLES) -> DataFrame:
    """(db_id, table_name, column_name, n_values): non-null values of every column, one scan per table."""
    parts = []
    for name in tables:
        df = table(spark, sf_dir, name)
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        parts.append(counts.unpivot([], df.columns, "column_name", "n_values")
                     .select(F.lit(db_id).alias("db_id"), F.lit(name).alias("table_name"), "column_name", "n_values"))
    return reduce(DataFrame.unionByName, parts)


def primary_keys(cols: DataFrame) -> DataFrame:
    return cols.filter("is_pk").select("db_id", "column_id")


def foreign_keys(spark: SparkSession, cols: DataFrame, db_id: str = STAR_DB, edges=STAR_FOREIGN_KEYS) -> DataFrame:
    """A10: (table, column) → (ref table, ref column) names resolved to ordinals; unresolved dropped."""
    e = spark.createDataFrame([(db_id,) + tuple(x) for x in edges], "db_id string, t string, c string, rt string, rc string")
    a = cols.select("db_id", F.col("table_name").alias("t"), F.col("column_name").alias("c"), F.col("column_id"))
    b = cols.select("db_id", F.col("table_name").alias("rt"), F.col("column_name").alias("rc"),
                    F.col("column_id").alias("other_column_id"))
    return e.join(a, ["db_id", "t", "c"]).join(b, ["db_id", "rt", "rc"]).select("db_id", "column_id", "other_column_id")


def identifier_universe(cols: DataFrame) -> DataFrame:
    """Ids ``__t.c__``, ``__t__`` and ``__all__`` (lower-cased)."""
    c = cols.filter(F.col("column_id") > 0)
    col_ids = c.select("db_id", F.concat(F.lit("__"), F.lower("table_name"), F.lit("."), F.lower("column_name"), F.lit("__")).alias("ident"),
                       F.lit("column").alias("kind"))
    tab_ids = c.select("db_id", F.concat(F.lit("__"), F.lower("table_name"), F.lit("__")).alias("ident"), F.lit("table").alias("kind")).distinct()
    star = c.select("db_id").distinct().select("db_id", F.lit("__all__").alias("ident"), F.lit("star").alias("kind"))
    return col_ids.unionByName(tab_ids).unionByName(star)


def adjacency(cols: DataFrame, fks: DataFrame) -> DataFrame:
    """Per table its sorted column list and FK targets (``*`` excluded), as rows."""
    c = cols.filter(F.col("column_id") > 0)
    per_table = c.groupBy("db_id", "table_name").agg(
        F.array_join(F.sort_array(F.collect_list(F.lower("column_name"))), ",").alias("columns"))
    fk = (fks.join(c.select("db_id", "column_id", F.lower("table_name").alias("table_name"),
                            F.concat_ws(".", F.lower("table_name"), F.lower("column_name")).alias("src")), ["db_id", "column_id"])
             .join(c.select("db_id", F.col("column_id").alias("other_column_id"),
                            F.concat_ws(".", F.lower("table_name"), F.lower("column_name")).alias("dst")), ["db_id", "other_column_id"])
             .groupBy("db_id", "table_name").agg(
                 F.array_join(F.sort_array(F.collect_list(F.concat_ws("->", "src", "dst"))), ",").alias("foreign_keys")))
    pk = (c.filter("is_pk").groupBy("db_id", "table_name")
           .agg(F.array_join(F.sort_array(F.collect_list(F.lower("column_name"))), ",").alias("primary_key")))
    return (per_table.join(pk, ["db_id", "table_name"], "left").join(fk, ["db_id", "table_name"], "left")
                     .select("db_id", F.lower("table_name").alias("table_name"), "columns", "primary_key",
                             F.coalesce("foreign_keys", F.lit("")).alias("foreign_keys")))


def pack(cols: DataFrame, fks: DataFrame) -> DataFrame:
    """The catalog of each db packed into arrays, for A11 enrichment (edge only)."""
    per_db = cols.groupBy("db_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column_id", "table_id", "column_name"))),
                    lambda x: F.struct(x["table_id"].alias("table_id"), x["column_name"].alias("column_name"))).alias("db_column_names"),
        F.transform(F.array_sort(F.collect_list(F.struct("column_id", "column_type"))), lambda x: x["column_type"]).alias("db_column_types"),
        F.transform(F.array_sort(F.collect_set(F.when(F.col("table_id") >= 0, F.struct("table_id", "table_name")))),
                    lambda x: x["table_name"]).alias("db_table_names"),
        F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct(F.col("column_id"))))).alias("db_primary_keys"))
    fk = fks.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("column_id", "other_column_id"))).alias("db_foreign_keys"))
    return per_db.join(fk, "db_id", "left")
