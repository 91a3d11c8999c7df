"""Keys found in the data (A09, A10): unique columns and inclusion dependencies.

All whole-number and text columns of all tables become one table of their distinct
values with counts (partial counts first, so a hot value is one row per task). Large
tables are dealt out by their key columns before, so that no task counts more than a
bounded part of the rows, whatever the files' splits.
A column is unique if every row of its table has a value of its own. A column is
included in a unique one if all its values occur there: each value gets the set of
columns that hold it, as bits, and the few different sets say for every pair of
columns how many values they share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.plan_utils import bounded_tasks
from ..session import cut_lineage

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TASK_VALUES = 1_000_000         # values of one task, about
TASK_BYTES = 32 * 1024 * 1024   # and their bytes
WORD = 63                       # columns of one word of a column set


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, col_pos, kind, value, n): the distinct non-null
    values of every whole-number and text column, written once."""
    places, parts = [], []
    for name, df in tables.items():
        fields = [(f.name, kind, f.dataType) for kind, types in (("number", WHOLE), ("text", (T.StringType,)))
                  for f in df.schema.fields if isinstance(f.dataType, types)]
        if not fields:
            continue
        held = df.select(*[f for f, _, _ in fields])
        tasks = bounded_tasks(df.count() * len(fields) / TASK_VALUES)
        if tasks > 1:
            held = held.repartition(tasks, *held.columns)
        # numbers stay numbers until they are counted
        cells = [F.struct(F.lit(len(places) + i).alias("place"), (F.col(f) if kind == "number" else F.lit(None)).cast("bigint").alias("number"),
                          (F.col(f) if kind == "text" else F.lit(None)).cast("string").alias("text")) for i, (f, kind, _) in enumerate(fields)]
        parts.append(held.select(F.inline(F.array(*cells))).where("number IS NOT NULL OR text IS NOT NULL"))
        places += [(name, f, df.columns.index(f), kind) for f, kind, _ in fields]
    counted = cut_lineage(reduce(DataFrame.unionByName, parts).groupBy("place", "number", "text").agg(F.count("*").alias("n")))
    place = F.get(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(p).alias("col_pos"), F.lit(k).alias("kind"))
                            for t, c, p, k in places]), F.col("place"))
    return (counted.withColumn("p", place).select("p.table_name", "p.column_name", "p.col_pos", "p.kind",
                                                  F.coalesce(F.col("number").cast("string"), "text").alias("value"), "n"))


def unique_columns(values: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind, n_rows, is_key) of the columns whose
    values are all there and all different; the first one of a table is its key."""
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
                                          for name, df in tables.items()])
    per = values.groupBy("table_name", "column_name", "col_pos", "kind").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_values"))
    unique = per.join(rows, "table_name").where("n_distinct = n_values AND n_values = n_rows AND n_rows > 0")
    first = unique.groupBy("table_name").agg(F.min("col_pos").alias("first"))
    return unique.join(first, "table_name").select("table_name", "column_name", "kind", "n_rows", (F.col("col_pos") == F.col("first")).alias("is_key"))


def inclusions(values: DataFrame, unique: DataFrame) -> DataFrame:
    """A10: (table_name, column_name, ref_table, ref_column, n_values, same_name) of
    columns whose values all occur in a unique column; ``same_name``: the names agree
    after their first underscore, as a foreign key's do."""
    spark = values.sparkSession
    found = values.groupBy("table_name", "column_name").agg(F.count("*"), F.sum(F.octet_length("value"))).collect()   # one row a column
    tasks = bounded_tasks(sum(r[2] for r in found) / TASK_VALUES, sum(r[3] for r in found) / TASK_BYTES)
    places = spark.createDataFrame([(i, r[0], r[1], r[2]) for i, r in enumerate(found)],
                                   "place int, table_name string, column_name string, n_values bigint")
    words = [f"word{w}" for w in range(1 + len(found) // WORD)]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") % WORD)
    sets = (values.join(F.broadcast(places), ["table_name", "column_name"]).select("kind", "value", "place").repartition(tasks, "kind", "value")
            .groupBy("kind", "value").agg(*[F.bit_or(F.when(F.floor(F.col("place") / WORD) == w, bit).otherwise(0)).alias(c)
                                            for w, c in enumerate(words)]).groupBy(*words).agg(F.count("*").alias("n")))
    columns = F.filter(F.sequence(F.lit(0), F.lit(len(found))), lambda p: F.getbit(F.get(F.array(*words), F.floor(p / WORD).cast("int")), p % WORD) == 1)
    held = sets.select(columns.alias("columns"), "n").select(F.explode("columns").alias("child"), "columns", "n")
    shared = (held.select("child", F.explode("columns").alias("parent"), "n").where("child <> parent")
              .groupBy("child", "parent").agg(F.sum("n").alias("shared")))
    child = places.withColumnRenamed("place", "child")
    parent = (places.join(unique, ["table_name", "column_name"], "left_semi")
              .select(F.col("place").alias("parent"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column")))
    stem = lambda c: F.regexp_replace(c, "^[^_]*_", "")
    return (shared.join(child, "child").where("shared = n_values").join(parent, "parent")
            .select("table_name", "column_name", "ref_table", "ref_column", "n_values")
            .withColumn("same_name", stem(F.col("column_name")) == stem(F.col("ref_column"))))
