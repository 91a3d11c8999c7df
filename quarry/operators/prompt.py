"""Prompt assembly: schema serialization and model input/target texts.

Per example, the schema text is built by two ordered ``collect_list``
aggregations (columns within a table, tables within an example); the
catalog side is per database and joined by ``db_id`` after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The instruction prefix and the default source prefix.
PROMPT = "Translate the question into sql according to the database:"
SOURCE_PREFIX = "question: "

STYLES = {
    # db_id text, table separator, table text, column separator, column-with-values, value separator
    "verbose": ("database: {db}. ", ". ", "table: {table}. columns: {columns}", ", ", "{column} ({values})", ", "),
    "piped": (" | {db}", "", " | {table} : {columns}", " , ", "{column} ( {values} )", " , "),
}


def _fmt(template: str, **cols: Column) -> Column:
    """concat() of a template whose {name} fields are columns."""
    parts, rest = [], template
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def serialize_schema(examples: DataFrame, columns: DataFrame, matches: DataFrame | None, style: str = "piped",
                     with_db_id: bool = True) -> DataFrame:
    """(ex_id, serialized_schema).

    ``columns``: (db_id, table_id, table_name, column_id, column_name), ``*`` excluded;
    ``matches``: (ex_id, table_name, column_name, values array) from value linking.
    Tables with linked values move to the front, reversed among themselves.
    """
    db_t, tsep, ttab, csep, cval, vsep = STYLES[style]
    # the catalog is packed once per database; examples bring their matches as a map
    per_table = columns.groupBy("db_id", "table_id", "table_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("column_id", "column_name"))), lambda c: c["column_name"]).alias("cols"))
    packed = per_table.groupBy("db_id").agg(F.sort_array(F.collect_list(F.struct("table_id", "table_name", "cols"))).alias("tabs"))
    x = examples.select("ex_id", "db_id").join(packed, "db_id")
    name = lambda t, c: F.concat(t, F.lit("\u0001"), c)
    if matches is not None:
        linked = matches.groupBy("ex_id").agg(F.map_from_entries(F.collect_list(
            F.struct(name(F.col("table_name"), F.col("column_name")).alias("k"), F.col("values").alias("v")))).alias("linked"))
        x = x.join(linked, "ex_id", "left")
    else:
        x = x.withColumn("linked", F.lit(None).cast("map<string,array<string>>"))

    def column_text(table: Column, column: Column) -> Column:
        values = F.col("linked")[name(table, column)]
        cname = F.lower(column)
        return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, _fmt(cval, column=cname, values=F.array_join(values, vsep))).otherwise(cname)

    texts = F.transform("tabs", lambda t: F.struct(t["table_id"].alias("id"), _fmt(
        ttab, table=F.lower(t["table_name"]),
        columns=F.array_join(F.transform(t["cols"], lambda c: column_text(t["table_name"], c)), csep)).alias("t")))
    # tables with values first, in descending order, then the others
    order = lambda s: F.struct(F.when(F.contains(s["t"], F.lit("(")), 0).otherwise(1).alias("k1"),
                               F.when(F.contains(s["t"], F.lit("(")), -s["id"]).otherwise(s["id"]).alias("k2"), s["t"].alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.transform(texts, order)), lambda s: s["t"]), tsep)
    head = _fmt(db_t, db=F.col("db_id")) if with_db_id else F.lit("database: ")
    return x.select("ex_id", F.concat(head, joined).alias("serialized_schema"))


def example_values(examples: DataFrame, columns: DataFrame, contained: DataFrame, picks: DataFrame, seed: str = "42") -> DataFrame:
    """One value per column — the smallest value contained in the question
    (lower-cased), else a fixed per-column pick (md5 order, replaces a random choice)."""
    fallback = picks.groupBy("table_name", "column_name").agg(
        F.min_by("value", F.md5(F.concat_ws("|", F.lit(seed), "table_name", "column_name", "value"))).alias("fallback"))
    inq = contained.groupBy("ex_id", "table_name", "column_name").agg(F.min(F.lower("value")).alias("hit"))
    x = examples.select("ex_id", "db_id").join(columns, "db_id")
    x = x.join(inq, ["ex_id", "table_name", "column_name"], "left").join(fallback, ["table_name", "column_name"], "left")
    return x.withColumn("pick_value", F.coalesce("hit", F.col("fallback").cast("string")))


def one_db_schema(ev: DataFrame, db_id: str) -> DataFrame:
    """C06 text: ``table: t. columns: c (v),c (v)`` joined by '. ' after ``database: db. ``."""
    col_str = F.concat(F.col("column_name"), F.lit(" ("), F.coalesce("pick_value", F.lit("None")), F.lit(")"))
    t = ev.groupBy("ex_id", "table_id", "table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_id", col_str.alias("c")))), lambda s: s["c"]), ",").alias("cols"))
    t = t.withColumn("ttext", F.concat(F.lit("table: "), F.col("table_name"), F.lit(". columns: "), F.col("cols")))
    e = t.groupBy("ex_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_id", "ttext"))), lambda s: s["ttext"]), ". ").alias("tables"))
    return e.select("ex_id", F.concat(F.lit(f"database: {db_id}. "), F.col("tables")).alias("serialized_schema"))


def model_input(question: Column, schema: Column, prefix: str = SOURCE_PREFIX, append_qmark: bool = False) -> Column:
    """Prefix + question + ' | ' + schema; the one-database corpus appends '?' to the question."""
    q = F.concat(question, F.lit("?")) if append_qmark else question
    return F.concat(F.lit(prefix), F.trim(q), F.lit(" | "), F.trim(schema))


def dialogue_input(utterances: Column, schema: Column, prefix: str = SOURCE_PREFIX) -> Column:
    """C07 (dialogue): utterances joined by ' | '."""
    return F.concat(F.lit(prefix), F.array_join(F.transform(utterances, lambda u: F.trim(u)), " | "), F.lit(" | "),
                    F.trim(schema))


def target(query_norm: Column, db_id: Column, with_db_id: bool) -> Column:
    """Optional 'db_id | ' + normalized query."""
    return F.concat(db_id, F.lit(" | "), query_norm) if with_db_id else query_norm


def structure_pair(input_str: Column, structure: Column) -> tuple[Column, Column]:
    """(prompt | input, structure)."""
    return F.concat(F.lit(PROMPT + " | "), input_str), structure


def content_pair(input_str: Column, structure: Column, content: Column) -> tuple[Column, Column]:
    """(prompt + structure | input, content)."""
    return F.concat(F.lit(PROMPT), structure, F.lit(" | "), input_str), content


def with_predicted_structure(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """C10 in evaluation: ``used`` is the structure predicted for the example
    (``predictions``: ex_id, predicted; one row an example), the gold
    ``structure`` where none was predicted; ``from_prediction`` tells which."""
    j = examples.join(predictions, "ex_id", "left")
    return j.withColumns({"used": F.coalesce("predicted", "structure"), "from_prediction": F.col("predicted").isNotNull()}).drop("predicted")


def parse_back(text: Column) -> tuple[Column, Column]:
    """C11: (structure before ' | question:', db between '| database: ' and '. table: ')."""
    st = F.trim(F.regexp_extract(F.replace(text, F.lit(PROMPT), F.lit("")), r"^(.*?) \| question:", 1))
    db = F.regexp_extract(text, r"\| database: (.*?)\. table: ", 1)
    return st, db


def strip_db_prefix(pred: Column) -> Column:
    """Text after the first '|', trimmed."""
    return F.trim(F.element_at(F.split(pred, r"\|", 2), -1))


def repair_quoted_tokens(text: Column) -> Column:
    """Tokens ```` x ''`` → ``"x"``; other unquoted tokens lower-cased."""
    t = F.regexp_replace(text, r"`` (\S+) ''", "\"$1\"")
    toks = F.split(t, " ")
    return F.array_join(F.transform(toks, lambda w: F.when(w.contains('"') | w.contains("'"), w).otherwise(F.lower(w))), " ")
