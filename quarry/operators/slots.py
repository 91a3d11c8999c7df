"""Structure / content decomposition of SQL and its inverse.

Structure keeps the SQL skeleton with slots: columns → ``[col]``, each FROM
body (tables, joins, ON conditions) → one ``[tab]``, each run of values →
one ``[val]``. Content lists the slot fillers in text order
(``[col] t1.c_name [tab] customer as t1 … [val] "F"``). Both come from the
segmented tokens of the text's shape with gaps-and-islands (runs keyed by a
running count over ``query_id``), once per distinct shape; the literals of each
text are filled in inside its row.

The inverse (F05) runs inside each row with higher-order array functions —
a map-only stage, no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.fixed import MALFORMED_SLOTS, MALFORMED_START
from . import querylog as Q

# Keyword groups of the structure serializer.
SQL_CLAUSES = ("select", "from", "where", "group", "having", "order", "limit", "intersect", "union", "except")
SQL_OPS_SPACE = (">", "<", "=", "like", "!=", "-", "+", "between", "and", "or", "not", "in", ")", "by", "distinct",
                 ">=", "<=", "<>")
SQL_OPS_NO_SPACE = ("count", "avg", "sum", "max", "min", "(", "!", "desc", "asc")
SQL_MARKS = (",",)
# Word-level structure vocabulary (finished-candidate filter, F07).
STRUCTURE_WORDS = ("select", "from", "where", "group", "by", "having", "order", "limit", "union", "intersect",
                   "except", "and", "or", "not", "between", "like", "in", "as", "distinct", "count", "max", "min",
                   "sum", "avg", "desc", "asc", "before", "after", "=", ">", "<", ">=", "<=", "!=", "!", "(", ")", ",",
                   "*", "[col]", "[tab]", "[val]")
SLOT_RE = r"\[(col|tab|val)\]"
SLOT_SPLIT_RE = r"\[(?:col|tab|val)\]"
KEEP = SQL_CLAUSES + SQL_OPS_SPACE + SQL_OPS_NO_SPACE + SQL_MARKS


def normalize_sql(text: Column) -> Column:
    """Lower-case words not touching a quote, collapse white space, ' , ' → ', '."""
    # runs of words that may be folded, with what is between them (1), and words at a quote (2); \w is ASCII
    cut = F.lit(r"""((?:(?<!['"\w])\w++(?!['"])|\W++)++)|(\w+)""")
    fold = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)
    s = F.array_join(F.zip_with(F.regexp_extract_all(text, cut, 1), F.regexp_extract_all(text, cut, 2), lambda a, b: F.concat(fold(a), b)), "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^ | $", "")
    return F.replace(s, F.lit(" , "), F.lit(", "))


def _tight(s: Column) -> Column:
    s = F.regexp_replace(s, r"\b(count|avg|sum|max|min) \(", "$1(")
    s = F.regexp_replace(s, r"\( ", "(")
    return F.regexp_replace(s, r" \)", ")")


def decompose(seg: DataFrame, column_names: DataFrame) -> DataFrame:
    """(query_id, structure, content) from the token table of shapes.

    ``column_names`` has one lower-cased ``column_name`` per catalog column.
    Literals stand in ``content`` as marks of their places, for
    ``querylog.fill_marks`` with the tokens of each text of the shape.
    """
    names = column_names.select(F.col("column_name").alias("cname")).distinct()
    tok = F.col("tok")
    t = seg.join(names, tok == F.col("cname"), "left")
    in_from = F.col("clause").isin("from", "on") & (tok != "from")
    is_col = ~F.col("is_lit") & ((tok == "*") | tok.contains(".") | F.col("cname").isNotNull())
    kind = (F.when(in_from & (F.col("sbo") == 0) & (F.col("sbc") == 0), "tab")
            .when(F.col("is_lit"), "val")
            .when(tok.isin(*KEEP), "keep")
            .when(is_col, "col")
            .otherwise("val"))
    t = t.withColumn("kind", kind)
    wq = W.partitionBy("query_id").orderBy("pos")
    t = t.withColumn("run", F.sum((F.col("kind") != "val").cast("int")).over(wq.rowsBetween(W.unboundedPreceding, 0)))
    st = lambda c: F.col(c).cast("string")
    piece_key = (F.when(F.col("kind") == "tab", F.concat_ws(":", F.lit("t"), st("sel_depth"), st("sel_block"), st("branch")))
                 .when(F.col("kind") == "val", F.concat_ws(":", F.lit("v"), st("run")))
                 .otherwise(F.concat_ws(":", F.lit("p"), st("pos"))))
    pieces = t.groupBy("query_id", piece_key.alias("pk")).agg(
        F.min("pos").alias("ppos"), F.first("kind").alias("kind"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "pos", F.when(~tok.isin("(", ")") | (F.col("kind") != "tab"), Q.marked(tok, F.col("pos"))).alias("b")))), lambda x: x["b"]), " ").alias("body"))
    struct_piece = F.when(F.col("kind") == "keep", F.col("body")).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("]")))
    content_piece = F.when(F.col("kind") != "keep", F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("body")))
    out = pieces.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ppos", struct_piece.alias("s")))), lambda x: x["s"]), " ").alias("structure"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ppos", content_piece.alias("c")))), lambda x: x["c"]), " ").alias("content"))
    return out.select("query_id", normalize_sql(_tight(F.col("structure"))).alias("structure"), "content")


def slot_counts(text: Column) -> Column:
    """struct(n_col, n_tab, n_val)."""
    k = F.regexp_extract_all(text, F.lit(SLOT_RE), 1)

    def count_of(kind):
        return F.size(F.filter(k, lambda x: x == F.lit(kind)))
    return F.struct(*[count_of(kk).alias(f"n_{kk}") for kk in ("col", "tab", "val")])


def combine(structure: Column, content: Column) -> Column:
    """fill the structure's slots left to right per kind with the
    content's fillers; a slot-count mismatch returns the structure unfilled."""
    def kinds(st: Column, ct: Column) -> Column:
        texts = F.transform(F.filter(F.split(ct, SLOT_SPLIT_RE, -1), lambda x, i: i > 0), lambda x: F.trim(x))
        return Q.let(F.struct(F.regexp_extract_all(st, F.lit(SLOT_RE), 1).alias("slots"), F.split(st, SLOT_SPLIT_RE, -1).alias("pieces"),
                              F.arrays_zip(F.regexp_extract_all(ct, F.lit(SLOT_RE), 1).alias("k"), texts.alias("v")).alias("fillers")),
                     lambda x: fill(st, x["slots"], x["pieces"], x["fillers"]))

    def fill(st: Column, slots: Column, pieces: Column, fillers: Column) -> Column:
        same = F.forall(F.array(F.lit("col"), F.lit("tab"), F.lit("val")), lambda kk: F.size(F.filter(slots, lambda x: x == kk))
                        == F.size(F.filter(fillers, lambda x: x["k"] == kk)))
        vals = F.transform(slots, lambda k, i: F.get(F.filter(fillers, lambda z: z["k"] == k),
                                                     F.size(F.filter(F.slice(slots, 1, i + 1), lambda y: y == k)) - 1)["v"])
        filled = Q.let(vals, lambda v: F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(F.get(v, i - 1), p))), ""))
        filled = F.when(F.size(slots) == 0, st).otherwise(filled)
        return F.when(same, F.regexp_replace(filled, "^ ", "")).otherwise(st)

    return Q.let(F.struct(structure.alias("s"), content.alias("c")), lambda x: kinds(x["s"], x["c"]))


def structure_vocab_ok(structure: Column) -> Column:
    """every word of a finished structure is in the structure vocabulary."""
    toks = F.regexp_extract_all(structure, F.lit(r"\[(?:col|tab|val)\]|[a-z_]+|>=|<=|!=|[=<>(),*!]|\S"), 0)
    vocab = F.array(*[F.lit(w) for w in STRUCTURE_WORDS])
    return F.size(F.array_except(toks, vocab)) == 0


def slot_order_ok(structure: Column, content: Column) -> Column:
    """the content's slot kinds follow the structure's; brackets well formed."""
    sk = F.regexp_extract_all(structure, F.lit(SLOT_RE), 1)
    ck = F.regexp_extract_all(content, F.lit(SLOT_RE), 1)
    n_open = F.length(content) - F.length(F.replace(content, F.lit("["), F.lit("")))
    n_close = F.length(content) - F.length(F.replace(content, F.lit("]"), F.lit("")))
    malformed = reduce(or_, [content.contains(x) for x in MALFORMED_SLOTS]) | content.startswith(MALFORMED_START)
    return (F.slice(sk, 1, F.size(ck)) == ck) & (n_open == n_close) & (F.size(ck) == n_open) & ~malformed


def decode_comparators(structure: Column) -> Column:
    """``before`` → ``<``, ``after`` → ``>``."""
    return F.replace(F.replace(structure, F.lit("before"), F.lit("<")), F.lit("after"), F.lit(">"))


def first_valid(hyp: DataFrame, valid_col: str = "valid") -> DataFrame:
    """per example the first candidate (by rank) that is valid, else rank 0's."""
    return hyp.groupBy("ex_id").agg(
        F.min_by(F.struct("hyp_rank", "pred"), F.struct((~F.col(valid_col)).alias("bad"), F.col("hyp_rank"))).alias("pick"),
        F.max(F.col(valid_col).cast("int")).alias("any_valid")).select(
        "ex_id", F.col("pick.hyp_rank").alias("chosen_rank"), F.col("pick.pred").alias("pred_sql"),
        (F.col("any_valid") == 1).alias("found_valid"))


def group_hypotheses(flat: DataFrame, beams: int) -> DataFrame:
    """flat generation index → (example, rank); keeps every candidate."""
    return flat.select(F.expr(f"gen_idx div {int(beams)}").alias("ex_no"), (F.col("gen_idx") % beams).cast("int").alias("hyp_rank"), "*")
