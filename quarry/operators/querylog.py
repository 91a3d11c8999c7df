"""Query-log analytics: a table of SQL strings decomposed into clause facts.

Nothing is parsed one string at a time on the driver or in Python: a text is cut
into tokens and segmented inside its row (``segmentation``), and the per-query
features behind the difficulty class are array expressions over the segmented
tokens, so they need no token rows and no exchange.

Texts that differ in their literals only have one *shape* (string literals and
numbers masked), and blocks, clauses, features and scores depend on the shape
alone. Logs repeat shapes far more often than texts, so the work is done once per
distinct shape and joined back through the distinct texts.

Where rows per token are wanted (items, resolution, decomposition) the segmented
arrays are exploded after a repartition by query, which later windows and
aggregates keyed by ``query_id`` reuse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.fixed import AGG_OPS, SQL_OPS, TOKEN_PATTERN, WHERE_OPS
from ..session import cut_lineage
from .segmentation import CLAUSE_WORDS, COND_CLAUSES, let, segmented  # noqa: F401

AGGS = [a for a in AGG_OPS if a != "none"]
COND_OPERATORS = [o for o in WHERE_OPS if o != "not"]
MASKED_STRING, MASKED_NUMBER, MASKED_DECIMAL = '"?"', "0", "0.0"      # a decimal keeps its dot (F01's quirk)
BLOCK = ["query_id", "sel_depth", "sel_block", "branch"]
ITEM = BLOCK + ["clause", "item_no"]


# ------------------------------------------------------------------- E01/E02
def unify_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "'", '"')


def token_array(text: Column) -> Column:
    """Tokens of a SQL text: literals whole, words case-folded outside literals."""
    toks = F.regexp_extract_all(unify_quotes(text), F.lit(TOKEN_PATTERN), 0)
    return F.transform(toks, lambda t: F.when(t.startswith('"'), t).otherwise(F.lower(t)))


def odd_quotes(text: Column) -> Column:
    """An odd number of quote characters makes the text unparsable."""
    q = unify_quotes(text)
    return ((F.length(q) - F.length(F.replace(q, F.lit('"'), F.lit("")))) % 2) == 1


def tokenize(df: DataFrame, text_col: str, id_col: str = "query_id") -> DataFrame:
    """(query_id, pos, tok, is_lit), one row per token."""
    return (df.select(F.col(id_col).alias("query_id"),
                      F.posexplode(token_array(F.col(text_col))).alias("pos", "tok"))
              .withColumn("is_lit", F.col("tok").startswith('"')))


# ----------------------------------------------------------------------- E04
def is_literal(tok: Column) -> Column:
    return tok.startswith('"') | tok.rlike("^[0-9]")


def shape_of(text: Column) -> Column:
    """The text's tokens with string literals and numbers masked, one blank between."""
    return F.array_join(F.transform(token_array(text), lambda t: F.when(t.startswith('"'), F.lit(MASKED_STRING)).when(
        t.rlike("^[0-9]"), F.when(t.contains("."), F.lit(MASKED_DECIMAL)).otherwise(F.lit(MASKED_NUMBER))).otherwise(t)), " ")


def marked(tok: Column, pos: Column) -> Column:
    """A literal as a mark of its place, any other token as it is."""
    return F.when(is_literal(tok), F.concat(F.lit("\x01"), pos.cast("string"), F.lit("\x02"))).otherwise(tok)


def fill_marks(marked_text: Column, tokens: Column) -> Column:
    """The text with each mark replaced by the token at its place."""
    return F.array_join(F.transform(F.split(marked_text, "\x01"), lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.get(tokens, F.substring_index(p, "\x02", 1).cast("int")), F.substring_index(p, "\x02", -1)))), "")


def fill_columns(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``fill_marks`` in several columns; the text is cut into tokens once."""
    filled = let(token_array(text), lambda toks: F.struct(*[fill_marks(F.col(c), toks).alias(c) for c in columns]))
    return df.withColumn("filled", filled).select(*[c for c in df.columns if c not in columns], *[F.col("filled")[c].alias(c) for c in columns])


def shape_tokens(shape: Column) -> Column:
    return F.when(shape == "", F.array().cast("array<string>")).otherwise(F.split(shape, " "))


def token_rows(df: DataFrame, tokens: Column, id_col: str = "query_id") -> DataFrame:
    """Block / branch / clause / item columns for every token of ``tokens``."""
    # a fixed number of partitions: segmentation costs far more than its input's bytes tell AQE
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segs = df.select(F.col(id_col).alias("query_id"), tokens.alias("toks")).repartition(n, "query_id")
    rows = segs.select("query_id", F.explode(segmented(F.col("toks"))).alias("s")).select("query_id", "s.*")
    return rows.withColumn("is_lit", F.col("tok").startswith('"'))


def shape_rows(shapes: DataFrame) -> DataFrame:
    """E04 of the distinct shapes of ``text_shapes``; written once, read by many."""
    return cut_lineage(token_rows(shapes, shape_tokens(F.col("shape")), "text_id"))


def segment(df: DataFrame, text_col: str, id_col: str = "query_id") -> DataFrame:
    """E04 of a table of texts."""
    return token_rows(df, token_array(F.col(text_col)), id_col)


def _shown(seg: DataFrame, tok: str = "tok") -> str:
    """The column to write a token from: its mark in ``segment_facts``."""
    return f"shown_{tok}" if f"shown_{tok}" in seg.columns else tok


def segment_facts(df: DataFrame, text_col: str, facts: Callable[[DataFrame], DataFrame], with_marks: tuple[str, ...] = (),
                  id_col: str = "query_id") -> DataFrame:
    """``facts`` (query_id, ...) of the E04 rows of a table of texts, found once per
    distinct shape; the columns ``with_marks`` are written from ``_shown`` tokens and
    get each distinct text's literals. The texts of a repeated id are one query:
    their token rows are put together."""
    again = cut_lineage(df.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    single, together = df, None
    if not again.isEmpty():
        same = F.col(id_col).eqNullSafe(F.col("again"))
        single = df.join(again.hint("merge"), same, "left_anti")
        together = facts(cut_lineage(segment(df.join(again.hint("merge"), same, "left_semi"), text_col, id_col)))
    texts, shapes = text_shapes(single, text_col)
    marks = {"shown_tok": marked(F.col("tok"), F.col("pos")), "shown_prv": marked(F.col("prv"), F.col("pos") - 1),
             "shown_nxt": marked(F.col("nxt"), F.col("pos") + 1)}
    found = facts(shape_rows(shapes).withColumns(marks))
    columns = [c for c in found.columns if c != "query_id"]
    packed = cut_lineage(found.groupBy("query_id").agg(F.collect_list(F.struct(*columns)).alias("rows")))
    d = texts.join(packed, F.col("query_id") == F.col("text_id")).select("text", "rows")
    if with_marks:
        fill = lambda toks: F.transform("rows", lambda r: F.struct(*[
            (fill_marks(r[c], toks) if c in with_marks else r[c]).alias(c) for c in columns]))
        d = d.withColumn("rows", let(token_array(F.col("text")), fill))
    asked = single.select(F.col(id_col).alias("query_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = asked.hint("merge").join(d, "text").select("query_id", F.explode("rows").alias("r")).select("query_id", "r.*")
    return out if together is None else out.unionByName(together.select(*out.columns))


def alias_table(seg: DataFrame) -> DataFrame:
    """The (alias, table name) pairs of a query."""
    return seg.filter(F.col("tok") == "as").select("query_id", F.col(_shown(seg, "nxt")).alias("alias"),
                                                   F.col(_shown(seg, "prv")).alias("table_name")).distinct()


def items(seg: DataFrame) -> DataFrame:
    """E05-E13 raw material: one row per clause item, tokens in text order."""
    tok = F.col("tok")
    is_op = F.col("at_top") & tok.isin(*COND_OPERATORS)
    body = seg.filter(~F.col("is_struct") & F.col("clause").isNotNull() & (F.col("sbo") == 0) & (F.col("sbc") == 0))
    return body.groupBy(*ITEM).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(_shown(seg)).alias("tok")))), lambda x: x["tok"]), " ").alias("text"),
        F.min_by("tok", "pos").alias("first_tok"),
        F.min_by(F.when(is_op, tok), F.when(is_op, F.col("pos"))).alias("op"),
        F.max((F.col("at_top") & (tok == "not")).cast("int")).alias("has_not"),
        F.sum((tok.isin(*AGGS) & (F.col("nxt") == "(")).cast("int")).alias("n_agg"),
        F.min("pos").alias("pos"),
    )


# --------------------------------------------------------------- E22-E26
def _firsts(tokens: Column) -> Column:
    """The first of the given tokens in each clause item."""
    return F.filter(tokens, lambda t: ~F.exists(tokens, lambda u: u["clause"].eqNullSafe(t["clause"]) & (u["item_no"] == t["item_no"])
                                                & (u["pos"] < t["pos"])))


def _count(tokens: Column, condition) -> Column:
    return F.size(F.filter(tokens, lambda t: F.coalesce(condition(t), F.lit(False))))


def _items_with(tokens: Column, condition) -> Column:
    """In how many items (of one clause) a token meets the condition."""
    return F.size(F.array_distinct(F.transform(F.filter(tokens, lambda t: F.coalesce(condition(t), F.lit(False))), lambda t: t["item_no"])))


def feature_struct(segs: Column, compat: bool = True) -> Column:
    """component1, component2, others of a segmented text (top block, first branch).

    compat=True keeps the reference's counting: NOT conditions in WHERE and
    HAVING, and HAVING connectors, count as aggregates.
    """
    def parts(s: Column) -> Column:
        top = F.filter(s, lambda t: (t["sel_depth"] == 0) & (t["sel_block"] == 0))
        return let(top, lambda top: let(F.filter(top, lambda t: t["branch"] == 0), lambda top0: let(
            F.filter(top0, lambda t: ~t["is_struct"] & t["clause"].isNotNull() & (t["sbo"] == 0) & (t["sbc"] == 0)),
            lambda body: let(_firsts(body), lambda firsts: counts(s, top, top0, body, firsts)))))

    def counts(s: Column, top: Column, top0: Column, body: Column, firsts: Column) -> Column:
        of = lambda c: _count(firsts, lambda t: t["clause"] == c)
        agg_first = lambda c: _count(firsts, lambda t: (t["clause"] == c) & t["tok"].isin(*AGGS))
        is_agg = lambda t: t["tok"].isin(*AGGS) & (t["nxt"] == "(")
        counted = (lambda t: t["at_top"] & (t["tok"] == "not")) if compat else is_agg
        cond_agg = lambda c: _items_with(body, lambda t: (t["clause"] == c) & counted(t))
        has = lambda kw: (_count(top0, lambda t: t["kw"] == kw) > 0).cast("int")
        operators = F.filter(body, lambda t: t["clause"].isin(*COND_CLAUSES) & t["at_top"] & t["tok"].isin(*COND_OPERATORS))
        n_like = let(operators, lambda o: _count(_firsts(o), lambda t: t["tok"] == "like"))
        n_tables = _count(top0, lambda t: (t["clause"] == "from") & t["at_top"] & t["tok"].isin("from", "join", ","))
        c1 = (has("where") + has("group") + has("order") + has("limit") + F.greatest(n_tables - 1, F.lit(0))
              + _count(top0, lambda t: t["is_conn"] & (t["tok"] == "or")) + n_like)
        nested = _count(s, lambda t: (t["sbo"] == 1) & (t["sel_depth"] == 1) & (t["p_sel_block"] == 0) & (t["p_branch"] == 0)
                        & t["p_clause"].isin(*COND_CLAUSES))
        branched = _count(top, lambda t: t["branch"] > 0) > 0
        n_agg = (agg_first("select") + cond_agg("where") + agg_first("group")
                 + _count(body, lambda t: (t["clause"] == "order") & is_agg(t)) + cond_agg("having")
                 + (_count(top0, lambda t: t["is_conn"] & (t["clause"] == "having")) if compat else F.lit(0)))
        others = ((n_agg > 1).cast("int") + (of("select") > 1).cast("int") + (of("where") > 1).cast("int") + (of("group") > 1).cast("int"))
        return F.struct(c1.cast("bigint").alias("component1"), (nested + branched.cast("int")).cast("bigint").alias("component2"),
                        others.cast("bigint").alias("others"))

    return let(segs, parts)


def features(shapes: DataFrame, compat: bool = True) -> DataFrame:
    """(query_id, component1, component2, others) of texts given by shape."""
    f = feature_struct(segmented(shape_tokens(F.col("shape"))), compat)
    return shapes.select(F.col("text_id").alias("query_id"), f.alias("f")).select("query_id", "f.*")


def hardness_class(c1: Column, c2: Column, oth: Column) -> Column:
    """Easy / medium / hard / extra."""
    return (F.when((c1 <= 1) & (oth == 0) & (c2 == 0), "easy")
            .when(((oth <= 2) & (c1 <= 1) & (c2 == 0)) | ((c1 <= 2) & (oth < 2) & (c2 == 0)), "medium")
            .when(((oth > 2) & (c1 <= 2) & (c2 == 0)) | ((c1 > 2) & (c1 <= 3) & (oth <= 2) & (c2 == 0))
                  | ((c1 <= 1) & (oth == 0) & (c2 <= 1)), "hard")
            .otherwise("extra"))


def text_shapes(df: DataFrame, text_col: str, *by: str, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """The distinct texts as (text, by..., text_id) and their distinct shapes as
    (text_id, shape, by...): texts of one shape share the id. A NULL text is the
    empty one. Both distincts are pre-aggregated map-side, so a text repeated by a
    third of all rows collapses before the shuffle; ids are fixed by a checkpoint.
    ``counted``: each text brings its number of rows, ``n_rows``."""
    n_rows = ["n_rows"] if counted else []
    each = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *by)
    each = each.groupBy("text", *by).agg(F.count("*").alias("n_rows")) if counted else each.distinct()
    texts = cut_lineage(each.withColumn("shape", shape_of(F.col("text"))))
    shapes = cut_lineage(texts.select("shape", *by).distinct().withColumn("text_id", F.monotonically_increasing_id()))
    same = F.lit(True)
    for c in ("shape", *by):
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    return (texts.alias("t").join(shapes.alias("s"), same).select("t.text", *[f"t.{c}" for c in by], "s.text_id", *[f"t.{c}" for c in n_rows]),
            shapes.select("text_id", "shape", *by))


def hardness(df: DataFrame, text_col: str, id_col: str = "query_id", compat: bool = True) -> DataFrame:
    """(query_id, component1, component2, others, hardness) for a table of SQL
    texts; a NULL or empty text has no clauses and is easy."""
    texts, shapes = text_shapes(df, text_col)
    f = features(shapes, compat).withColumn("hardness", hardness_class(F.col("component1"), F.col("component2"), F.col("others")))
    per_text = texts.join(f, f["query_id"] == texts["text_id"]).drop("query_id", "text_id")
    return (df.select(F.col(id_col).alias("query_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(per_text, "text")
              .select("query_id", "component1", "component2", "others", "hardness"))


def keyword_set(seg: DataFrame) -> DataFrame:
    """Sorted keyword set of the top block's first branch, joined by ','."""
    it = items(seg).filter((F.col("sel_depth") == 0) & (F.col("branch") == 0))
    tok = F.col("tok")
    top = (F.col("sel_depth") == 0) & (F.col("sel_block") == 0)
    top0 = top & (F.col("branch") == 0)
    kws = seg.groupBy("query_id").agg(
        F.collect_set(F.when(top0 & F.col("kw").isin("where", "group", "having", "order", "limit"), F.col("kw"))).alias("a"),
        # only the set operation that follows the first branch belongs to the top query
        F.collect_set(F.when(top & tok.isin(*SQL_OPS) & F.col("is_struct") & (F.col("branch") == 1), tok)).alias("b"),
        F.collect_set(F.when(top0 & F.col("is_conn") & (tok == "or"), tok)).alias("c"),
        F.max_by(F.when(top0 & (F.col("clause") == "order") & tok.isin("asc", "desc"), tok),
                 F.when(top0 & (F.col("clause") == "order") & tok.isin("asc", "desc"), F.col("pos"))).alias("dir"),
    )
    conds = it.filter(F.col("clause").isin(*COND_CLAUSES)).groupBy("query_id").agg(
        F.max("has_not").alias("has_not"),
        F.max((F.col("op") == "in").cast("int")).alias("has_in"),
        F.max((F.col("op") == "like").cast("int")).alias("has_like"))
    k = kws.join(conds, "query_id", "left")
    order_dir = F.when(F.array_contains("a", "order"), F.coalesce(F.col("dir"), F.lit("asc")))
    extra = F.array(F.when(F.col("has_not") == 1, F.lit("not")), F.when(F.col("has_in") == 1, F.lit("in")),
                    F.when(F.col("has_like") == 1, F.lit("like")), order_dir)
    allk = F.array_sort(F.array_distinct(F.array_compact(F.concat("a", "b", "c", extra))))
    return k.select("query_id", F.array_join(allk, ",").alias("keywords"))


def order_and_limit(seg: DataFrame) -> DataFrame:
    """Per query, the ORDER direction of the top block (the last
    asc/desc wins, default asc), the limit flag and the true limit number, as text."""
    top = seg.filter((F.col("sel_depth") == 0) & (F.col("sel_block") == 0) & (F.col("branch") == 0))
    tok = F.col("tok")
    is_dir = (F.col("clause") == "order") & tok.isin("asc", "desc")
    is_lim = (F.col("clause") == "limit") & tok.rlike("^[0-9]+$")
    g = top.groupBy("query_id").agg(
        F.max((F.col("kw") == "order").cast("int")).alias("has_order"),
        F.max_by(F.when(is_dir, tok), F.when(is_dir, F.col("pos"))).alias("dir"),
        F.max((F.col("kw") == "limit").cast("int")).alias("has_limit"),
        F.min_by(F.when(is_lim, F.col(_shown(seg))), F.when(is_lim, F.col("pos"))).alias("lim"))
    return g.select("query_id", F.when(F.col("has_order") == 1, F.coalesce("dir", F.lit("asc"))).alias("order_dir"),
                    (F.col("has_limit") == 1).alias("has_limit"), F.coalesce("lim", F.lit("-1")).alias("limit_value"))   # -1: no limit


def condition_values(seg: DataFrame) -> DataFrame:
    """Per condition item (ON, WHERE, HAVING of any block) its operator,
    NOT flag and the kind of its first value: string, number, column or sub-query."""
    tok = F.col("tok")
    wi = W.partitionBy(*ITEM)
    op_top = F.col("at_top") & tok.isin(*COND_OPERATORS)
    c = seg.filter(F.col("clause").isin(*COND_CLAUSES))
    c = c.withColumn("op_pos", F.min(F.when(op_top, F.col("pos"))).over(wi))
    body = c.filter(~F.col("is_struct") & (F.col("sbo") == 0) & (F.col("sbc") == 0))
    after = F.col("pos") > F.col("op_pos")
    kind = (F.when(F.col("is_lit"), "string").when(tok.rlike(r"^[0-9]"), "number")
            .when(tok.isin("(", ")", "-", "+", "not", "null"), None).otherwise("column"))
    it = body.groupBy(*ITEM).agg(
        F.min_by(F.when(op_top, tok), F.when(op_top, F.col("pos"))).alias("op"),
        F.max((F.col("at_top") & (tok == "not")).cast("int")).alias("has_not"),
        F.min_by(F.when(after, kind), F.when(after & kind.isNotNull(), F.col("pos"))).alias("vkind"))
    subs = (seg.filter(F.col("sbo") == 1)
               .select("query_id", (F.col("sel_depth") - 1).alias("sel_depth"), F.col("p_sel_block").alias("sel_block"),
                       F.col("p_branch").alias("branch"), F.col("p_clause").alias("clause"), F.col("p_item_no").alias("item_no"))
               .distinct().withColumn("has_sub", F.lit(True)))
    out = it.join(subs, ITEM, "left")
    return out.select(*[F.col(k).cast("bigint").alias(k) if k not in ("query_id", "clause") else F.col(k) for k in ITEM],
                      "op", (F.col("has_not") == 1).alias("is_not"),
                      F.when(F.col("has_sub"), F.lit("subquery")).otherwise(F.coalesce("vkind", F.lit("none"))).alias("value_kind"))
