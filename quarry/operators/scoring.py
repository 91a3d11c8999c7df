"""Gold-vs-predicted SQL scoring (E03, E05-E21, E27-E42) as joins and aggregates.

Both sides of every pair become rows of one token table (query_id = 2·pair_id
+ side), segmented once (querylog.segment: one exchange on query_id). Column
references are resolved against the catalog (aliases, then the first FROM
table that has a bare column), canonicalized through foreign-key groups, and
values/DISTINCT are masked. Every clause then becomes a multiset of item
signatures ``(query_id, branch, comp, sig)``; a component's matched count is
``sum(least(gold_count, pred_count))`` over a full outer join of the two
sides' signature counts — the reference's remove-one-at-a-time loop, as a join.

Nested sub-queries are compared by the masked signature text of their block;
set-operation operands by an exact signature built from all their component
multisets (equal multisets ⇔ every component's F1 is 1).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.fixed import (AGG_OPS, COND_OPS, JOIN_KEYWORDS, LEVELS, ORDER_OPS, PARTIAL_TYPES, SQL_OPS,
                               WHERE_OPS)
from ..functions.plan_utils import components
from ..session import cut_lineage
from . import querylog as Q

AGGS = [a for a in AGG_OPS if a != "none"]
NOT_COLUMNS = sorted(set(Q.CLAUSE_WORDS) | set(SQL_OPS) | set(AGGS) | set(WHERE_OPS) | set(COND_OPS)
                     | set(ORDER_OPS) | set(JOIN_KEYWORDS) | {"by", "distinct", "null"})
MASK = "?"
REF_CLAUSES = ("select", "where", "group", "having", "order", "on")


# --------------------------------------------------------------------- sides
def sides(pairs: DataFrame, id_col: str = "query_id", gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """(query_id, pair_id, side, sql): side 0 = gold, 1 = predicted."""
    s = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(gold_col).alias("sql")),
                          F.struct(F.lit(1).alias("side"), F.col(pred_col).alias("sql")))).alias("s")
    return (pairs.select(F.col(id_col).alias("pair_id"), s)
                 .select((F.col("pair_id") * 2 + F.col("s.side")).alias("query_id"), "pair_id",
                         F.col("s.side").alias("side"), F.col("s.sql").alias("sql")))


# ------------------------------------------------------------- E18 FK groups
def fk_canonical(spark: SparkSession, cols: DataFrame, fks: DataFrame) -> DataFrame:
    """Every column of a foreign-key group → its lowest-ordinal member: the
    connected components of the foreign-key edges of each database."""
    lab, _ = components(fks.select("db_id", F.col("column_id").alias("a"), F.col("other_column_id").alias("b")), ["db_id"])
    lab = lab.withColumnRenamed("comp", "label")
    ident = lambda p: F.concat(F.lit("__"), F.lower(F.col(p + "table_name")), F.lit("."), F.lower(F.col(p + "column_name")), F.lit("__"))
    c = cols.filter("column_id > 0").select("db_id", "column_id", "table_name", "column_name")
    src = c.select("db_id", F.col("column_id").alias("node"), ident("").alias("col_ident"))
    dst = c.select("db_id", F.col("column_id").alias("label"), ident("").alias("canon_ident"))
    return lab.join(src, ["db_id", "node"]).join(dst, ["db_id", "label"]).select("db_id", "col_ident", "canon_ident")


# --------------------------------------------------------- E03, E06, E15, E16
def catalog_maps(cols: DataFrame, canon: DataFrame) -> DataFrame:
    """One row per database: its tables, its ``table.column`` names and its
    foreign-key canonical map. Joined by db_id, so a run may hold any number of
    databases, of any size."""
    c = cols.filter("column_id > 0").select("db_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"))
    names = c.groupBy("db_id").agg(
        F.collect_set("t").alias("cat_tables"),
        F.map_from_entries(F.collect_set(F.struct(F.concat_ws(".", "t", "c").alias("k"), F.lit(True).alias("v")))).alias("cat_columns"))
    groups = canon.groupBy("db_id").agg(F.map_from_entries(F.collect_set(F.struct("col_ident", "canon_ident"))).alias("cat_canon"))
    return names.join(groups, "db_id", "left")


def resolve(seg: DataFrame, cols: DataFrame, canon: DataFrame, db_id: str | DataFrame) -> DataFrame:
    """Adds ``sig`` (resolved, canonical, masked token) and ``invalid`` per query.

    Alias pairs (E03) and FROM tables (E06) are collected per query / per block
    by windows over ``query_id``-prefixed keys; the query's database brings its
    catalog by one join. ``db_id``: one database, or a table (query_id, db_id).
    A query whose database is unknown has no tables, so it is invalid.
    """
    tab_arr, col_map, canon_map = F.col("cat_tables"), F.col("cat_columns"), F.col("cat_canon")
    tok, prv = F.col("tok"), F.col("prv")
    wq = W.partitionBy("query_id")
    wb = W.partitionBy("query_id", "sel_depth", "sel_block", "branch")
    is_ftab = (F.col("clause") == "from") & F.col("at_top") & ~F.col("is_struct") & (tok != "as") \
        & ~F.coalesce(prv == "as", F.lit(False)) & ~tok.isin("(", ")")
    t = seg.withColumn("is_ftab", is_ftab)
    if not isinstance(db_id, str):
        t = t.join(db_id, "query_id", "left")
    t = t.withColumns({
        # Alias table, query-wide
        "aliases": F.array_sort(F.collect_list(F.when(tok == "as", F.struct(F.col("nxt").alias("a"), prv.alias("t")))).over(wq)),
        # FROM tables of the block, in FROM order
        "ftabs": F.array_sort(F.collect_list(F.when(F.col("is_ftab"), F.struct("pos", "tok"))).over(wb)),
        # E19 scope: tables of the top-level FROM
        "scope": F.collect_set(F.when(F.col("is_ftab") & (F.col("sel_depth") == 0) & (F.col("branch") == 0), tok)).over(wq),
    })
    # every block, set-operation branches included, needs SELECT and FROM
    t = t.withColumn("no_body", (F.max((tok == "select").cast("int")).over(wb) == 0) | (F.max((tok == "from").cast("int")).over(wb) == 0))
    maps = catalog_maps(cols, canon)
    if isinstance(db_id, str):      # one database: its one catalog row goes to every task
        t = t.join(F.broadcast(maps.filter(F.col("db_id") == db_id).drop("db_id")), F.lit(True), "left")
    else:
        t = t.join(maps, "db_id", "left")
    is_ref = (F.col("clause").isin(*REF_CLAUSES) & ~F.col("is_struct") & ~F.col("is_lit")
              & tok.rlike(r"^([a-z_][a-z0-9_.]*|\*)$") & ~tok.isin(*NOT_COLUMNS) & (F.col("sbo") == 0) & (F.col("sbc") == 0))
    a = F.substring_index(tok, ".", 1)
    c = F.substring_index(tok, ".", -1)
    alias_t = F.get(F.transform(F.filter("aliases", lambda x: x["a"] == a), lambda x: x["t"]), 0)
    dotted_t = F.coalesce(alias_t, a)
    bare_t = F.get(F.transform(F.filter("ftabs", lambda x: F.coalesce(col_map[F.concat(x["tok"], F.lit("."), tok)], F.lit(False))),
                               lambda x: x["tok"]), 0)
    rtable = F.when(tok.contains("."), dotted_t).otherwise(bare_t)
    rcol = F.when(tok.contains("."), c).otherwise(tok)
    known = F.coalesce(col_map[F.concat(rtable, F.lit("."), rcol)], F.lit(False))
    ident = (F.when(~is_ref, F.lit(None))
             .when(tok == "*", F.lit("__all__"))
             .when(known, F.concat(F.lit("__"), rtable, F.lit("."), rcol, F.lit("__"))))
    t = t.withColumns({"is_ref": is_ref, "rtable": rtable, "ident0": ident})
    canon_ident = F.when(F.array_contains("scope", F.col("rtable")), canon_map[F.col("ident0")])
    t = t.withColumn("ident", F.coalesce(canon_ident, F.col("ident0")))
    bad = ((F.col("is_ref") & F.col("ident0").isNull())
           | (F.col("is_ftab") & ~F.coalesce(F.array_contains(tab_arr, tok), F.lit(False))) | F.col("no_body"))
    # §8 #11: constructs outside the scored subset make the text unparsable
    outside = (tok.isin("exists", "is")
               | ((F.col("clause") == "from") & tok.isin("left", "right", "outer", "full", "cross", "natural"))
               | ((F.col("clause") == "from") & F.col("at_top") & (tok == ","))
               | ((F.col("clause") == "from") & (tok == "as") & (prv == ")"))
               | ((tok == ",") & (F.col("in_list") == 1)))
    t = t.withColumn("bad", (bad | F.coalesce(outside, F.lit(False))).cast("int")).drop("cat_tables", "cat_columns", "cat_canon", "no_body")
    quotes = F.length("tok") - F.length(F.regexp_replace("tok", '"', ""))
    t = t.withColumn("invalid", F.coalesce(
        F.max("bad").over(wq) == 1, F.lit(False))
        | ((F.sum(quotes).over(wq) % 2) != 0) | (F.sum((tok == "(").cast("int") - (tok == ")").cast("int")).over(wq) != 0))
    sig = (F.when(F.col("ident").isNotNull(), F.col("ident"))
           .when(F.col("is_lit") | tok.rlike(r"^[0-9]"), F.lit(MASK))      # E20 value masking
           .when(tok == "distinct", F.lit(None))                            # E21 distinct masking
           .otherwise(tok))
    return t.withColumn("sig", sig).drop("aliases", "ftabs", "scope", "ident0", "bad")


def _join_sig(col: str = "sig") -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", col))), lambda x: x[col]), " ")


# ----------------------------------------------------------- E05-E14 items
def component_items(rs: DataFrame) -> DataFrame:
    """(query_id, branch, comp, sig) for the top-level block of every query;
    invalid queries contribute no items (E39: scored as the empty query)."""
    tok = F.col("tok")
    rs = rs.filter(~F.col("invalid"))
    op_top = F.col("at_top") & tok.isin(*Q.COND_OPERATORS)
    wi = W.partitionBy(*Q.ITEM)
    rs = rs.withColumn("op_pos", F.min(F.when(op_top, F.col("pos"))).over(wi))
    # sub-query signatures, attached to the parent item (E14): all tokens between
    # a sub-query's parentheses, deeper levels included, without alias names
    started = F.when((F.col("sbo") == 1) & (F.col("sel_depth") == 1), F.col("sel_block"))
    inner = rs.withColumn("root", F.last(started, ignorenulls=True).over(
        W.partitionBy("query_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    named = (tok == "as") | F.coalesce(F.col("prv") == "as", F.lit(False))
    subs = (inner.filter((F.col("sel_depth") >= 1) & F.col("sig").isNotNull() & ~named)
                 .groupBy("query_id", F.col("root").alias("sel_block")).agg(_join_sig().alias("sub_sig")))
    openers = rs.filter((F.col("sbo") == 1) & (F.col("sel_depth") == 1)).select(
        "query_id", "sel_block", "p_sel_block", "p_branch", "p_clause", "p_item_no")
    attached = openers.join(subs, ["query_id", "sel_block"])
    nested = (attached.groupBy("query_id", F.lit(0).cast("long").alias("sel_depth"), F.col("p_sel_block").alias("sel_block"),
                               F.col("p_branch").alias("branch"), F.col("p_clause").alias("clause"), F.col("p_item_no").alias("item_no"))
                      .agg(F.array_join(F.sort_array(F.collect_list("sub_sig")), " ; ").alias("nested")))
    body = rs.filter(~F.col("is_struct") & F.col("clause").isNotNull() & (F.col("sbo") == 0) & (F.col("sbc") == 0)
                     & (F.col("sel_depth") == 0) & F.col("sig").isNotNull())
    lhs = F.when((F.col("pos") < F.col("op_pos")) & (tok != "not"), F.col("sig"))
    items = body.groupBy(*Q.ITEM).agg(
        _join_sig().alias("text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos"), lhs.alias("l")))), lambda x: x["l"]), " ").alias("lhs"),
        F.max(F.when(F.col("at_top") & (tok == "not"), 1).otherwise(0)).alias("has_not"),
        F.min_by(F.when(op_top, tok), F.when(op_top, F.col("pos"))).alias("op"),
        F.min("pos").alias("ipos"),
    ).join(nested, Q.ITEM, "left")
    agg_re = r"^(max|min|count|sum|avg) \( (.*) \)$"
    c = F.col("clause")
    cond = F.concat_ws("|", F.when(F.col("has_not") == 1, F.lit("not")).otherwise(F.lit("")), F.coalesce("op", F.lit("")),
                       F.col("lhs"), F.coalesce("nested", F.lit(MASK)))
    key = ["query_id", "branch"]
    sel = items.filter(c == "select")
    whr = items.filter(c == "where")
    grp = items.filter(c == "group")
    rows = [
        sel.select(*key, F.lit("select").alias("comp"), F.col("text").alias("sig")),
        sel.select(*key, F.lit("select(no AGG)").alias("comp"), F.regexp_replace("text", agg_re, "$2").alias("sig")),
        whr.select(*key, F.lit("where").alias("comp"), cond.alias("sig")),
        whr.select(*key, F.lit("where(no OP)").alias("comp"), F.col("lhs").alias("sig")),
        grp.select(*key, F.lit("group(no Having)").alias("comp"),
                   F.when(F.col("text").contains("."), F.substring_index("text", ".", -1)).otherwise(F.col("text")).alias("sig")),
    ]
    ordered = lambda cond_, col: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond_, F.struct("ipos", col)))),
                                                          lambda x: x[col]), " , ")
    top = rs.filter((F.col("sel_depth") == 0) & (F.col("sel_block") == 0))
    blockwide = top.groupBy(*key).agg(
        F.max((F.col("kw") == "group").cast("int")).alias("has_group"),
        F.max((F.col("kw") == "order").cast("int")).alias("has_order"),
        F.max((F.col("kw") == "limit").cast("int")).alias("has_limit"),
        F.max_by(F.when((F.col("clause") == "order") & tok.isin("asc", "desc"), tok),
                 F.when((F.col("clause") == "order") & tok.isin("asc", "desc"), F.col("pos"))).alias("dir"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_conn") & (F.col("clause") == "where"), tok))), ",").alias("ao"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_conn") & (F.col("clause") == "having"), F.struct("pos", "tok")))),
                                 lambda x: x["tok"]), ",").alias("having_conn"),
    )
    order_items = items.filter((c == "order")).withColumn("osig", F.trim(F.regexp_replace("text", r"\b(asc|desc)\b", "")))
    ogroup = items.groupBy(*key).agg(
        ordered(c == "group", "text").alias("group_list"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c == "having", F.struct("ipos", cond.alias("h"))))),
                                 lambda x: x["h"]), " & ").alias("having_sig"))
    oorder = order_items.groupBy(*key).agg(ordered(F.lit(True), "osig").alias("order_list"))
    bw = blockwide.join(ogroup, key, "left").join(oorder, key, "left")
    # having connectors keep their order: they are part of the having list
    rows += [
        bw.filter("has_group = 1").select(*key, F.lit("group").alias("comp"),
                                          F.concat_ws("#", F.coalesce("group_list", F.lit("")), F.coalesce("having_sig", F.lit("")),
                                                      F.coalesce("having_conn", F.lit(""))).alias("sig")),
        bw.filter("has_order = 1").select(*key, F.lit("order").alias("comp"),
                                          F.concat_ws("#", F.coalesce("dir", F.lit("asc")), F.coalesce("order_list", F.lit("")),
                                                      F.col("has_limit").cast("string")).alias("sig")),
        bw.filter(F.col("ao") != "").select(*key, F.lit("and/or").alias("comp"), F.col("ao").alias("sig")),
    ]
    # E22 keywords (one row per keyword)
    kwrows = items.filter(c.isin(*Q.COND_CLAUSES)).select(
        *key, F.explode(F.array(F.when(F.col("has_not") == 1, F.lit("not")), F.when(F.col("op") == "in", F.lit("in")),
                                F.when(F.col("op") == "like", F.lit("like")))).alias("sig"))
    kwrows = kwrows.unionByName(top.filter(F.col("kw").isin("where", "group", "having", "order", "limit"))
                                   .select(*key, F.col("kw").alias("sig")))
    kwrows = kwrows.unionByName(top.filter(F.col("is_conn") & (tok == "or")).select(*key, tok.alias("sig")))
    kwrows = kwrows.unionByName(bw.filter("has_order = 1").select(*key, F.coalesce("dir", F.lit("asc")).alias("sig")))
    setops = top.filter(tok.isin(*SQL_OPS) & F.col("is_struct")).select("query_id", (F.col("branch") - 1).alias("branch"), tok.alias("sig"))
    kwrows = kwrows.unionByName(setops)
    rows.append(kwrows.filter(F.col("sig").isNotNull()).distinct().select(*key, F.lit("keywords").alias("comp"), "sig"))
    # tables of the block (E06), for exact match
    tabs = rs.filter((F.col("clause") == "from") & F.col("at_top") & ~F.col("is_struct") & (tok != "as")
                     & ~F.coalesce(F.col("prv") == "as", F.lit(False)) & ~tok.isin("(", ")")
                     & (F.col("sel_depth") == 0) & (F.col("sel_block") == 0))
    rows.append(tabs.select(*key, F.lit("tables").alias("comp"), F.concat(F.lit("__"), tok, F.lit("__")).alias("sig")))
    # a derived table counts by its block's signature
    rows.append(attached.filter((F.col("p_clause") == "from") & (F.col("p_sel_block") == 0)).select(
        "query_id", F.col("p_branch").alias("branch"), F.lit("tables").alias("comp"), F.concat(F.lit("( "), "sub_sig", F.lit(" )")).alias("sig")))
    rows.append(setops.select(*key, F.lit("setop").alias("comp"), "sig"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def pair_components(ci: DataFrame, sides_df: DataFrame) -> DataFrame:
    """(pair_id, comp, label_total, pred_total, cnt, acc, rec, f1)."""
    key = sides_df.select("query_id", "pair_id", "side")
    b0 = ci.filter(F.col("branch") == 0).join(key, "query_id")
    multiset = ["select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "keywords"]
    counts = (b0.filter(F.col("comp").isin(*multiset))
                .groupBy("pair_id", "comp", "sig").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("g"),
                                                       F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("p")))
    ms = counts.groupBy("pair_id", "comp").agg(F.sum("g").alias("label_total"), F.sum("p").alias("pred_total"),
                                                F.sum(F.least("g", "p")).alias("cnt"))
    single = (b0.filter(F.col("comp").isin("group", "order", "and/or"))
                .groupBy("pair_id", "comp").agg(F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("gs"),
                                                F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("ps")))
    same = F.coalesce(F.col("gs") == F.col("ps"), F.lit(False))
    n_set = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), 0).otherwise(F.size(F.split(F.col(c), ",")))
    sg = single.select(
        "pair_id", "comp",
        F.when(F.col("comp") == "and/or", F.when(F.col("gs").eqNullSafe(F.col("ps")), 1).otherwise(n_set("ps")))
         .otherwise(F.col("gs").isNotNull().cast("int")).alias("label_total"),
        F.when(F.col("comp") == "and/or", F.when(F.col("gs").eqNullSafe(F.col("ps")), 1).otherwise(n_set("gs")))
         .otherwise(F.col("ps").isNotNull().cast("int")).alias("pred_total"),
        F.when(F.col("comp") == "and/or", F.when(F.col("gs").eqNullSafe(F.col("ps")), 1).otherwise(0))
         .otherwise(same.cast("int")).alias("cnt"))
    # IUEN (E34): same set-op kind and exactly matching operand
    ops = iuen_rows(ci, key)
    grid = sides_df.select("pair_id").distinct().select(
        "pair_id", F.explode(F.array(*[F.lit(c) for c in PARTIAL_TYPES])).alias("comp"))
    r = (grid.join(ms.unionByName(sg).unionByName(ops), ["pair_id", "comp"], "left")
             .na.fill(0, ["label_total", "pred_total", "cnt"]))
    ok = (F.col("label_total") == F.col("pred_total")) & (F.col("cnt") == F.col("pred_total"))
    return r.select("pair_id", "comp", *[F.col(c).cast("bigint").alias(c) for c in ("label_total", "pred_total", "cnt")],
                    *[F.when(ok, 1).otherwise(0).cast("bigint").alias(c) for c in ("acc", "rec", "f1")])


def iuen_rows(ci: DataFrame, key: DataFrame) -> DataFrame:
    per_branch = ci.filter(F.col("comp") != "setop").groupBy("query_id", "branch").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "comp", "sig"))), "\u0001").alias("bsig"))
    kinds = ci.filter(F.col("comp") == "setop").select("query_id", "branch", F.col("sig").alias("kind"))
    later = (per_branch.join(kinds, ["query_id", "branch"], "left").filter("branch >= 1")
                       .groupBy("query_id").agg(F.array_join(F.transform(
                           F.sort_array(F.collect_list(F.struct("branch", F.concat_ws("@", F.coalesce("kind", F.lit("")), "bsig").alias("s")))),
                           lambda x: x["s"]), "\u0002").alias("operand")))
    first = kinds.filter("branch = 0").select("query_id", F.col("kind").alias("setop"))
    q = first.join(later, "query_id", "left").join(key, "query_id")
    p = q.groupBy("pair_id").agg(F.max(F.when(F.col("side") == 0, F.col("setop"))).alias("gk"),
                                 F.max(F.when(F.col("side") == 1, F.col("setop"))).alias("pk"),
                                 F.max(F.when(F.col("side") == 0, F.col("operand"))).alias("go"),
                                 F.max(F.when(F.col("side") == 1, F.col("operand"))).alias("po"))
    return p.select("pair_id", F.lit("IUEN").alias("comp"), F.col("gk").isNotNull().cast("int").alias("label_total"),
                    F.col("pk").isNotNull().cast("int").alias("pred_total"),
                    (F.coalesce(F.col("gk") == F.col("pk"), F.lit(False)) & F.col("go").eqNullSafe(F.col("po"))).cast("int").alias("cnt"))


def exact_match(comp: DataFrame, ci: DataFrame, sides_df: DataFrame) -> DataFrame:
    """All ten component F1 = 1 and (gold has no tables or) equal sorted tables."""
    key = sides_df.select("query_id", "pair_id", "side")
    tabs = (ci.filter((F.col("comp") == "tables") & (F.col("branch") == 0)).join(key, "query_id")
              .groupBy("pair_id").agg(F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("sig")))).alias("gt"),
                                      F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("sig")))).alias("pt")))
    allf1 = comp.groupBy("pair_id").agg(F.min("f1").alias("min_f1"))
    t = allf1.join(tabs, "pair_id", "left")
    same_tabs = F.coalesce(F.size("gt") == 0, F.lit(True)) | F.coalesce(F.col("gt") == F.col("pt"), F.lit(False))
    return t.select("pair_id", ((F.col("min_f1") == 1) & same_tabs).cast("bigint").alias("exact"))


def score_pairs(spark: SparkSession, pairs: DataFrame, cols: DataFrame, fks: DataFrame, db_id: str | None = None,
                compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """(per-component rows, per-pair report) for a table of gold/pred pairs.

    Without ``db_id`` each pair names its database in a column ``db_id``. A NULL
    or empty side is an invalid text: it is scored as the empty query.

    Values are masked (E20), so work is done once per distinct shape of a text
    (token pipeline) and once per distinct pair of shapes (comparison); results
    join back to pairs through the distinct texts.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    p = pairs.select(F.col("query_id").alias("pair_id"), text("gold"), text("pred"),
                     (F.lit(db_id) if db_id else F.col("db_id")).alias("db_id"))
    texts, shapes = Q.text_shapes(p.select(F.col("gold").alias("t"), "db_id").unionByName(p.select(F.col("pred").alias("t"), "db_id")),
                                  "t", "db_id")
    ids = (p.join(texts.select(F.col("text").alias("gold"), "db_id", F.col("text_id").alias("g_id")), ["gold", "db_id"])
            .join(texts.select(F.col("text").alias("pred"), "db_id", F.col("text_id").alias("p_id")), ["pred", "db_id"])
            .select("pair_id", "g_id", "p_id"))
    database = db_id or shapes.select(F.col("text_id").alias("query_id"), "db_id")
    tp = cut_lineage(ids.select("g_id", "p_id").distinct().withColumn("tp_id", F.monotonically_increasing_id()))
    s = (tp.select(F.col("g_id").alias("query_id"), F.col("tp_id").alias("pair_id"), F.lit(0).alias("side"))
           .unionByName(tp.select(F.col("p_id").alias("query_id"), F.col("tp_id").alias("pair_id"), F.lit(1).alias("side"))))
    # the resolved token table feeds a dozen aggregates and the item table
    # several comparisons: both are checkpointed into the shared folder, which
    # also keeps the query plans of the later phases small
    seg = Q.shape_rows(shapes)
    canon = fk_canonical(spark, cols, fks)
    keep = ["query_id", "pos", "tok", "prv", "nxt", "at_top", "sel_depth", "sel_block", "branch", "clause", "item_no",
            "kw", "is_conn", "is_struct", "sbo", "sbc", "p_sel_block", "p_branch", "p_clause", "p_item_no", "sig", "invalid"]
    # read back once, hash-partitioned on query_id and cached: every later
    # aggregate keyed by query_id (items, features, flags) then runs without
    # another exchange (a lost cached block is re-read from the checkpoint)
    rs = (cut_lineage(resolve(seg, cols, canon, database).select(*keep))
          .repartition("query_id").persist(StorageLevel.MEMORY_AND_DISK))
    ci = cut_lineage(component_items(rs))
    comp_tp = pair_components(ci, s)
    ex_tp = exact_match(comp_tp, ci, s)
    inv = rs.select("query_id", "invalid").distinct()
    hard = Q.features(shapes, compat)
    hard = hard.select("query_id", Q.hardness_class(F.col("component1"), F.col("component2"), F.col("others")).alias("hardness"))
    pmap = ids.join(tp, ["g_id", "p_id"])
    comp = pmap.join(comp_tp.withColumnRenamed("pair_id", "tp_id"), "tp_id").select(
        "pair_id", "comp", "label_total", "pred_total", "cnt", "acc", "rec", "f1")
    report = (pmap.join(ex_tp.withColumnRenamed("pair_id", "tp_id"), "tp_id")
                  .join(inv.select(F.col("query_id").alias("g_id"), F.col("invalid").alias("gold_invalid")), "g_id", "left")
                  .join(inv.select(F.col("query_id").alias("p_id"), F.col("invalid").alias("pred_invalid")), "p_id", "left")
                  .join(hard.select(F.col("query_id").alias("g_id"), "hardness"), "g_id", "left")
                  # a text without tokens has no row: it is invalid as well
                  .select("pair_id", "exact", F.coalesce("gold_invalid", F.lit(True)).alias("gold_invalid"),
                          F.coalesce("pred_invalid", F.lit(True)).alias("pred_invalid"),
                          F.when(F.coalesce("gold_invalid", F.lit(True)), F.lit("easy")).otherwise(F.col("hardness")).alias("hardness")))
    return comp, report


def roll_up(comp: DataFrame, report: DataFrame, compat: bool = True) -> DataFrame:
    """Per level and 'all': count, exact, and acc/rec/f1 per component."""
    lv = report.select("pair_id", F.explode(F.array(F.col("hardness"), F.lit("all"))).alias("level"), "exact")
    counts = lv.groupBy("level").agg(F.count("*").alias("count"), F.sum("exact").alias("exact_sum"))
    c = comp.join(lv.select("pair_id", "level"), "pair_id")
    sums = c.groupBy("level", "comp").agg(
        F.sum(F.when(F.col("pred_total") > 0, F.col("acc")).otherwise(0)).alias("acc_sum"),
        F.count(F.when(F.col("pred_total") > 0, 1)).alias("acc_count"),
        F.sum(F.when(F.col("label_total") > 0, F.col("rec")).otherwise(0)).alias("rec_sum"),
        F.count(F.when(F.col("label_total") > 0, 1)).alias("rec_count"))
    acc = F.when(F.col("acc_count") == 0, F.lit(0.0)).otherwise(F.col("acc_sum") / F.col("acc_count"))
    rec = F.when(F.col("rec_count") == 0, F.lit(0.0)).otherwise(F.col("rec_sum") / F.col("rec_count"))
    s = sums.withColumns({"acc": acc, "rec": rec})
    f1 = F.when((F.col("acc") == 0) & (F.col("rec") == 0), F.lit(1.0 if compat else 0.0)).otherwise(
        2.0 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    s = s.withColumn("f1", f1)
    parts = s.select("level", F.col("comp").alias("component"),
                     F.round("acc", 6).alias("acc"), F.round("rec", 6).alias("rec"), F.round("f1", 6).alias("f1"))
    totals = counts.select("level", F.lit("exact match").alias("component"), F.lit(None).cast("double").alias("acc"),
                           F.lit(None).cast("double").alias("rec"), F.round(F.col("exact_sum") / F.col("count"), 6).alias("f1"))
    cnt = counts.select("level", F.lit("count").alias("component"), F.lit(None).cast("double").alias("acc"),
                        F.lit(None).cast("double").alias("rec"), F.col("count").cast("double").alias("f1"))
    return parts.unionByName(totals).unionByName(cnt)


def pivot_scores(scores: DataFrame) -> DataFrame:
    """Component × level table of F1 (exact match and counts included)."""
    return scores.groupBy("component").pivot("level", list(LEVELS)).agg(F.first("f1"))


def metric_row(report: DataFrame, mode: str = "exact_match", exec_report: DataFrame | None = None) -> DataFrame:
    """E46/H03 metric plug-in: predictions+references → one-row DataFrame by mode.

    ``exact_match`` averages the pair report's exact flag, ``test_suite`` the
    execution report's match flag, ``both`` returns the two side by side.
    """
    parts = []
    if mode in ("exact_match", "both"):
        parts.append(report.agg(F.round(F.avg("exact"), 6).alias("exact_match"), F.count("*").alias("n_pairs")))
    if mode in ("test_suite", "both"):
        if exec_report is None:
            raise ValueError("test_suite needs an execution report")
        parts.append(exec_report.agg(F.round(F.avg(F.col("exec_match").cast("double")), 6).alias("exec")))
    if not parts:
        raise ValueError(f"unknown metric mode {mode}")
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)   # one-row frames
    return out
