"""Row-local segmentation of SQL texts (E01, E04): a pushdown automaton as one
``aggregate`` over a text's token array.

A text is cut into tokens and every token gets its block, branch, clause and item
inside the row it came from: no token rows, no windows, no exchange. The state of
the automaton holds

  groups   the last paren group opened at each depth: is it a sub-query, a
           literal IN list
  levels   the block open at each sub-query depth: its number, set-operation
           branch, clause, items begun per clause, last BETWEEN / AND / OR
  out      the tokens before the last with what is known about them
  last     the last token, its block and its group, entered in the three lists
           one step later (a lambda's result is copied, so it must stay small)

Lookups in ``groups`` and ``levels`` are by depth, so texts with parens that do
not match are segmented as well (by the last group opened at that depth).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import SQL_OPS

CLAUSE_WORDS = ("select", "from", "where", "group", "having", "order", "limit")
COND_CLAUSES = ("on", "where", "having")
COUNTED = (*CLAUSE_WORDS, "on")                     # slot 0 counts tokens before any clause

GROUP = "struct<depth:int,sb:int,in_list:int>"
LEVEL = ("struct<sel_depth:int,sel_block:int,branch:int,block_depth:int,clause:string,bao:string,"
         "items:array<int>,body:string>")
TOKEN = ("struct<pos:int,tok:string,prv:string,nxt:string,in_list:int,sbo:int,sbc:int,sel_depth:int,sel_block:int,branch:int,"
         "kw:string,clause:string,at_top:boolean,is_conn:boolean,is_sep:boolean,item_no:int,is_struct:boolean,item_start:boolean,"
         "p_sel_block:int,p_branch:int,p_clause:string,p_item_no:int>")
LAST = f"struct<depth:int,sel_depth:int,group:{GROUP},level:{LEVEL},row:{TOKEN}>"
STATE = f"struct<groups:array<{GROUP}>,levels:array<{LEVEL}>,out:array<{TOKEN}>,last:{LAST}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once. The struct around the body keeps its
    type: without it nested bindings would work their types out again and again."""
    return F.get(F.transform(F.array(value), lambda v: F.struct(body(v).alias("v"))), 0)["v"]


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _int(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _level(sel_depth: Column, sel_block: Column, block_depth: Column) -> Column:
    return _named(sel_depth=sel_depth, sel_block=sel_block, branch=F.lit(0), block_depth=block_depth, clause=F.lit(None).cast("string"),
                  bao=F.lit(None).cast("string"), items=F.array_repeat(F.lit(0), len(COUNTED) + 1), body=F.lit(""))


def _groups(state: Column) -> Column:
    new = state["last"]["group"]
    return F.when(state["last"]["row"]["tok"] == "(", F.concat(F.filter(state["groups"], lambda g: g["depth"] != new["depth"]), F.array(new))
                  ).otherwise(state["groups"])


def _levels(state: Column) -> Column:
    new = state["last"]["level"]
    return F.when(state["last"].isNull(), state["levels"]).otherwise(
        F.concat(F.filter(state["levels"], lambda v: v["sel_depth"] != new["sel_depth"]), F.array(new)))


def _out(state: Column) -> Column:
    return F.when(state["last"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(state["last"]["row"])))


def _step(tokens: Column, state: Column, pos: Column) -> Column:
    """The state after the token at ``pos``."""
    before = state["last"]
    tok, nxt = F.get(tokens, pos), F.get(tokens, pos + 1)
    prv = F.when(pos > 0, F.get(tokens, pos - 1))
    opens, closes, new_branch = tok == "(", tok == ")", tok.isin(*SQL_OPS)
    depth = F.coalesce(before["depth"], F.lit(0)) + opens.cast("int")

    # the paren group of the token: a paren belongs to the group it opens or closes
    group = F.when(opens, _named(depth=depth, sb=_int(nxt == "select"), in_list=_int((prv == "in") & (nxt != "select")))).otherwise(
        F.coalesce(F.get(F.filter(_groups(state), lambda g: g["depth"] == depth), 0),
                   _named(depth=depth, sb=F.lit(0), in_list=F.lit(0))))

    def block(g: Column) -> Column:
        """The sub-query block: its paren begins one."""
        sbo = opens.cast("int") * g["sb"]
        sel_depth = F.coalesce(before["sel_depth"], F.lit(0)) + sbo
        held = F.get(F.filter(_levels(state), lambda v: v["sel_depth"] == sel_depth), 0)
        level = F.when(sbo == 1, _level(sel_depth, F.coalesce(held["sel_block"], F.lit(0)) + 1, depth)).otherwise(
            F.coalesce(held, _level(sel_depth, F.lit(0), F.lit(0))))
        return let(level, lambda v: clause(g, v, sbo, sel_depth))

    def clause(g: Column, v: Column, sbo: Column, sel_depth: Column) -> Column:
        kw = F.when(tok.isin(*CLAUSE_WORDS), tok).when(tok == "join", F.lit("from")).when(tok == "on", F.lit("on"))
        return let(_named(kw=kw, clause=F.coalesce(kw, F.when(~new_branch, v["clause"]))), lambda c: item(g, v, sbo, sel_depth, c))

    def item(g: Column, v: Column, sbo: Column, sel_depth: Column, c: Column) -> Column:
        at_top = depth == v["block_depth"]
        conn = F.coalesce(tok.isin("and", "or") & at_top & c["clause"].isin(*COND_CLAUSES)
                          & ~((tok == "and") & F.coalesce(v["bao"] == "between", F.lit(False))), F.lit(False))
        sep = F.coalesce(((tok == ",") & at_top & c["clause"].isin("select", "from", "group", "order"))
                         | ((tok == "join") & at_top & (c["clause"] == "from")), F.lit(False))
        slot = F.array_position(F.lit(list(COUNTED)), F.coalesce(c["clause"], F.lit(""))).cast("int")
        begun = F.when(new_branch, F.lit(0)).otherwise(F.get(v["items"], slot))
        return let(_named(conn=conn, sep=sep, slot=slot, item_no=begun + (conn | sep | (tok == "on")).cast("int")),
                   lambda i: after(g, v, sbo, sel_depth, c, i))

    def after(g: Column, v: Column, sbo: Column, sel_depth: Column, c: Column, i: Column) -> Column:
        sbc = closes.cast("int") * g["sb"]
        branch = v["branch"] + new_branch.cast("int")
        struct = F.coalesce(c["kw"].isNotNull() | i["conn"] | i["sep"] | new_branch
                            | ((tok == "by") & prv.isin("group", "order")) | ((tok == "distinct") & (prv == "select")), F.lit(False))
        body = ~struct & c["clause"].isNotNull() & (sbo == 0) & (sbc == 0)
        name, last, opener = F.concat(c["clause"], i["item_no"].cast("string")), before["row"], sbo == 1
        row = _named(
            pos=pos, tok=tok, prv=prv, nxt=nxt, in_list=g["in_list"], sbo=sbo, sbc=sbc, sel_depth=sel_depth, sel_block=v["sel_block"],
            branch=branch, kw=c["kw"], clause=c["clause"], at_top=depth == v["block_depth"], is_conn=i["conn"], is_sep=i["sep"],
            item_no=i["item_no"], is_struct=struct, item_start=body & (new_branch | (name != v["body"])),
            p_sel_block=F.when(opener, last["sel_block"]), p_branch=F.when(opener, last["branch"]),
            p_clause=F.when(opener, last["clause"]), p_item_no=F.when(opener, last["item_no"]))
        nothing = F.array_repeat(F.lit(0), len(COUNTED) + 1)
        level = _named(
            sel_depth=sel_depth, sel_block=v["sel_block"], branch=branch, block_depth=v["block_depth"], clause=c["clause"],
            bao=F.when(tok.isin("between", "and", "or"), tok).when(~new_branch, v["bao"]),
            items=F.when(new_branch, nothing).when(i["conn"] | i["sep"] | (tok == "on"), F.transform(
                v["items"], lambda x, k: F.when(k == i["slot"], i["item_no"]).otherwise(x))).otherwise(v["items"]),
            body=F.when(body, name).when(new_branch, F.lit("")).otherwise(v["body"]))
        return _named(depth=depth - closes.cast("int"), sel_depth=sel_depth - sbc, group=g, level=level, row=row)

    return _named(groups=_groups(state), levels=_levels(state), out=_out(state), last=let(group, block))


def segmented(tokens: Column) -> Column:
    """array<struct> of all tokens of a text with their place in the query."""
    start = _named(groups=F.array().cast(f"array<{GROUP}>"), levels=F.array(_level(F.lit(0), F.lit(0), F.lit(0))),
                   out=F.array().cast(f"array<{TOKEN}>"), last=F.lit(None).cast(LAST)).cast(STATE)
    # bound by a lambda: the optimizer would else put the token expression into every step
    return let(tokens, lambda t: F.aggregate(
        F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>")),
        start, lambda s, k: _step(t, s, k), _out))
