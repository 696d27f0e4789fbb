"""Registered queries: structural scores of multi-table queries, task metrics and beams.

Every order gives one gold query in one of seven shapes and a prediction with one of twelve
kinds of change, so that each of the ten parts is right in some rows and wrong in others; the
SQL twins state the outcome of each shape and change.
"""

from pyspark.sql import functions as F

from ..functions.seeded import pick_number, unit
from ..operators import metrics as mt, structscore as ss
from . import base as b
from .registry import query

_NONE = "cast(null as string)"


def _cu(col, agg=0, distinct="false"):
    return f"named_struct('agg', {agg}, 'col', '{col}', 'distinct', {distinct})"


def _vu(col, agg=0):
    return f"named_struct('op', 0, 'c1', {_cu(col, agg)}, 'c2', cast(null as {ss.COL_UNIT}))"


def _sel(*units):
    return "array(" + ", ".join(f"named_struct('agg', {a}, 'unit', {_vu(c)})" for a, c in units) + ")"


def _cond(col, op, val, agg=0, sub=_NONE, negated="false"):
    return (
        f"named_struct('negated', {negated}, 'op', {ss.WHERE_OPS.index(op)}, 'unit', {_vu(col, agg)}, 'val1', {val}, 'val2', {_NONE}, "
        f"'sub1', {sub}, 'sub2', {_NONE})"
    )


def _arr(items, kind):
    return f"array({', '.join(items)})" if items else f"cast(array() as array<{kind}>)"


def _core(sel, tables, where=(), ao=(), grp=(), having=(), order_dir=None, ord_=(), lim="cast(null as int)", distinct="false", from_conds=(), extra=""):
    return (
        f"named_struct('sel_distinct', {distinct}, 'sel', {sel}, 'tables', {_arr([repr(x) for x in tables], 'string')}, "
        f"'from_conds', {_arr(from_conds, ss.CONDITION)}, 'from_ao', cast(array() as array<string>), 'where', {_arr(where, ss.CONDITION)}, "
        f"'where_ao', {_arr([repr(x) for x in ao], 'string')}, 'grp', {_arr(grp, ss.COL_UNIT)}, 'having', {_arr(having, ss.CONDITION)}, "
        f"'having_ao', cast(array() as array<string>), 'order_dir', {repr(order_dir) if order_dir else _NONE}, 'ord', {_arr(ord_, ss.VAL_UNIT)}, 'lim', {lim}{extra})"
    )


def _full(*args, inter=None, **kw):
    none = f"cast(null as {ss.CORE_SCHEMA})"
    extra = f", 'intersect_q', {inter or none}, 'except_q', {none}, 'union_q', {none}"
    return _core(*args, extra=extra, **kw)


_PRICE, _STATUS, _CUST, _PRIO = "orders.o_totalprice", "orders.o_orderstatus", "orders.o_custkey", "orders.o_orderpriority"


def _shapes(v, op, agg, dir_, key, conn="and", inner=True, other_group=False, least=">=", picked=_PRICE, asked=None):
    """The seven shapes; v: literal, op: first operator, agg: first aggregate, dir_: direction, key: key column,
    conn: connector, inner: with the set operation, other_group: another group column, least: operator of HAVING,
    picked: first selected column, asked: first column of WHERE instead of the own one."""
    join = [_cond(_CUST, "=", "'customer.c_custkey'")]
    sub = "'{\"select\":\"c_custkey\",\"from\":\"customer\"}'"
    return [
        _full(_sel((agg, picked)), ["orders"], where=[_cond(asked or _STATUS, op, v), _cond(_PRICE, ">", v)], ao=[conn]),
        _full(_sel((3, "*")), ["orders", "customer"], where=[_cond(key, "=", v)], from_conds=join),
        _full(_sel((0, _PRIO), (1, _PRICE)), ["orders"], grp=[_cu(_STATUS if other_group else _PRIO)], order_dir=dir_, ord_=[_vu("*", 3)], lim="3"),
        _full(_sel((0, _CUST)), ["orders"], where=[_cond(asked or _PRICE, op, v)], distinct="true",
              inter=inner and _core(_sel((0, "customer.c_custkey")), ["customer"], where=[_cond("customer.c_mktsegment", "!=", v)])),
        _full(_sel((agg, picked), (0, _STATUS)), ["orders"], where=[_cond(_CUST, "in", _NONE, sub=sub)], grp=[_cu(_PRIO if other_group else _STATUS)], having=[_cond("*", least, v, agg=3)]),
        _full(_sel((0, "orders.o_orderkey")), ["orders"], where=[_cond(_PRIO, "like", v)], order_dir=dir_, ord_=[_vu(_PRICE)], lim="1"),
        _full(_sel((3, "*")), ["orders"]),
    ]


def _by_shape(shapes):
    return "case o_orderkey % 7 " + " ".join(f"when {i} then {s}" for i, s in enumerate(shapes[:-1])) + f" else {shapes[-1]} end"


def _gold_sql():
    return _by_shape(_shapes("cast(o_custkey as string)", "=", 5, "desc", "orders.o_custkey"))


# Kinds of change: 0 none, 1 literals, 2 first operator, 3 first aggregate, 4 direction, 5 equal key column of the other table,
# 6 connector, 7 no set operation, 8 group column, 9 operator of HAVING, 10 selected column, 11 column of WHERE.
_CHANGES = {
    2: {"op": "<"}, 3: {"agg": 1}, 4: {"dir_": "asc"}, 5: {"key": "customer.c_custkey"}, 6: {"conn": "or"}, 7: {"inner": None},
    8: {"other_group": True}, 9: {"least": ">"}, 10: {"picked": "orders.o_shippriority"}, 11: {"asked": "orders.o_clerk"},
}
_KINDS = 12


def _pred_sql(kind):
    v = "'other'" if kind == 1 else "cast(o_custkey as string)"
    return _by_shape(_shapes(**{"v": v, "op": "=", "agg": 5, "dir_": "desc", "key": "orders.o_custkey", **_CHANGES.get(kind, {})}))


def struct_pairs(t):
    kind = pick_number(_KINDS, 11, "kind", "o_orderkey")
    base = t.orders.select("o_orderkey", "o_custkey", kind.alias("kind"))
    pred = F.when(F.col("kind") == 0, F.expr(_pred_sql(0)))
    for k in range(1, _KINDS):
        pred = pred.when(F.col("kind") == k, F.expr(_pred_sql(k)))
    keys = F.create_map(F.lit("orders.o_custkey"), F.lit("customer.c_custkey"), F.lit("customer.c_custkey"), F.lit("customer.c_custkey"))
    return base.select(F.col("o_orderkey").alias("item_id"), F.expr(_gold_sql()).alias("gold"), pred.alias("pred"), keys.alias("keys"))


_KIND = b.n_sql(_KINDS, 11, "kind", "o_orderkey")
b.add_cte("kinds", f"select o_orderkey as item_id, o_orderkey % 7 as shape, {_KIND} as kind from orders")
# Outcome of a change in a shape: wrong parts.
b.add_cte(
    "outcomes",
    """select *, case shape when 6 then 'easy' when 0 then 'medium' when 1 then 'medium' when 2 then 'hard' when 3 then 'hard' else 'extra' end as hardness,
       not (kind in (3, 10) and shape in (0, 4)) as sel_ok, not (kind = 10 and shape in (0, 4)) as units_ok,
       not (kind in (2, 11) and shape in (0, 3)) as where_ok, not (kind = 11 and shape in (0, 3)) as where_units_ok,
       not (kind = 8 and shape in (2, 4)) as grp_ok, not (kind = 8 and shape in (2, 4) or kind = 9 and shape = 4) as having_ok,
       not (kind = 4 and shape in (2, 5)) as order_ok, not (kind = 6 and shape = 0) as ao_ok, not (kind = 7 and shape = 3) as set_ok,
       not (kind = 4 and shape in (2, 5) or kind = 6 and shape = 0 or kind = 7 and shape = 3) as words_ok from kinds""",
    "kinds",
)
_ALL_OK = "sel_ok and where_ok and having_ok and order_ok and ao_ok and set_ok"


@query("e8_part_matches", b.using("outcomes") + """select item_id, sel_ok::int as sel, units_ok::int as sel_no_agg, where_ok::int as wh, where_units_ok::int as wh_no_op, grp_ok::int as grp_no_having,
   having_ok::int as grp, order_ok::int as ord, ao_ok::int as and_or, set_ok::int as iuen, words_ok::int as keywords from outcomes""")
def e8_part_matches(t):
    s = ss.score_pairs(struct_pairs(t))
    names = ["sel", "sel_no_agg", "wh", "wh_no_op", "grp_no_having", "grp", "ord", "and_or", "iuen", "keywords"]
    return s.select("item_id", *[F.col("parts")[p].score.alias(n) for p, n in zip(ss.PARTS, names)])


@query("e9_exact_match", b.using("outcomes") + f"select item_id, ({_ALL_OK})::int as exact from outcomes")
def e9_exact_match(t):
    return ss.score_pairs(struct_pairs(t)).select("item_id", "exact")


@query("e10_hardness", b.using("outcomes") + "select item_id, hardness from outcomes")
def e10_hardness(t):
    return struct_pairs(t).select("item_id", ss.hardness(F.col("gold")).alias("hardness"))


@query(
    "e11_normal_form",
    b.using("kinds") + """select item_id, case when kind = 11 and shape in (0, 3) then 'orders.o_clerk' else case shape when 1 then 'customer.c_custkey' when 0 then 'orders.o_orderstatus' when 3 then 'orders.o_totalprice'
      when 4 then 'customer.c_custkey' when 5 then 'orders.o_orderpriority' end end as where_col, 0::bigint as literals from kinds""",
)
def e11_normal_form(t):
    n = struct_pairs(t).select("item_id", ss.normal(F.col("pred"), F.col("keys")).alias("n"))
    return n.select(
        "item_id", F.get("n.where", F.lit(0)).unit.c1.col.alias("where_col"),
        F.size(F.filter("n.where", lambda c: c.val1.isNotNull())).cast("long").alias("literals"),
    )


# Each part: right, in the gold query, in the prediction.
_PART = {
    "select": ("sel_ok", "true", "true"), "select(no AGG)": ("units_ok", "true", "true"), "where": ("where_ok", "shape in (0, 1, 3, 4, 5)", None),
    "where(no OP)": ("where_units_ok", "shape in (0, 1, 3, 4, 5)", None), "group(no Having)": ("grp_ok", "shape in (2, 4)", None), "group": ("having_ok", "shape in (2, 4)", None),
    "order": ("order_ok", "shape in (2, 5)", None), "and/or": ("ao_ok", "true", None), "IUEN": ("set_ok", "shape = 3", "shape = 3 and kind != 7"), "keywords": ("words_ok", "shape != 6", None),
}
_LONG = " union all ".join(
    f"select hardness, '{p}' as part, {gold} as in_gold, {pred or gold} as in_pred, ({ok})::int as score from outcomes" for p, (ok, gold, pred) in _PART.items()
)


@query(
    "e12_rolled_scores",
    b.using("outcomes") + f""", l as ({_LONG}), m as (select coalesce(hardness, 'all') as level, part, count(*) as n, coalesce(avg(case when in_pred then score end), 0) as a, coalesce(avg(case when in_gold then score end), 0) as r
      from l group by grouping sets ((part, hardness), (part)))
      select level, part, n, a as acc, r as rec, case when a = 0 and r = 0 then 1.0 else 2 * a * r / (a + r) end as f1 from m
      union all select coalesce(hardness, 'all'), 'exact', count(*), avg(({_ALL_OK})::int), null, null from outcomes group by rollup (hardness)""",
)
def e12_rolled_scores(t):
    return ss.rolled_scores(ss.score_pairs(struct_pairs(t)))


_E13_GOLD = "select o_orderstatus as a, count(*) as n from {} group by o_orderstatus"
_E13_OTHER = "select o_orderstatus as a, count(distinct o_custkey) as n from {} where o_totalprice > 100000 group by o_orderstatus"
_E13_PLACED = "select a, n, row_number() over (order by a {1}) as place from (select o_orderstatus as a, count(*) as n from {0} group by o_orderstatus) x"


@query(
    "e13_same_answer",
    f"""with gold as ({_E13_GOLD.format('orders')}), other as ({_E13_OTHER.format('orders')}), up as ({_E13_PLACED.format('orders', '')}), down as ({_E13_PLACED.format('orders', 'desc')})
      select 'swapped' as pair, (select count(*) from (select a, n from gold except all select a, n from gold)) = 0 as same
      union all select 'other', (select count(*) from (select a, n from gold except all select a, n from other)) = 0
        and (select count(*) from gold) = (select count(*) from other)
      union all select 'units', false
      union all select 'same order', (select count(*) from (select * from up except all select * from up)) = 0
      union all select 'other order', (select count(*) from (select * from up except all select * from down)) = 0""",
)
def e13_same_answer(t):
    t.orders.createOrReplaceTempView("e13_orders")
    run = t.spark.sql
    gold = run(_E13_GOLD.format("e13_orders"))
    swapped = run("select count(*), o_orderstatus from e13_orders group by o_orderstatus")
    other = run(_E13_OTHER.format("e13_orders")).select("n", "a")
    up, down = (run(_E13_PLACED.format("e13_orders", way)) for way in ("", "desc"))
    units = ["status", "count *"]
    named = lambda n, df: df.select(F.lit(n).alias("pair"), "same")
    return (
        named("swapped", ss.same_answer(gold, swapped, units, units[::-1]))
        .unionByName(named("other", ss.same_answer(gold, other, units, units[::-1])))
        .unionByName(named("units", ss.same_answer(gold, other, units, ["status", "sum"])))
        .unionByName(named("same order", ss.same_answer(up, up, units, units, "place")))
        .unionByName(named("other order", ss.same_answer(up, down, units, units, "place")))
    )


@query(
    "e14_beam_scores",
    """select item_id, max(case when rank = 0 then exact end) as first, max(exact) as best, min(case when exact = 1 then rank end) as best_rank from (
       select event_id // 5 as item_id, (event_id % 5)::int as rank, (value < 20)::int as exact from events) group by item_id""",
)
def e14_beam_scores(t):
    beams = t.events.select(
        F.floor(F.col("event_id") / 5).alias("item_id"), (F.col("event_id") % 5).cast("int").alias("rank"), (F.col("value") < 20).cast("int").alias("exact")
    )
    return ss.beam_scores(beams)


_PRED = f"case when {b.u_sql(12, 'flip', 'doc_id')} < 0.2 then 1 - quality else quality end"


@query(
    "e15_task_metrics",
    f"""with p as (select quality as y, {_PRED} as p from labels), c as (select count_if(p = 1 and y = 1)::double as tp, count_if(p = 1 and y = 0)::double as fp,
       count_if(p = 0 and y = 1)::double as fn, count_if(p = 0 and y = 0)::double as tn, count(*) as n from p)
       select round((tp + tn) / n, 9) as acc, round(2 * tp / (2 * tp + fp + fn), 9) as f1, round(((tp + tn) / n + 2 * tp / (2 * tp + fp + fn)) / 2, 9) as acc_and_f1,
       round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) as mcc from c""",
)
def e15_task_metrics(t):
    flip = unit(12, "flip", "doc_id") < 0.2
    rows = t.labels.select("quality", F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("pred"))
    m = mt.binary_metrics(rows, "pred", "quality")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query(
    "e15_correlations",
    """with x as (select l_quantity as p, l_discount * 100 as y from lineitem), r as (select p, y, avg(rp) over (partition by p) as rp, avg(ry) over (partition by y) as ry from (
       select p, y, row_number() over (order by p) as rp, row_number() over (order by y) as ry from x))
       select round(corr(p, y), 9) as pearson, round(corr(rp, ry), 9) as spearman, round((corr(p, y) + corr(rp, ry)) / 2, 9) as mean from r""",
)
def e15_correlations(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("p"), (F.col("l_discount") * 100).alias("y"))
    m = mt.score_correlations(rows, "p", "y")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])
