"""Registered queries: candidate ranking on score tables, pointers and productions."""

from pyspark.sql import functions as F

from ..functions.seeded import unit
from ..operators import features as ft, productions as pr, ranking as rk, slotscore as sc
from ..operators.spans import value_spans
from . import base as b
from .registry import query
from .slots import FLAT, _flat
from .texts import pointer_rows


@query(
    "k1_probabilities",
    """select user_id, event_id, round(exp(value / 50 - max(value / 50) over w) / sum(exp(value / 50)) over w * exp(max(value / 50) over w), 9) as prob,
       round(1 / (1 + exp(-value / 50)), 9) as chance from events window w as (partition by user_id)""",
)
def k1_probabilities(t):
    rows = t.events.select("user_id", "event_id", (F.col("value") / 50).alias("score"))
    out = rk.softmax(rows, ["user_id"], "score")
    return out.select("user_id", "event_id", F.round("prob", 9).alias("prob"), F.round(rk.sigmoid(F.col("score")), 9).alias("chance"))


_UK = lambda d, *k: b.u_sql(13, d, "query_id", *k)


@query(
    "k2_joint_probability",
    b.using("slot_queries") + f"""select query_id, round(s, 9) as p_select, round(w, 9) as p_where, round(s * w, 9) as p_total from (select query_id,
      {_UK('sc')} * {_UK('sa')} as s, {_UK('wn')} * coalesce(list_product(flatten([[{_UK('wc', 'i')}, {_UK('wo', 'i')}, {_UK('st', 'i')}, {_UK('ed', 'i')}] for i in range(len(conds))])), 1) as w
      from slot_queries)""",
)
def k2_joint_probability(t):
    u = lambda d, *k: unit(13, d, "query_id", *k)
    part = lambda d: F.transform("conds", lambda c, i: u(d, i)).alias(f"p_{ {'wc': 'wc', 'wo': 'wo', 'st': 'first', 'ed': 'last'}[d] }")
    rows = b.slot_queries(t).select(
        "query_id", u("sc").alias("p_sc"), u("sa").alias("p_sa"), u("wn").alias("p_wn"), part("wc"), part("wo"), part("st"), part("ed")
    )
    out = rk.joint_probabilities(rows)
    return out.select("query_id", *[F.round(c, 9).alias(c) for c in ("p_select", "p_where", "p_total")])


@query(
    "k3_span_pairs",
    f"""with s as (select user_id, event_id, value / 100 as st, {b.u_sql(14, 'end', 'event_id')} as ed from events),
      n as (select *, exp(st) / sum(exp(st)) over w as ps, exp(ed) / sum(exp(ed)) over w as pe, row_number() over (partition by user_id order by st desc, event_id) as rs,
        row_number() over (partition by user_id order by ed desc, event_id) as re from s window w as (partition by user_id))
      select a.user_id, a.event_id as first, z.event_id as last, round(a.ps * z.pe, 9) as prob from n a join n z using (user_id) where a.rs <= 2 and z.re <= 2""",
)
def k3_span_pairs(t):
    rows = t.events.select("user_id", "event_id", (F.col("value") / 100).alias("start_score"), unit(14, "end", "event_id").alias("end_score"))
    return rk.best_and_pairs(rows, "user_id", "event_id", 4).withColumn("prob", F.round("prob", 9))


@query(
    "k4_span_words",
    b.using("slot_questions") + "select query_id, array_to_string([lower(c.val) for c in conds], '|') as words from slot_questions",
)
def k4_span_words(t):
    pieces = F.transform("toks", lambda w: F.regexp_extract_all(w, F.lit("(.{1,3})"), 1))
    rows = b.slot_questions(t).select("query_id", "toks", pieces.alias("p"), value_spans(F.col("toks"), F.col("conds")).alias("spans"))
    word_of, first = ft.piece_maps(F.col("p"))
    rows = rows.withColumn("word_of", word_of).withColumn("at", first)
    in_pieces = F.transform("spans", lambda s: F.struct(F.get("at", s.first).alias("first"), F.get("at", s.last).alias("last")))
    words = rk.span_words(F.col("toks"), F.col("word_of"), in_pieces)
    return rows.select("query_id", F.array_join(F.transform(words, lambda w: F.array_join(w, " ")), "|").alias("words"))


@query("k5_assembled", b.using("slot_queries") + f"select query_id, sel, agg, {FLAT} as conds from slot_queries")
def k5_assembled(t):
    p = ft.gold_parts(b.slot_queries(t))
    return p.select(
        "query_id", F.col("sc").alias("sel"), F.col("sa").alias("agg"), _flat(rk.assemble_conditions(F.col("wc"), F.col("wo"), F.col("wv"))).alias("conds")
    )


b.add_cte(
    "k6_select",
    f"""select row_id as item_id, table_id, sel::int as sel, agg::int as agg, {b.u_sql(15, 'sa', 'row_id', 'sel', 'agg')} as prob
        from slot_rows, unnest(range(4)) as x(sel), unnest(range(6)) as y(agg)""",
    "slot_rows",
)
b.add_cte(
    "k6_cond",
    f"""select row_id as item_id, col::int as col, op::int as op, cells[col + 1] as val, col in (0, 2) as is_num, {b.u_sql(15, 'cond', 'row_id', 'col', 'op')} as prob
        from slot_rows, unnest(range(4)) as x(col), unnest(range(3)) as y(op)""",
    "slot_rows",
)
b.add_cte(
    "k6_chosen",
    """select item_id, table_id, sel, agg from (select *, row_number() over (partition by item_id order by case when ok then rk else 100 - rk end) as place from (
         select *, sel in (0, 2) or agg in (0, 3) as ok from (select *, row_number() over (partition by item_id order by prob desc, sel, agg) as rk from k6_select) where rk <= 4)) where place = 1""",
    "k6_select",
)
b.add_cte(
    "k6_tried",
    """select item_id * 10 + rk as query_id, item_id, rk, prob, table_id, sel, agg, [{'col': col, 'op': op, 'val': val, 'is_num': is_num}] as conds from (
         select *, row_number() over (partition by item_id order by prob desc, col, op, val) as rk from k6_cond) join k6_chosen using (item_id) where rk <= 4""",
    "k6_cond", "k6_chosen",
)
b.run_sql("k6", "k6_tried")


@query(
    "k6_execution_guided",
    b.using("k6_sum", "k6_tried", "k6_chosen") + f""", good as (select *, row_number() over (partition by item_id order by rk) as no from k6_tried join (select query_id, n_rows from k6_sum) using (query_id)
        where agg > 0 or n_rows > 0),
      chance as (select item_id, 0 as no, {b.u_sql(15, 'wn', 'item_id', '0')} as score from k6_chosen union all
        select item_id, no, {b.u_sql(15, 'wn', 'item_id', 'no')} * prob from good),
      best as (select item_id, arg_max(no, (score, -no)) as n from chance group by item_id)
      select item_id, sel, agg, n::int as n, coalesce((select string_agg(conds[1].col::varchar || ':' || conds[1].op::varchar || ':' || conds[1].val, ';' order by no) from good g where g.item_id = c.item_id and g.no <= n), '') as conds
      from k6_chosen c join best using (item_id)""",
)
def k6_execution_guided(t):
    rows = b.slot_rows(t)
    item = rows.select(F.col("row_id").alias("item_id"), "table_id", "cells")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    u = lambda d, *k: unit(15, d, "item_id", *k)
    selects = item.select("item_id", "table_id", numbers(4).alias("sel")).withColumn("agg", numbers(6)).withColumn("prob", u("sa", "sel", "agg"))
    conds = item.select("item_id", "cells", numbers(4).alias("col")).withColumn("op", numbers(3))
    conds = conds.select("item_id", "col", "op", F.get("cells", F.col("col")).alias("val"), F.col("col").isin(0, 2).alias("is_num"), u("cond", "col", "op").alias("prob"))
    counts = item.select("item_id", numbers(5).alias("n")).withColumn("prob", u("wn", "n"))
    out = rk.execution_guided(selects, conds, counts, b.slot_tables(t), rows, 4)
    return out.select("item_id", "sel", "agg", F.size("conds").alias("n"), _flat(F.col("conds")).alias("conds"))


@query(
    "k7_reranked",
    f"""select item_id, event_id, place from (select *, row_number() over (partition by item_id order by value desc, event_id) as place from (
       select *, max(valid::int) over (partition by item_id) as any_valid from (select event_id // 10 as item_id, event_id, value, {b.u_sql(16, 'valid', 'event_id')} < 0.15 as valid from events))
       where valid or any_valid = 0) where place <= 3""",
)
def k7_reranked(t):
    rows = t.events.select(
        F.floor(F.col("event_id") / 10).alias("item_id"), "event_id", F.col("value").alias("score"), (unit(16, "valid", "event_id") < 0.15).alias("valid")
    )
    return rk.rerank_valid(rows, "item_id", "event_id", 3).select("item_id", "event_id", "place")


@query("k8_pointers_back", b.using("slot_queries") + f"select query_id, sel, agg, {FLAT.replace('c.val', 'lower(c.val)')} as conds from slot_queries")
def k8_pointers_back(t):
    return rk.queries_of_pointers(pointer_rows(t)).select("query_id", "sel", "agg", _flat(F.col("conds")).alias("conds"))


@query("k9_same_pointers", b.using("slot_queries") + f"select avg(case when {b.u_sql(17, 'drop', 'query_id')} < 0.25 then 0 else 1 end) as accuracy from slot_queries")
def k9_same_pointers(t):
    rows = pointer_rows(t).select("query_id", "pointers")
    pred = F.when(unit(17, "drop", "query_id") < 0.25, F.slice("pointers", 1, 2)).otherwise(F.col("pointers"))
    return rk.same_pointers(rows.withColumn("pred", pred), "pointers", "pred")


@query(
    "a11_productions",
    b.using("slot_queries") + """, r as (select 0 as kind, 'agg' as parent, 'Agg' || agg::varchar as child from slot_queries union all select 0, 'op', 'Op' || c.op::varchar from (select unnest(conds) as c from slot_queries)
       union all select 1, 'Agg' || agg::varchar, 'column' from slot_queries union all select 1, 'Op' || c.op::varchar, 'column value' from (select unnest(conds) as c from slot_queries)
       union all select 1, 'sql', case when len(conds) > 0 then 'select where' else 'select' end from slot_queries union all select 2, 'cond*', len(conds)::varchar from slot_queries),
       n as (select *, (row_number() over (order by kind, parent, child) - 1)::int as rule_id from (select distinct * from r))
       select rule_id, parent, child, min(rule_id) over (partition by kind, parent) as first_id, max(rule_id) over (partition by kind, parent) as last_id from n""",
)
def a11_productions(t):
    # The nodes that a query gives follow from its aggregate and operators; only their distinct kinds are carried on.
    q = b.slot_queries(t).select("agg", F.transform("conds", lambda c: F.struct(c.op.alias("op"))).alias("conds")).distinct()
    node = lambda df, s, ty, f: df.select(s.alias("sum_type"), ty.alias("type"), f.alias("fields"))
    none = F.lit(None).cast("string")
    nodes = node(q, none, F.lit("sql"), F.when(F.size("conds") > 0, "select where").otherwise("select"))
    nodes = nodes.unionByName(node(q, F.lit("agg"), F.concat(F.lit("Agg"), F.col("agg").cast("string")), F.lit("column")))
    conds = q.select(F.explode("conds").alias("c"))
    nodes = nodes.unionByName(node(conds, F.lit("op"), F.concat(F.lit("Op"), F.col("c.op").cast("string")), F.lit("column value")))
    return pr.observed_rules(nodes, q.select(F.lit("cond").alias("list_type"), F.size("conds").alias("length")))


@query(
    "j3_gold_prediction",
    b.using("slot_queries", "slot_predictions") + "select g.query_id, g.agg as gold_agg, p.agg as pred_agg from slot_queries g left join (select * from slot_predictions where not failed) p using (query_id)",
)
def j3_gold_prediction(t):
    pairs = sc.pair_queries(b.slot_queries(t), b.slot_predictions(t).filter("not failed"))
    return pairs.select("query_id", F.col("g.agg").alias("gold_agg"), F.col("p.agg").alias("pred_agg"))
